"""Lead tables: parquet folders partitioned by dataset and batch, plus append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadq import schema as S
from leadq.operators.keys import BUCKETS, KEYS, KeyIndex, index_rows
from leadq.operators.logs import deciding, latest
from leadq.operators.mapping import MEMORY
from leadq.operators.skew import join_groups
from leadq.session import open_files

#: Tables whose rows belong to a batch, with their partition columns. A batch is replaced as a whole.
PARTITIONS = {t: ["dataset_id", "batch_id"] for t in S.DATA_TABLES} | {"quarantine": ["batch_id"], "lead_keys": ["dataset_id", "bucket", "batch_id"]}

HEALING = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("exception_type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("dataset_id", T.StringType()),
    ]
)
QUARANTINE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("raw_data", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("retries_used", T.IntegerType()),
    ]
)
DISPOSITION = T.StructType(
    [
        T.StructField("lead_id", T.StringType()),
        T.StructField("disposition", T.StringType()),
        T.StructField("decided_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)
DATASET = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("source_kind", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("total_leads", T.LongType()),
        T.StructField("clean", T.LongType()),
        T.StructField("flagged", T.LongType()),
        T.StructField("invalid", T.LongType()),
        T.StructField("duplicates", T.LongType()),
        T.StructField("avg_score", T.DoubleType()),
        T.StructField("notes", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("time_taken_ms", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("logged_at", T.TimestampType()),
    ]
)
RUN = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("total_records", T.LongType()),
        T.StructField("processed", T.LongType()),
        T.StructField("failed", T.LongType()),
        T.StructField("duplicates", T.LongType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("time_taken_ms", T.LongType()),
        T.StructField("logged_at", T.TimestampType()),
    ]
)

BATCHES = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("first_ord", T.LongType()),
        T.StructField("next_ord", T.LongType()),
        T.StructField("logged_at", T.TimestampType()),
    ]
)

_BATCH = T.StructField("batch_id", T.StringType())
SCHEMAS = {
    "leads": T.StructType(S.LEAD.fields + [_BATCH]),
    "duplicate_leads": T.StructType(S.LEAD.fields + [_BATCH]),
    "invalid_leads": T.StructType(S.INVALID.fields + [_BATCH]),
    "healing_events": T.StructType(HEALING.fields + [_BATCH]),
    "quarantine": T.StructType(QUARANTINE.fields + [_BATCH]),
    "dispositions": DISPOSITION,
    "datasets": DATASET,
    "pipeline_runs": RUN,
    "mapping_memory": MEMORY,
    "batches": BATCHES,
    "lead_keys": KEYS,
}
#: Append-only logs: the key of a row, the order of the rows of a key, and the columns that keep their value where a later row leaves them open.
#: All ranges of positions ever taken stay, because the next one starts above them.
LOGS = {
    "datasets": (["dataset_id"], ["logged_at"], [c for c in DATASET.fieldNames() if c not in ("dataset_id", "logged_at")]),
    "pipeline_runs": (["run_id"], ["logged_at"], [c for c in RUN.fieldNames() if c not in ("run_id", "logged_at")]),
    "batches": (["batch_id", "first_ord", "next_ord"], ["logged_at"], []),
    "mapping_memory": (["source", "field_name"], ["decided_at", "canonical_field"], []),
    "dispositions": (["lead_id"], ["decided_at", "seq"], []),
}
#: Rows of up to as many partition folders are written by the tasks that read them; for more, they are gathered by folder first.
FEW_FOLDERS = 8
#: A log with as many files since its last snapshot gets a new one.
TAIL_FILES = 64


class Store:
    """Tables under one root folder. There is one writer per table: a batch job, or the
    micro-batches of one stream."""

    def __init__(self, spark: SparkSession, root: str, key_buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.key_buckets = key_buckets

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def exists(self, table: str) -> bool:
        fs, path = self._fs(self.path(table))
        return fs.exists(path)

    def read(self, table: str) -> DataFrame:
        """The table under its declared schema; columns that older files lack are NULL, and a
        table never written is empty."""
        schema = SCHEMAS[table]
        if not self.exists(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table), *self._snapshots(table)).select(*schema.fieldNames())

    def _snapshots(self, table: str) -> list[str]:
        """Finished snapshots of a log, oldest first. There is one, or two where a compaction did not come to its end."""
        if table not in LOGS:
            return []
        fs, pattern = self._fs(f"{self.path(table)}_snapshots/*/_SUCCESS")
        return sorted(str(x.getPath().getParent().toString()) for x in fs.globStatus(pattern) or [])

    def _tail(self, table: str) -> list[str]:
        """Files appended to a log since its last snapshot."""
        fs, pattern = self._fs(f"{self.path(table)}/part-*")
        return [str(x.getPath().toString()) for x in fs.globStatus(pattern) or []]

    def compact(self, table: str) -> None:
        """Maintenance: put the rows of a log that its state depends on into a snapshot, and delete the files they came from.

        Reading a log costs its state and its tail from then on, not its history. A snapshot is made of the one before and the tail. It
        counts once it is finished, and may stand beside the files it was made of, because its rows are theirs: a job that dies at
        any point leaves the state as it was. Read a log again after this; what was read before names deleted files.
        """
        tail, old = self._tail(table), self._snapshots(table)
        number = int(old[-1].rsplit("/", 1)[1]) + 1 if old else 0
        deciding(self.read(table), *LOGS[table]).write.mode("overwrite").parquet(f"{self.path(table)}_snapshots/{number:012d}")
        for file in tail + old:
            fs, path = self._fs(file)
            fs.delete(path, True)

    def compact_logs(self, after: int = TAIL_FILES) -> list[str]:
        """Compact the logs whose tail has `after` files or more; tells which."""
        grown = [t for t in LOGS if len(self._tail(t)) >= after]
        for table in grown:
            self.compact(table)
        return grown

    def read_as_written(self, table: str) -> DataFrame:
        """Every column that any file of the table has."""
        return self.spark.read.option("mergeSchema", "true").parquet(self.path(table))

    def append(self, table: str, df: DataFrame, batch_id: str | None = None, keep: bool = False, datasets: int | None = None) -> None:
        """Add rows. Tables with batches need the name of theirs: writing a batch again replaces all its rows in the table, in
        every dataset, so a repeated micro-batch or a retried job leaves the table as if it ran once, also when it
        now has fewer rows; with `keep` its earlier rows stay too. The identifiers of leads go into the key index with them.

        `datasets` says how many datasets the rows belong to. Where those are few, each task writes its rows as they come, without
        moving or sorting them; otherwise rows are gathered by dataset first, so that files stay whole."""
        if table not in PARTITIONS:
            df.select(*SCHEMAS[table].fieldNames()).write.mode("append").parquet(self.path(table))
            return
        if not batch_id:
            raise ValueError(f"rows of {table} belong to a batch: give its batch_id")
        partitions = PARTITIONS[table]
        columns = [c for c in SCHEMAS[table].fieldNames() if c not in partitions]
        extra = [c for c in df.columns if c not in columns + partitions]
        rows = df.withColumn("batch_id", F.lit(batch_id))
        missing = [c for c in columns if c not in rows.columns]
        rows = rows.withColumns({c: F.lit(None).cast(SCHEMAS[table][c].dataType) for c in missing}) if missing else rows
        before = {} if keep else self._batch_files(table, batch_id)
        rows = rows.select(*columns, *extra, *partitions)
        folders = 1 if partitions == ["batch_id"] else datasets if partitions == ["dataset_id", "batch_id"] else None
        in_place = folders is not None and folders <= FEW_FOLDERS
        if not in_place:
            rows = rows.hint("rebalance", *partitions[:-1])  # whole files per dataset; a big dataset is split over many tasks
        with open_files(self.spark, FEW_FOLDERS if in_place else 0):
            (
                rows.write.mode("append" if keep else "overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(*partitions)
                .parquet(self.path(table))
            )
        for folder, files in ({} if keep else self._batch_files(table, batch_id)).items():
            if before.get(folder) == files:  # of the earlier attempt: nothing replaced it
                fs, path = self._fs(folder)
                fs.delete(path, True)
        if table == "leads":
            written = self.read("leads").filter(F.col("batch_id") == batch_id)
            self.append("lead_keys", index_rows(written, self.key_buckets), batch_id)

    def key_index(self, but: str | None = None, dataset_id: str | None = None) -> KeyIndex:
        """The index over all stored leads, or one dataset's, without the batch `but`, which is about to be written again."""
        rows = self.read("lead_keys")
        return KeyIndex(rows if but is None else rows.filter(F.col("batch_id") != but), self.key_buckets, dataset_id)

    def rebuild_key_index(self) -> None:
        """Maintenance: make the index anew from the stored leads, for a store that was written without one."""
        partitions = PARTITIONS["lead_keys"]
        rows = index_rows(self.read("leads"), self.key_buckets, ["batch_id"]).select(*KEYS.fieldNames())
        rows.hint("rebalance", *partitions[:-1]).write.mode("overwrite").partitionBy(*partitions).parquet(self.path("lead_keys"))

    def _batch_files(self, table: str, batch_id: str) -> dict[str, list[str]]:
        """Files of a batch by partition folder."""
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch_id)
        depth = "*/" * (len(PARTITIONS[table]) - 1)
        fs, pattern = self._fs(f"{self.path(table)}/{depth}batch_id={name}")
        folders = [x.getPath() for x in fs.globStatus(pattern) or []]
        return {str(f.toString()): sorted(x.getPath().getName() for x in fs.listStatus(f)) for f in folders}

    def clear(self, tables: list[str] | None = None) -> dict[str, str]:
        """Empty the tables; tells per table whether there was one."""
        outcome = {}
        for table in tables or S.RESET_TABLES:
            if not self.exists(table):
                outcome[table] = "absent"
                continue
            writer = self.spark.createDataFrame([], SCHEMAS[table]).write.mode("overwrite")
            if table in PARTITIONS:
                writer = writer.partitionBy(*PARTITIONS[table])
            writer.parquet(self.path(table))
            for snapshot in self._snapshots(table):
                fs, path = self._fs(snapshot)
                fs.delete(path, True)
            outcome[table] = "cleared"
            if table == "leads" and self.exists("lead_keys"):
                self.clear(["lead_keys"])
        return outcome

    def drop_partitions(self, dataset_id: str) -> None:
        """Maintenance: remove the files of one dataset from every lead table."""
        for table in [*S.DATA_TABLES, "lead_keys"]:
            fs, path = self._fs(f"{self.path(table)}/dataset_id={dataset_id}")
            if fs.exists(path):
                fs.delete(path, True)


def recent(table: DataFrame, limit: int) -> DataFrame:
    """The `limit` newest rows, oldest of them first."""
    return table.orderBy(F.col("ord").desc()).limit(limit).orderBy("ord")


def union_by_name(tables: list[DataFrame]) -> DataFrame:
    """Rows of tables whose columns grew over time; what a table lacks is NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def record_dispositions(requests: DataFrame, leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split requests `(lead_id, disposition, ...)` into accepted ones and refused ones, the
    latter with a reason: unknown status, or no such lead."""
    valid = F.coalesce(F.col("disposition").isin(S.CALL_STATUSES), F.lit(False))
    asked, ids = requests.filter(valid), leads.select("lead_id")
    sizes = asked.groupBy("lead_id").agg(F.count("*").alias("size"))  # a lead may be asked for very often
    accepted = join_groups(asked, sizes.join(ids, "lead_id", "left_semi"), "lead_id", "size").drop("size")
    unknown = join_groups(asked, sizes.join(ids, "lead_id", "left_anti"), "lead_id", "size").drop("size")
    unknown = unknown.withColumn("reason", F.lit("unknown lead"))
    refused = requests.filter(~valid).withColumn("reason", F.lit("unknown status")).unionByName(unknown)
    return accepted, refused


def current_dispositions(log: DataFrame) -> DataFrame:
    return latest(log, ["lead_id"], F.struct("decided_at", "seq"), ["disposition"])


def with_disposition(leads: DataFrame, log: DataFrame) -> DataFrame:
    return leads.join(current_dispositions(log), "lead_id", "left")


def scoped(table: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """Rows of one dataset; on a stored table this prunes partitions."""
    return table if dataset_id is None else table.filter(F.col("dataset_id") == dataset_id)


def active(table: DataFrame, datasets_log: DataFrame) -> DataFrame:
    """Rows of datasets that were not deleted; rows without a dataset stay. One dataset may hold
    most of the rows, so they are matched as groups."""
    columns = table.columns
    rows = table.withColumn("_dataset", F.coalesce("dataset_id", F.lit("")))
    gone = datasets_log.filter("deleted").select(F.col("dataset_id").alias("_dataset")).distinct()
    alive = rows.groupBy("_dataset").agg(F.count("*").alias("_size")).join(gone, "_dataset", "left_anti")
    return join_groups(rows, alive, "_dataset", "_size").select(*columns)
