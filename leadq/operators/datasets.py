"""Datasets and runs: append-only logs of what happened, read as the current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadq.operators.analytics import _average, _kept, _outcome, _outcomes
from leadq.operators.logs import folded
from leadq.operators.store import DATASET, RUN

_DATASET_COLUMNS = [c for c in DATASET.fieldNames() if c not in ("dataset_id", "deleted", "logged_at")]
_RUN_COLUMNS = [c for c in RUN.fieldNames() if c not in ("run_id", "logged_at")]


def _elapsed_ms(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("long")


def dataset_counts(leads: DataFrame, duplicates: DataFrame, invalid: DataFrame) -> DataFrame:
    """Counts of every dataset, recomputed from the rows tagged with it."""
    return (
        _outcomes(leads, duplicates, invalid)
        .groupBy("dataset_id")
        .agg(
            _kept().alias("total_leads"),
            _outcome("clean").alias("clean"),
            _outcome("flagged").alias("flagged"),
            _outcome("invalid").alias("invalid"),
            _outcome("duplicate").alias("duplicates"),
            _average(1).alias("avg_score"),
        )
    )


def current_datasets(log: DataFrame) -> DataFrame:
    """State of every dataset that is not deleted. A log row sets the columns it carries."""
    state = folded(log, ["dataset_id"], F.col("logged_at"), _DATASET_COLUMNS + ["deleted"])
    return state.filter(~F.coalesce("deleted", F.lit(False))).drop("deleted")


def list_datasets(log: DataFrame, limit: int = 100) -> DataFrame:
    return current_datasets(log).orderBy(F.desc("created_at"), "dataset_id").limit(limit)


def _log_row(df: DataFrame, now: Column) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[
            F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in DATASET.fields
            if f.name != "logged_at"
        ],
        now.alias("logged_at"),
    )


def open_rows(new: DataFrame, now: Column) -> DataFrame:
    """Log rows that open datasets; `new` has dataset_id, name, file_name, source_kind."""
    return _log_row(new.withColumns({"status": F.lit("processing"), "created_at": now}), now)


def finish_rows(log: DataFrame, counts: DataFrame, now: Column, status: str = "completed") -> DataFrame:
    """Log rows that close the datasets in `counts`, with counts and elapsed time."""
    started = current_datasets(log).select("dataset_id", "created_at")
    done = counts.join(started, "dataset_id").withColumns(
        {"status": F.lit(status), "finished_at": now, "time_taken_ms": _elapsed_ms(F.col("created_at"), now)}
    )
    return _log_row(done.drop("created_at"), now)


def update_rows(log: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Log rows for changes `(dataset_id, name, notes, tags)`; NULL leaves a field as it is and
    a blank name becomes a stock one. Changes to unknown datasets are dropped."""
    name = F.when(F.col("name").isNotNull(), F.coalesce(F.expr("nullif(trim(name), '')"), F.lit("Untitled dataset")))
    known = current_datasets(log).select("dataset_id")
    return _log_row(changes.withColumn("name", name).join(known, "dataset_id", "left_semi"), now)


def delete_rows(log: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Tombstones for existing datasets; `Store.drop_partitions` removes the files later."""
    known = current_datasets(log).select("dataset_id")
    return _log_row(ids.select("dataset_id").join(known, "dataset_id", "left_semi").withColumn("deleted", F.lit(True)), now)


def backfilled(table: DataFrame) -> DataFrame:
    """Rows of the time before datasets go to one dataset per source. Running it again changes nothing."""
    name = F.concat(F.lit("backfill-"), F.col("source"))
    return table.withColumn("dataset_id", F.coalesce("dataset_id", name))


def backfill_datasets(leads: DataFrame, duplicates: DataFrame, invalid: DataFrame) -> DataFrame:
    """The datasets that backfilling creates, with name and counts."""
    untagged = [t.filter(F.col("dataset_id").isNull()) for t in (leads, duplicates, invalid)]
    counts = dataset_counts(*[backfilled(t) for t in untagged])
    kind = F.expr("substring(dataset_id, length('backfill-') + 1)")
    title = F.concat(F.initcap(F.translate(kind, "_", " ")), F.lit(" feed (imported)"))
    return counts.filter(F.col("dataset_id").isNotNull()).select(
        "dataset_id", title.alias("name"), kind.alias("source_kind"), F.lit("completed").alias("status"),
        "total_leads", "clean", "flagged", "invalid", "duplicates", "avg_score",
    )


def _run_row(df: DataFrame, now: Column) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RUN.fields
            if f.name != "logged_at"
        ],
        now.alias("logged_at"),
    )


def start_run_rows(runs: DataFrame, now: Column) -> DataFrame:
    """Log rows that start runs; `runs` has run_id and source."""
    return _run_row(runs.withColumns({"status": F.lit("processing"), "started_at": now}), now)


def finish_run_rows(runs: DataFrame, now: Column, status: str = "completed") -> DataFrame:
    """Log rows that end runs; `runs` has run_id and the counts total_records, processed, failed, duplicates."""
    return _run_row(runs.withColumns({"status": F.lit(status), "finished_at": now}), now)


def get_dataset(log: DataFrame, dataset_id: str) -> DataFrame:
    """State of one dataset; no row if there is none or it was deleted."""
    return current_datasets(log.filter(F.col("dataset_id") == dataset_id))


def get_run(log: DataFrame, run_id: str) -> DataFrame:
    return current_runs(log.filter(F.col("run_id") == run_id))


def current_runs(log: DataFrame) -> DataFrame:
    """State of every run, with the time from its start to its end."""
    state = folded(log, ["run_id"], F.col("logged_at"), _RUN_COLUMNS)
    return state.withColumn("time_taken_ms", F.coalesce("time_taken_ms", _elapsed_ms(F.col("started_at"), F.col("finished_at"))))


def recent_runs(log: DataFrame, limit: int = 20) -> DataFrame:
    return current_runs(log).orderBy(F.desc("started_at"), "run_id").limit(limit)


def keep_dataset(is_new: bool, landed: int, failed: bool) -> bool:
    """A new dataset nothing landed in is rolled back, unless its batch failed."""
    return failed or not is_new or landed > 0


def final_status(batch_status: str) -> str:
    return "failed" if batch_status in ("error", "human_review") else "completed"


