"""The batch: mapped records -> leads, duplicates and rejects."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadq import model as scorer
from leadq import schema as S
from leadq.functions import display
from leadq.operators import analytics, clean, datasets, dedup, mapping, score, validate
from leadq.operators.positions import dense
from leadq.operators.store import Store, scoped
from leadq.session import balanced, staged, temporary
from leadq.sources.feeds import Feed, numbered


@dataclass
class Batch:
    leads: DataFrame
    duplicates: DataFrame
    invalid: DataFrame
    #: How many datasets the rows belong to, if that was counted.
    datasets: int | None = None


def timestamp(value: datetime | str) -> Column:
    return F.lit(str(value)).cast("timestamp")


def prepare(mapped: DataFrame, batch_ts: Column, model: GBTRegressionModel | None = None, epoch_text: bool = True, keep: bool = False) -> DataFrame:
    """Cleaned, validated and scored rows with their `errors`: one projection over the scan. With a `model` its
    prediction is the score. With `keep` they carry their signals."""
    cleaned = clean.check_contract(clean.clean_leads(mapped, epoch_text))
    valid = validate.validate(cleaned, batch_ts, cleaned=True)
    if model is None:
        return score.score(valid, keep=keep)
    return score.score(scorer.predict(model, valid), F.col("prediction"), keep).drop("prediction")


def process(
    mapped: DataFrame,
    batch_ts: Column,
    stored: DataFrame | dedup.KeyIndex | None = None,
    scope: str = dedup.DATASET,
    model: GBTRegressionModel | None = None,
) -> Batch:
    """Run a batch of mapped records (`ord`, `source`, `dataset_id` and canonical text columns).

    Scores come before duplicates are resolved, because the best score survives; flags and
    texts come after. The scored rows are written once and read back by column, since resolving
    duplicates passes over their identifiers several times. Whole rows meet the decision on them in one join,
    and the marked rows are written once for the tables to be split from. What follows from other columns, the ids and the texts, is
    neither staged nor moved: it is made where it is read.
    """
    rows = prepare(mapped, batch_ts, model, keep=True).withColumn("is_valid", F.size("errors") == 0)
    with balanced(mapped.sparkSession):
        rows = staged(rows.drop("lead_id"), "scored")
        parts = validate.split(rows)
        valid = parts.valid.drop("is_valid")
        done = dedup.marked(valid, dedup.decided(valid, stored, scope)).withColumn("_duplicate", F.col("status") == S.DUPLICATE)
        done = staged(done, "marked", partition_by=["_duplicate"], folders=2)  # each table reads its own rows only
        tables = [score.finish(_identified(done.filter(x).drop("_duplicate"))) for x in (~F.col("_duplicate"), F.col("_duplicate"))]
        return Batch(*tables, parts.invalid, rows.select("dataset_id").distinct().count())


def _identified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("lead_id", validate.lead_id(F.col("dataset_id"), F.col("source"), F.col("ord")))


def map_records(records: DataFrame, memory: DataFrame, resolver: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw records -> mapped records, and the decisions on their columns."""
    decisions = mapping.resolve_mapping(mapping.profile_fields(records), memory, resolver)
    decisions = staged(decisions, "mapping", keep=True)
    return mapping.apply_mapping(records, decisions), decisions


def positions(store: Store, records: DataFrame, batch_id: str, now: Column) -> DataFrame:
    """`records` with `ord` moved to a range of the batch's own, so that no two batches share a position or a lead id.

    The range is taken once and logged; the batch gets it again when it is retried, unless it has outgrown it.
    Within a batch, positions follow the order in which the files are read. Records that `run` numbers are dense, so a batch of n
    records takes n positions and the 2^63 there are don't run out.
    """
    log = store.read("batches").groupBy("batch_id").agg(F.max_by("first_ord", "logged_at").alias("first_ord"), F.max_by("next_ord", "logged_at").alias("next_ord"))
    need = records.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
    own = log.filter(F.col("batch_id") == batch_id).first()
    if own and own["first_ord"] + need <= own["next_ord"]:
        first = own["first_ord"]
    else:
        first = store.read("batches").agg(F.coalesce(F.max("next_ord"), F.lit(0))).first()[0]
        row = store.spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(first).alias("first_ord"), F.lit(first + need).alias("next_ord"), now.alias("logged_at"))
        store.append("batches", row)
    return records.withColumn("ord", F.col("ord") + first)


def write(batch: Batch, store: Store, batch_id: str) -> None:
    with balanced(store.spark, batch.leads.sparkSession):
        store.append("duplicate_leads", batch.duplicates, batch_id, datasets=batch.datasets)
        store.append("invalid_leads", batch.invalid, batch_id, datasets=batch.datasets)
        store.append("leads", batch.leads, batch_id, datasets=batch.datasets)


def summary(store: Store, batch_id: str) -> DataFrame:
    """What became of the rows of one batch, per dataset."""
    own = [store.read(t).filter(F.col("batch_id") == batch_id) for t in ("leads", "duplicate_leads", "invalid_leads")]
    return analytics.batch_summary(*own)


def _log_failure(store: Store, error: Exception, dataset_id: str, batch_id: str, source_kind: str | None) -> None:
    """Add an event to the log, with the number of this attempt of the batch. Events of earlier attempts stay."""
    earlier = store.read("healing_events").filter(F.col("batch_id") == batch_id)
    attempt = earlier.agg(F.coalesce(F.max("attempt"), F.lit(0)) + 1).first()[0]
    event = store.spark.range(1).select(
        F.lit(None).cast("long").alias("ord"), F.lit(source_kind).cast("string").alias("source"), F.lit(attempt).cast("int").alias("attempt"),
        F.lit(type(error).__name__).alias("exception_type"), F.lit(str(error)).alias("message"), F.lit(dataset_id).alias("dataset_id"),
    )
    store.append("healing_events", event, batch_id, keep=True)


@contextmanager
def books(
    store: Store, dataset_id: str, batch_id: str, source_kind: str | None = None, name: str | None = None, file_name: str | None = None, clock: Callable[[], datetime] = datetime.now
) -> Iterator[None]:
    """Keep the books of what is done inside: one batch of a dataset.

    The dataset is opened unless it exists, the run is started, and both are closed with what is in the tables. A new
    dataset in which nothing landed is taken back. A failure, of reading and mapping too, is added to the log of events, the run and the dataset
    are closed as failed, and the error goes on.
    """
    spark, now = store.spark, lambda: timestamp(clock())
    known = datasets.get_dataset(store.read("datasets"), dataset_id)
    is_new = known.isEmpty()
    one = spark.range(1)
    if is_new:
        title = display.import_name(F.lit(name).cast("string"), F.lit(file_name).cast("string"), F.lit(source_kind).cast("string"))
        row = one.select(F.lit(dataset_id).alias("dataset_id"), title.alias("name"), F.lit(file_name).cast("string").alias("file_name"), F.lit(source_kind).cast("string").alias("source_kind"))
        store.append("datasets", datasets.open_rows(row, now()))
    run_row = one.select(F.lit(batch_id).alias("run_id"), F.lit(source_kind).cast("string").alias("source"))
    store.append("pipeline_runs", datasets.start_run_rows(run_row, now()))
    status, landed = "failed", 0
    try:
        yield
        status = "completed"
    except Exception as error:
        _log_failure(store, error, dataset_id, batch_id, source_kind)
        raise
    finally:
        counts = summary(store, batch_id).groupBy().agg(
            F.coalesce(F.sum("scored"), F.lit(0)).alias("processed"), F.coalesce(F.sum("invalid"), F.lit(0)).alias("failed"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates")
        )
        counts = counts.select("*", (F.col("processed") + F.col("failed") + F.col("duplicates")).alias("total_records"), F.lit(batch_id).alias("run_id"))
        row = counts.first()
        landed = row["total_records"]
        store.append("pipeline_runs", datasets.finish_run_rows(spark.createDataFrame([row], counts.schema), now(), status))
        if not datasets.keep_dataset(is_new, landed, status == "failed"):
            store.append("datasets", datasets.delete_rows(store.read("datasets"), one.select(F.lit(dataset_id).alias("dataset_id")), now()))
        else:
            own = [scoped(store.read(t), dataset_id) for t in ("leads", "duplicate_leads", "invalid_leads")]
            totals = one.select(F.lit(dataset_id).alias("dataset_id")).join(datasets.dataset_counts(*own), "dataset_id", "left")
            # the log is read and written here, so the new rows are made first
            done = datasets.finish_rows(store.read("datasets"), totals, now(), status)
            store.append("datasets", spark.createDataFrame(done.collect(), done.schema))


def _land(mapped: DataFrame, bad: DataFrame, store: Store, dataset_id: str, batch_id: str, batch_ts: datetime, scope: str, model: GBTRegressionModel | None, now: Column) -> None:
    rows = positions(store, mapped.withColumn("dataset_id", F.lit(dataset_id)), batch_id, now)
    stored = store.key_index(batch_id, dataset_id if scope == dedup.DATASET else None)
    with temporary(store.spark):
        write(process(rows, timestamp(batch_ts), stored, scope, model), store, batch_id)
    store.append("quarantine", bad, batch_id)


def run_mapped(
    mapped: DataFrame,
    bad: DataFrame,
    store: Store,
    dataset_id: str,
    batch_id: str,
    batch_ts: datetime,
    scope: str = dedup.DATASET,
    source_kind: str | None = None,
    name: str | None = None,
    file_name: str | None = None,
    clock: Callable[[], datetime] = datetime.now,
    model: GBTRegressionModel | None = None,
) -> None:
    """Process mapped records as one batch of a dataset and keep its books.

    Running a batch again leaves all tables as if it had run once: it never meets its
    own earlier rows and replaces them all. Only the log of failures keeps what earlier attempts met.
    """
    with books(store, dataset_id, batch_id, source_kind, name, file_name, clock):
        _land(mapped, bad, store, dataset_id, batch_id, batch_ts, scope, model, timestamp(clock()))


def run(
    feed: Feed | Callable[[], Feed],
    store: Store,
    memory: DataFrame,
    dataset_id: str,
    batch_id: str,
    batch_ts: datetime,
    resolver: DataFrame | None = None,
    scope: str = dedup.DATASET,
    source_kind: str | None = None,
    name: str | None = None,
    file_name: str | None = None,
    clock: Callable[[], datetime] = datetime.now,
    model: GBTRegressionModel | None = None,
) -> DataFrame:
    """Read a feed, process it and append the outcome to the store. Gives the column decisions.

    A feed that is given as a function is read inside the run, so that a failure to read is in the books like one of mapping or processing.
    Decisions worth keeping are added to the store's mapping memory, which goes over `memory`.
    """
    with books(store, dataset_id, batch_id, source_kind, name, file_name, clock), temporary(store.spark):
        feed = feed() if callable(feed) else feed
        records = dense(feed.records.withColumn("dataset_id", F.lit(dataset_id)))
        learned = store.read("mapping_memory")
        mapped, decisions = map_records(records, mapping.upsert(memory.select(*learned.columns).unionByName(learned)), resolver)
        new = mapping.confirmed(decisions, timestamp(batch_ts)).join(mapping.upsert(learned), ["source", "field_name", "canonical_field"], "left_anti")
        store.append("mapping_memory", new)
        _land(mapped, feed.quarantine, store, dataset_id, batch_id, batch_ts, scope, model, timestamp(clock()))
    return decisions


def dry_run(feed: Feed, memory: DataFrame, resolver: DataFrame | None = None) -> DataFrame:
    """How the columns of a feed would be mapped; nothing is processed or stored."""
    return mapping.resolve_mapping(mapping.profile_fields(numbered(feed.records)), memory, resolver)
