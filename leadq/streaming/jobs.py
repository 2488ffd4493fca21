"""Continuous ingestion and live figures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StringType, StructField, StructType

from leadq import schema as S
from leadq.operators.dedup import DATASET
from leadq.operators.store import Store
from leadq.plans.batch import process, run, timestamp, write
from leadq.session import temporary
from leadq.sources.feeds import csv_feed, facebook_feed, landing_page_feed, tagged
from leadq.sources.text import decode_text

JSON_FEEDS = {"facebook": facebook_feed, "landing_page": landing_page_feed}


def ingest_stream(
    mapped: DataFrame, store: Store, checkpoint: str, batch_ts: datetime, scope: str = DATASET
) -> DataStreamWriter:
    """Append a stream of mapped records to the store, each micro-batch as one batch.

    A repeat is an equal email or an equal phone, so it takes a join with the stored leads and
    not a keyed state. A micro-batch that is run again first meets the store without its own
    rows, and then replaces them: the tables end up as if it had run once.
    """

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        name = f"stream-{batch_id:012d}"
        stored = store.key_index(name)
        with temporary(store.spark):
            write(process(rows, timestamp(batch_ts), stored, scope), store, name)

    return mapped.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)


def ingest_feed(
    store: Store,
    source: str,
    path: str,
    memory: DataFrame,
    dataset_id: str,
    checkpoint: str,
    batch_ts: datetime,
    headers: list[str] | None = None,
    scope: str = DATASET,
    **options,
) -> DataStreamWriter:
    """Read files of a feed as they arrive, and run each micro-batch like an upload: read, map, process, quarantine, keep the books.

    The JSON feeds are read by lines. A CSV feed needs its `headers`, since a stream has one schema; files with a quoted
    line break belong into a batch. The store's logs are compacted as they grow. Several feeds may go into one store, one stream after the other.
    """
    if source in JSON_FEEDS:
        arriving = store.spark.readStream.text(path)
    else:
        if not headers:
            raise ValueError(f"a stream of {source} files needs their headers")
        schema = StructType([StructField(h, StringType()) for h in [*headers, "_bad_row"]])
        reader = store.spark.readStream.schema(schema).option("header", True).option("escape", '"').option("columnPruning", False)
        arriving = reader.option("columnNameOfCorruptRecord", "_bad_row").option("mode", "PERMISSIVE").csv(path)

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        if source in JSON_FEEDS:
            feed = JSON_FEEDS[source](rows.select(decode_text(F.col("value")).alias("value"), F.lit(False).alias("whole")))
        else:
            feed = csv_feed(rows, source)
        feed.records = tagged(feed.records)
        run(feed, store, memory, dataset_id, f"stream-{source}-{batch_id:012d}", batch_ts, scope=scope, source_kind=source, **options)
        store.compact_logs()

    return arriving.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)


def live_counts(leads: DataFrame) -> DataFrame:
    """Running figures per source over a stream of leads. The state is one row per source."""
    return leads.groupBy("source").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == S.FLAGGED).alias("flagged"),
        F.count_if(F.col("consent")).alias("consented"),
        F.avg("quality_score").alias("avg_score"),
    )
