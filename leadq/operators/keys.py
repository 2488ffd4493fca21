"""The key index: which lead was first stored under an identifier, without reading the leads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadq.functions.strings import present

DATASET, GLOBAL = "dataset", "global"
#: Parts of the index by the hash of an identifier. Fixed for the life of a store.
BUCKETS = 16

KEYS = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("lead_id", T.StringType()),
        T.StructField("dataset_id", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("batch_id", T.StringType()),
    ]
)


def identifiers(leads: DataFrame, *columns: str | Column) -> DataFrame:
    """`columns` of the leads, and a row with `(kind, value)` for each of their identifiers: email in lower case, phone. Missing ones are left
    out. No list is built, and the optimizer can't repeat in a filter below what `leads` are made by."""
    each = F.stack(F.lit(2), F.lit("email"), F.lower("email"), F.lit("phone"), F.col("phone_e164"))
    return leads.select(*columns, each.alias("kind", "value")).filter(present(F.col("value")))


def bucket_of(kind: Column, value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(kind, value), F.lit(buckets)).cast("int")


def scoped_key(kind: Column, value: Column, dataset_id: Column, scope: str) -> Column:
    """Key text. A dataset is a world of its own unless the scope is global."""
    return F.concat_ws(":", *([kind, dataset_id, value] if scope == DATASET else [kind, value]))


def index_rows(leads: DataFrame, buckets: int = BUCKETS, keep: list[str] | None = None) -> DataFrame:
    """A row of the index per lead and identifier: a projection, nothing is grouped."""
    own = ["ord", "lead_id", "dataset_id", *(keep or [])]
    return identifiers(leads, *own).select("kind", "value", *own, bucket_of(F.col("kind"), F.col("value"), buckets).alias("bucket"))


@dataclass
class KeyIndex:
    """Rows of the index, laid out by dataset and bucket. `dataset_id` limits it to one dataset."""

    rows: DataFrame
    buckets: int = BUCKETS
    dataset_id: str | None = None

    def own(self, scope: str) -> DataFrame:
        """Rows of the index that a batch in this scope can match."""
        return self.rows.filter(F.col("dataset_id") == self.dataset_id) if scope == DATASET and self.dataset_id is not None else self.rows

    def rows_for(self, incoming: DataFrame, scope: str) -> DataFrame:
        """`(key, ord, lead_id)` of the parts in which identifiers of `incoming` may lie. Which parts those are is the one thing
        that reaches the driver, at most `buckets` numbers; the others aren't opened."""
        parts = identifiers(incoming).select(bucket_of(F.col("kind"), F.col("value"), self.buckets).alias("bucket")).distinct().collect()
        rows = self.own(scope)
        rows = rows.filter(F.col("bucket").isin([r["bucket"] for r in parts])) if len(parts) < self.buckets else rows
        return rows.select(scoped_key(F.col("kind"), F.col("value"), F.col("dataset_id"), scope).alias("key"), "ord", "lead_id")


def known_keys(incoming: DataFrame, wanted: DataFrame, stored: DataFrame | KeyIndex, scope: str) -> DataFrame:
    """`(key, stored_lead_id)`: the first lead stored under each key in `wanted(key)`, keys of `incoming`.

    Stored keys meet the wanted ones first; only what matches is combined, because stores that hold several datasets, or rows that were never
    deduplicated, have a key more than once.
    """
    if isinstance(stored, KeyIndex):
        rows = stored.rows_for(incoming, scope)
    else:
        rows = index_rows(stored).select(scoped_key(F.col("kind"), F.col("value"), F.col("dataset_id"), scope).alias("key"), "ord", "lead_id")
    hits = rows.join(wanted, "key", "left_semi")
    return hits.groupBy("key").agg(F.min_by("lead_id", "ord").alias("stored_lead_id"))
