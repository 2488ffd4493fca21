"""Append-only logs read as their current state. They stand in for row updates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadq.operators.skew import join_groups


def latest(log: DataFrame, key: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Last row per key. An aggregate: a key with many versions is one row per task after the
    map-side combine."""
    row = F.max_by(F.struct(*columns), order)
    return log.groupBy(*key).agg(row.alias("_row")).select(*key, "_row.*")


def folded(log: DataFrame, key: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Per key and column the last value that is not NULL: a row of the log sets some columns
    and leaves the others as they are."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    return log.groupBy(*key).agg(*last)


def deciding(log: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The rows of a log that its current state depends on: the last row of every key, and for each of `columns` the
    rows that set it last. At most one row per key and column, if no two have the same place in `order`.

    They are rows of the log as they were, so the state is the same with these rows instead of the log or beside
    it, and stays the same whatever is appended later, late rows included.
    """
    at = F.struct(*order)
    rows = log.withColumn("_key", F.struct(*key))
    last = rows.groupBy("_key").agg(
        F.count("*").alias("_size"), F.max(at).alias("_last"), *[F.max(F.when(F.col(c).isNotNull(), at)).alias(f"_last_{c}") for c in columns]
    )
    decides = [at.eqNullSafe(F.col("_last"))] + [F.col(c).isNotNull() & at.eqNullSafe(F.col(f"_last_{c}")) for c in columns]
    found = join_groups(rows, last, "_key", "_size").filter(reduce(lambda a, b: a | b, decides))
    return found.select(*log.columns).distinct()
