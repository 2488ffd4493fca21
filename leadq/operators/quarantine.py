"""Rows that could not be read: kept with the reason, so that one bad row never sinks a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadq.operators.store import QUARANTINE


def entries(bad: DataFrame, source: str, raw: Column, reason: Column, message: Column, retries: int = 0) -> DataFrame:
    return bad.select(
        F.lit(source).alias("source"),
        raw.alias("raw_data"),
        reason.alias("reason"),
        message.alias("error_message"),
        F.lit(retries).alias("retries_used"),
    )


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], QUARANTINE)
