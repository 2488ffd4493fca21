"""Validation: repair what can be repaired, reject only what has no place in the schema."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadq import schema as S
from leadq.functions import cleaning as C

PHONE_PATTERN = r"^\+[1-9][0-9]{6,14}$"


@dataclass
class Validated:
    valid: DataFrame
    invalid: DataFrame


def lead_id(dataset_id: Column, source: Column, ord_: Column) -> Column:
    """Stable id: the same submission gets the same id whenever it is computed."""
    return F.sha2(F.concat_ws(":", dataset_id, source, ord_.cast("string")), 256)


def _error(when: Column, field: str, message: str, kind: str) -> tuple[Column, Column]:
    found = F.coalesce(when, F.lit(False))
    return found, F.when(found, F.struct(F.array(F.lit(field)).alias("loc"), F.lit(message).alias("msg"), F.lit(kind).alias("type")))


def errors_column(not_text: Column, cleaned: bool = False) -> Column:
    """Errors of a record. `not_text` lists the text fields that arrived as a JSON number, bool,
    list or object. The phone of a cleaned record is in form by construction; leaving its check
    out keeps a filter on the errors a matter of two input columns."""
    checks = [
        _error(F.array_contains(not_text, f), f, "Input should be a valid string", "string_type")
        for f in ("first_name", "last_name", "campaign_id")
    ]
    if not cleaned:
        phone_form = F.col("phone_e164").rlike(PHONE_PATTERN)
        message = "String should match pattern '^\\+[1-9]\\d{6,14}$'"
        checks.insert(2, _error(~phone_form, "phone_e164", message, "string_pattern_mismatch"))
    expected = ", ".join(f"'{s}'" for s in S.SOURCES[:-1]) + f" or '{S.SOURCES[-1]}'"
    checks.insert(-1, _error(~F.coalesce(F.col("source").isin(S.SOURCES), F.lit(False)), "source", f"Input should be {expected}", "enum"))
    some = reduce(lambda a, b: a | b, [found for found, _ in checks])  # most records have none: no list is put together for them
    return F.when(some, F.array_compact(F.array(*[error for _, error in checks]))).otherwise(F.array().cast(T.ArrayType(S.ERROR)))


def validate(df: DataFrame, batch_ts: Column, cleaned: bool = False) -> DataFrame:
    """One projection: repaired fields, `lead_id` and the list of `errors`.

    `batch_ts` stands in for a missing timestamp, the same for the whole batch. `cleaned` says
    that emails and phones come from `clean_leads` and need no second check.
    """
    not_text = F.col("not_text") if "not_text" in df.columns else F.array().cast("array<string>")
    if "raw_payload" not in df.columns:
        df = df.withColumn("raw_payload", F.lit(None).cast("string"))
    df = df.withColumn("errors", errors_column(not_text, cleaned))
    return df.withColumns(
        {
            "lead_id": lead_id(F.col("dataset_id"), F.col("source"), F.col("ord")),
            "first_name": C.usable_name(F.col("first_name")),
            "last_name": C.usable_name(F.col("last_name")),
            "email": F.col("email") if cleaned else C.valid_email(C.email_text(F.col("email"))),
            "consent": F.coalesce(F.col("consent"), F.lit(False)),
            "created_at": F.coalesce(F.col("created_at"), batch_ts),
        }
    )


def split(validated: DataFrame) -> Validated:
    """Valid leads, and rejected records with their errors; both come from the same projection."""
    ok = F.size("errors") == 0
    valid = validated.filter(ok).drop("errors", "not_text")
    record = F.to_json(
        F.struct("first_name", "last_name", "email", "phone_e164", "campaign_id", "consent", "created_at", "raw_payload")
    )
    invalid = validated.filter(~ok).select(
        "ord", "source", record.alias("record"), F.to_json("errors").alias("errors"), "dataset_id"
    )
    return Validated(valid, invalid)


def valid_rate(validated: DataFrame) -> DataFrame:
    """Share of valid records, 0 for an empty frame."""
    rate = F.coalesce(F.avg(F.when(F.size("errors") == 0, 1.0).otherwise(0.0)), F.lit(0.0))
    return validated.agg(rate.alias("valid_rate"), F.count("*").alias("records"))
