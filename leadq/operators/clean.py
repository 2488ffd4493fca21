"""Cleaning of mapped records."""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadq import schema as S
from leadq.functions import cleaning as C
from leadq.functions.strings import strip

# Text columns of a mapped record and the scratch columns of a cleaning step.
_WORDS, _FIRST_WORDS, _DIGITS, _EMAIL, _TIME, _ISO = "_words", "_first_words", "_digits", "_email", "_time", "_iso"
_FOREIGN, _US = "_foreign", "_us"


def with_columns_missing_as_null(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    return df.withColumns({n: F.lit(None).cast("string") for n in missing}) if missing else df


#: What a field takes to be cleaned: columns by name, step after step. A step reads what earlier ones made.
Steps = list[dict[str, Column]]


def _in_steps(df: DataFrame, *fields: Steps) -> DataFrame:
    """Clean fields side by side, in one projection per step. Each projection copies the whole row, so fields that don't read each
    other share it. Scratch columns are dropped."""
    names = df.columns
    for together in zip_longest(*fields, fillvalue={}):
        df = df.withColumns({name: column for step in together for name, column in step.items()})
    return df.drop(*[c for c in df.columns if c not in names])


def _name_steps() -> Steps:
    first_missing = F.coalesce(strip(F.col("first_name")), F.lit("")) == ""
    last_missing = F.coalesce(strip(F.col("last_name")), F.lit("")) == ""
    several = F.coalesce(F.size(_FIRST_WORDS) > 1, F.lit(False))
    return [
        {_WORDS: F.when(first_missing | last_missing, C.name_words(F.col("full_name")))},
        {
            "first_name": F.when(first_missing, C.first_word(F.col(_WORDS))).otherwise(F.col("first_name")),
            "last_name": F.when(last_missing, C.rest_of_words(F.col(_WORDS))).otherwise(F.col("last_name")),
        },
        {_FIRST_WORDS: F.when(F.coalesce(F.col("last_name"), F.lit("")) == "", C.name_words(F.col("first_name")))},
        {
            "first_name": F.when(several, C.first_word(F.col(_FIRST_WORDS))).otherwise(F.col("first_name")),
            "last_name": F.when(several, C.rest_of_words(F.col(_FIRST_WORDS))).otherwise(F.col("last_name")),
        },
    ]


def _phone_steps(column: str = "phone_e164") -> Steps:
    return [
        {_DIGITS: strip(F.col(column))},
        {_DIGITS: C.phone_digits(F.col(_DIGITS))},
        {_FOREIGN: C.foreign_digits(F.col(_DIGITS))},
        {_US: C.us_digits(F.col(_DIGITS), F.col(_FOREIGN))},
        {column: C.e164(F.col(_US), F.col(_FOREIGN))},
    ]


def _email_steps(column: str = "email") -> Steps:
    return [
        {_EMAIL: C.email_text(F.col(column))},
        {_EMAIL: C.valid_email(F.col(_EMAIL))},
        {column: C.fix_email_domain(F.col(_EMAIL))},
    ]


def _time_steps(column: str = "created_at", epoch_text: bool = True) -> Steps:
    """In steps, so that each one is small generated code and done once per row."""
    return [
        {_TIME: strip(F.col(column))},
        {_ISO: C.year_first(F.col(_TIME))},
        {_ISO: C.month_as_number(F.col(_ISO))},
        {column: C.timestamp_from_iso(F.col(_ISO), F.col(_TIME), epoch_text)},
    ]


def _consent_steps(column: str = "consent") -> Steps:
    return [{column: F.lower(strip(F.col(column)))}, {column: C.consent_from_text(F.col(column))}]


def rescue_names(df: DataFrame) -> DataFrame:
    """Fill missing first and last names from the full name, then split a first name of several
    words that came without a last name."""
    df = with_columns_missing_as_null(df, ["full_name", "first_name", "last_name"])
    return _in_steps(df, _name_steps()).drop("full_name")


def clean_phone(df: DataFrame, column: str = "phone_e164") -> DataFrame:
    return _in_steps(df, _phone_steps(column))


def clean_email(df: DataFrame, column: str = "email") -> DataFrame:
    return _in_steps(df, _email_steps(column))


def clean_timestamp(df: DataFrame, column: str = "created_at", epoch_text: bool = True) -> DataFrame:
    return _in_steps(df, _time_steps(column, epoch_text))


def clean_leads(df: DataFrame, epoch_text: bool = True) -> DataFrame:
    """Normalise the canonical text columns of mapped records; every other column is kept.

    Native expressions only: one projection without a shuffle or a Python worker.
    """
    df = with_columns_missing_as_null(df, S.MAPPED_FIELDS)
    return _in_steps(df, _name_steps(), _phone_steps(), _email_steps(), _time_steps(epoch_text=epoch_text), _consent_steps()).drop("full_name")


def check_contract(df: DataFrame) -> DataFrame:
    """Fail early, before any job runs, when a cleaned frame lacks a column or has a wrong type."""
    expected = {
        "first_name": T.StringType(), "last_name": T.StringType(), "email": T.StringType(),
        "phone_e164": T.StringType(), "campaign_id": T.StringType(), "consent": T.BooleanType(),
        "created_at": T.TimestampType(),
    }
    found = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{name}: expected {t.simpleString()}, found {found[name].simpleString() if name in found else 'nothing'}"
        for name, t in expected.items()
        if found.get(name) != t
    ]
    if wrong:
        raise ValueError("cleaned frame breaks its contract: " + "; ".join(wrong))
    return df


def contract_report(df: DataFrame) -> DataFrame:
    """Row-level side of the contract: one row per check with the number of rows that break it."""
    checks = {
        "consent is set": F.col("consent").isNull(),
        "email is lower case": F.col("email") != F.lower("email"),
        "phone is E.164": ~F.col("phone_e164").rlike(r"^\+[1-9][0-9]{6,14}$"),
    }
    counts = check_contract(df).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return counts.unpivot([], [F.col(f"`{n}`").alias(n) for n in checks], "check_name", "broken_rows")
