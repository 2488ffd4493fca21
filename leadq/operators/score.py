"""Scoring, flagging and explanation of leads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadq import schema as S
from leadq.functions import scoring as R
from leadq.functions.signals import feature_columns, signals

_FLAGS = "_signals"
#: The signals of a row in one number, a bit each, for rows that are written out between being scored and being explained.
BITS = "_signal_bits"


def with_signals(df: DataFrame, name: str = _FLAGS) -> DataFrame:
    """Signals in one struct column, so that the rules built on them share one evaluation."""
    return df.withColumn(name, F.struct(*[c.alias(n) for n, c in signals().items()]))


def _packed(flags: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(flags[n], F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(signals())])


def _unpacked(bits: Column) -> Column:
    return F.struct(*[(bits.bitwiseAND(F.lit(1 << i)) != 0).alias(n) for i, n in enumerate(signals())])


def features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    flagged = with_signals(df)
    return flagged.select(*(keep or ["ord"]), *feature_columns(F.col(_FLAGS)))


def score(df: DataFrame, model: Column | None = None, keep: bool = False) -> DataFrame:
    """Add `quality_score`; `model` is an optional column with a trained model's prediction. With `keep` the signals stay, as `BITS`, for `finish`."""
    flagged = with_signals(df)
    scored = flagged.withColumn("quality_score", R.final_score(R.rule_score(F.col(_FLAGS)), model))
    return (scored.withColumn(BITS, _packed(F.col(_FLAGS))) if keep else scored).drop(_FLAGS)


def _status(df: DataFrame) -> Column:
    start = F.when(F.col("status") == S.DUPLICATE, S.DUPLICATE) if "status" in df.columns else F
    return start.when(R.needs_flag(F.col(_FLAGS)), S.FLAGGED).otherwise(S.CLEAN)


def flag(df: DataFrame) -> DataFrame:
    """Set the status of kept leads; a lead already filed as a duplicate stays one."""
    return with_signals(df).withColumn("status", _status(df)).drop(_FLAGS)


def explain(df: DataFrame) -> DataFrame:
    """Add `diagnosis`, `suggested_action` and the two lists of signals behind them."""
    df, flags = with_signals(df), F.col(_FLAGS)
    df = df.withColumns(
        {"positive_signals": R.listed(R.strengths(flags, F.col("campaign_id"))), "negative_signals": R.listed(R.concerns(flags))}
    )
    return _with_texts(df).drop(_FLAGS)


def _with_texts(df: DataFrame) -> DataFrame:
    flags, good, bad = F.col(_FLAGS), "_strengths", "_concerns"
    df = df.withColumns({good: R.joined(R.strengths(flags, F.col("campaign_id"))), bad: R.joined(R.concerns(flags))})
    return df.withColumns(
        {
            "diagnosis": R.diagnosis(F.col("quality_score"), F.col(good), F.col(bad)),
            "suggested_action": R.suggested_action(F.col("quality_score"), flags),
        }
    ).drop(good, bad)


def finish(df: DataFrame) -> DataFrame:
    """Status and texts of resolved leads, from one evaluation of the signals, or from those that `score` kept."""
    flagged = df.withColumn(_FLAGS, _unpacked(F.col(BITS))) if BITS in df.columns else with_signals(df)
    return _with_texts(flagged.withColumn("status", _status(df))).drop(_FLAGS, BITS)


def rescore(df: DataFrame) -> DataFrame:
    """Score, status and texts of stored leads under the current rules; all other columns stay."""
    return finish(score(df)).select(*df.columns)
