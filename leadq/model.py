"""Learned scorer: an alternative to the rule score, trained on labelled features."""

from __future__ import annotations

import math

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadq import schema as S
from leadq.functions.scoring import rule_score
from leadq.functions.signals import feature_columns
from leadq.operators.score import with_signals
from leadq.session import staged


def _uniform(key: Column, name: str) -> Column:
    """A draw in (0, 1) fixed by the key: 32 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(name), key.cast("string"))), 1, 8), 16, 10).cast("double")
    return (bits + 0.5) / 4294967296.0


def training_set(leads: DataFrame, noise: float = 1.5) -> DataFrame:
    """Features and a stand-in label: the rule score with a little normal noise, within 0..100.
    Swap the label for real outcomes once there are any."""
    flags = F.col("_signals")
    normal = F.sqrt(-2 * F.log(_uniform(F.col("ord"), "a"))) * F.cos(_uniform(F.col("ord"), "b") * (2 * 3.141592653589793))
    label = F.greatest(F.lit(0.0), F.least(F.lit(100.0), rule_score(flags) + normal * noise))
    return with_signals(leads).select("ord", *feature_columns(flags), label.alias("label"))


def assemble(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=S.FEATURES, outputCol="features").transform(features)


def hold_out(training: DataFrame, percent: int = 20) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, split by a hash of `ord` and so the same on every run."""
    draw = F.pmod(F.xxhash64("ord"), F.lit(100))
    return training.filter(draw >= percent), training.filter(draw < percent)


#: Boosting as published: 300 rounds of small steps.
ROUNDS, STEP = 300, 0.05
#: Spark takes thresholds from about the square of its bins in rows, and holds that square in 31 bits.
BINS, MOST_BINS = 32, 46_340
#: Each of some 1,200 passes ends in as many tasks as it began with, so tasks grow with the root of the rows, up to so many rows each.
ROOT_ROWS, TASK_ROWS = 10_000, 1_000_000


def _dealt(training: DataFrame, rows: int) -> DataFrame:
    """Rows in an order that follows from them alone, by a hash of `ord`, so that each round draws the same ones on every run."""
    tasks = max(1, math.isqrt(rows // ROOT_ROWS), math.ceil(rows / TASK_ROWS))
    return training.repartition(tasks, *training.columns).sortWithinPartitions(F.xxhash64("ord", F.lit("draw")), *training.columns)


def train(training: DataFrame, rounds: int = ROUNDS, step: float = STEP) -> tuple[GBTRegressionModel, float]:
    """Boosted trees over all training rows and their mean absolute error on all held-out rows.

    Thresholds come from all rows too: there are bins enough that Spark doesn't sample them, and a feature has no more thresholds for
    that, as it has 24 values at most. As published, a round leaves a fifth of the rows out, others each time (`subsamplingRate`).
    """
    train_rows, test_rows = hold_out(training)
    train_rows = staged(train_rows, "labelled")
    rows = train_rows.count()
    bins = min(MOST_BINS, max(BINS, math.isqrt(rows) + 1))
    trees = GBTRegressor(maxIter=rounds, maxDepth=4, stepSize=step, subsamplingRate=0.8, seed=42, maxBins=bins)
    model = trees.fit(assemble(_dealt(train_rows, rows)).select("features", "label"))
    error = RegressionEvaluator(metricName="mae").evaluate(model.transform(assemble(test_rows)))
    return model, error


def predict(model: GBTRegressionModel, leads: DataFrame) -> DataFrame:
    """Add `prediction` to leads; pass it to `operators.score.score` as the model column."""
    flags = F.col("_signals")
    names = {c: f"_f_{c}" for c in S.FEATURES}
    df = with_signals(leads)
    df = df.withColumns({names[n]: c for n, c in zip(S.FEATURES, feature_columns(flags))})
    df = VectorAssembler(inputCols=list(names.values()), outputCol="features").transform(df)
    return model.transform(df).drop("features", "_signals", *names.values())
