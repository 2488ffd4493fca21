"""Aggregates over the lead tables: per source, per score band, per outcome.

Every figure is a conditional aggregate with a map-side combine, so a source that holds most
of the rows costs one partial row per task. Tables are put side by side with a union before
one aggregate, not joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadq import schema as S
from leadq.functions.scoring import band, band_or_unscored
from leadq.functions.strings import present

SIGNALS = ["email", "phone", "consent", "campaign", "name"]
METRICS = ["total", "clean", "flagged", "scored", "sum_score"] + SIGNALS


def _metrics() -> list[Column]:
    """Counts and score sum of a group of leads. Scores have two decimals, so the sum is exact
    in hundredths whatever the order of the rows."""
    c = F.col
    return [
        F.count("*").alias("total"),
        F.count_if(c("status") == S.CLEAN).alias("clean"),
        F.count_if(c("status") == S.FLAGGED).alias("flagged"),
        F.count("quality_score").alias("scored"),
        _score_sum().alias("sum_score"),
        F.count_if(present(c("email"))).alias("email"),
        F.count_if(present(c("phone_e164"))).alias("phone"),
        F.count_if(c("consent")).alias("consent"),
        F.count_if(present(c("campaign_id"))).alias("campaign"),
        F.count_if(present(c("first_name"))).alias("name"),
    ]


def _score_sum() -> Column:
    cents = F.bround(F.col("quality_score") * 100, 0).cast("long")
    return F.coalesce(F.sum(cents), F.lit(0)).cast("double") / 100


def _average(digits: int) -> Column:
    cents = F.bround(F.col("quality_score") * 100, 0).cast("long")
    return F.bround(F.sum(cents) / F.count(cents) / 100, digits)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.bround(part * 100.0 / whole, digits)).otherwise(0.0)


def by_source(leads: DataFrame) -> DataFrame:
    return leads.groupBy("source").agg(*_metrics())


def rollup_metrics(leads: DataFrame) -> DataFrame:
    """Metrics per source plus one row for all sources together."""
    grouped = leads.rollup("source").agg(F.grouping("source").alias("_all"), *_metrics())
    name = F.when(F.col("_all") == 1, "All sources").otherwise(F.col("source"))
    return grouped.withColumn("source", name).drop("_all")


def score_buckets(leads: DataFrame) -> DataFrame:
    bucket = F.floor(F.col("quality_score") / 10).cast("long")
    return (
        leads.filter(F.col("quality_score").isNotNull())
        .groupBy("source", "status", bucket.alias("bucket"))
        .agg(F.count("*").alias("leads"))
    )


def count_by_source(rows: DataFrame) -> DataFrame:
    """Bars: rows per source, most first."""
    return rows.groupBy("source").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "source")


def _outcomes(leads: DataFrame, duplicates: DataFrame, invalid: DataFrame) -> DataFrame:
    """Leads, duplicates and rejects as one slim frame with the outcome of every row."""
    nothing = F.lit(None).cast("double")
    return (
        leads.select("source", F.col("status").alias("outcome"), "quality_score", F.col("dataset_id"))
        .unionByName(
            duplicates.select("source", F.lit("duplicate").alias("outcome"), nothing.alias("quality_score"), "dataset_id")
        )
        .unionByName(
            invalid.select("source", F.lit("invalid").alias("outcome"), nothing.alias("quality_score"), "dataset_id")
        )
    )


def _outcome(name: str) -> Column:
    return F.count_if(F.col("outcome") == name)


def _kept() -> Column:
    return F.count_if(F.col("outcome").isin(S.CLEAN, S.FLAGGED))


def stats(leads: DataFrame, duplicates: DataFrame, invalid: DataFrame, healing: DataFrame, review: DataFrame) -> DataFrame:
    """Totals over all tables in one row; an average of 0 is shown as NULL."""
    nothing = F.lit(None).cast("double")
    others = [
        t.select(F.lit("").alias("source"), F.lit(name).alias("outcome"), nothing.alias("quality_score"), F.lit("").alias("dataset_id"))
        for name, t in (("healing", healing), ("review", review))
    ]
    rows = _outcomes(leads, duplicates, invalid).unionByName(others[0]).unionByName(others[1])
    average = _average(2)
    return rows.agg(
        _outcome("clean").alias("total_clean"),
        _outcome("flagged").alias("total_flagged"),
        _outcome("invalid").alias("total_invalid"),
        _outcome("duplicate").alias("total_duplicates"),
        average.alias("avg_quality_score"),
        _outcome("healing").alias("self_healing_events"),
        _outcome("review").alias("human_review_pending"),
    ).withColumn("avg_quality_score", F.expr("nullif(avg_quality_score, 0.0)"))


def source_performance(leads: DataFrame, duplicates: DataFrame, invalid: DataFrame) -> DataFrame:
    """Scorecard per source: volume, average score, and the share of all its rows that were
    rejected. Best average first, sources without a score last."""
    card = (
        _outcomes(leads, duplicates, invalid)
        .groupBy("source")
        .agg(
            _kept().alias("leads"),
            _outcome("clean").alias("clean"),
            _outcome("flagged").alias("flagged"),
            _outcome("invalid").alias("invalid"),
            _outcome("duplicate").alias("duplicates"),
            _average(1).alias("avg_score"),
            F.count("*").alias("_all"),
        )
    )
    return (
        card.withColumn("junk_percentage", percent(F.col("invalid"), F.col("_all")))
        .drop("_all")
        .orderBy(F.desc_nulls_last("avg_score"), "source")
    )


def best_worst_source(performance: DataFrame) -> DataFrame:
    """Best average score and highest junk share; the first in the scorecard wins a tie."""
    order = F.struct(F.coalesce("avg_score", F.lit(-1.0)).alias("avg"), _reversed("source"))
    junk = F.struct(F.col("junk_percentage"), F.coalesce("avg_score", F.lit(-1.0)).alias("avg"), _reversed("source"))
    return performance.agg(
        F.max_by("source", F.when(F.col("avg_score").isNotNull(), order)).alias("best_source"),
        F.max("avg_score").alias("best_avg_score"),
        F.max_by("source", junk).alias("worst_source"),
        F.max("junk_percentage").alias("worst_junk_percentage"),
    )


def _reversed(name: str) -> Column:
    """Sort key that puts an alphabetically earlier source higher."""
    codes = F.transform(F.split(F.col(name), ""), lambda ch: -F.ascii(ch))
    return F.concat(codes, F.array(F.lit(1))).alias("first")


def kpis(leads: DataFrame) -> DataFrame:
    """Headline figures; the high share counts score buckets from 70 on."""
    high = F.count_if(F.floor(F.col("quality_score") / 10).between(7, 10))
    return leads.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == S.CLEAN).alias("clean"),
        F.count_if(F.col("status") == S.FLAGGED).alias("flagged"),
        F.round(_score_sum() / F.expr("nullif(count(quality_score), 0)"), 0).cast("long").alias("avg"),
        F.when(F.count("quality_score") > 0, F.round(high * 100.0 / F.count("quality_score"), 1))
        .otherwise(0.0)
        .alias("high_pct"),
        F.count("quality_score").alias("scored"),
    )


BUTTERFLY = [("80–100", 8, 10), ("70–79", 7, 7), ("60–69", 6, 6), ("50–59", 5, 5), ("40–49", 4, 4), ("0–39", 0, 3)]
FIVE_BUCKETS = [("0–19", 0, 1), ("20–39", 2, 3), ("40–59", 4, 5), ("60–79", 6, 7), ("80–100", 8, 10)]


def status_by_band(leads: DataFrame, bands: list[tuple[str, int, int]], name: str = "band") -> DataFrame:
    """Clean and flagged leads per band of score buckets; an empty band is a row of zeros."""
    bucket = F.floor(F.col("quality_score") / 10)
    aggregates = []
    for label, lo, hi in bands:
        inside = bucket.between(lo, hi)
        is_flagged = F.coalesce(F.col("status") == S.FLAGGED, F.lit(False))
        aggregates.append(
            F.struct(
                F.lit(label).alias(name),
                F.count_if(inside & ~is_flagged).alias("clean"),
                F.count_if(inside & is_flagged).alias("flagged"),
            ).alias(label)
        )
    row = leads.agg(*aggregates)
    return row.select(F.inline(F.array(*[F.col(f"`{label}`") for label, _, _ in bands])))


def histogram(leads: DataFrame, width: int = 5) -> DataFrame:
    start = (F.floor(F.col("quality_score") / width) * width).cast("long")
    return (
        leads.filter(F.col("quality_score").isNotNull())
        .groupBy(start.alias("bin_start"), "status")
        .agg(F.count("*").alias("leads"))
    )


def average_by_source(leads: DataFrame) -> DataFrame:
    return (
        leads.filter(F.col("quality_score").isNotNull())
        .groupBy("source")
        .agg(_average(1).alias("avg_score"))
        .orderBy("avg_score", "source")
    )


def quality_funnel(leads: DataFrame) -> DataFrame:
    """Leads per priority band, with their share of all scored leads and of the top band."""
    bucket = F.floor(F.col("quality_score") / 10)
    row = leads.agg(
        F.count("quality_score").alias("scored"),
        F.count_if(bucket.between(7, 10)).alias("high"),
        F.count_if(bucket.between(4, 6)).alias("medium"),
        F.count_if(bucket.between(0, 3)).alias("low"),
    )
    counts = row.unpivot(["scored", F.col("high").alias("of_high")], ["high", "medium", "low"], "band", "leads")
    step = F.when(F.col("of_high") > 0, F.round(F.col("leads") * 100.0 / F.col("of_high"), 0)).otherwise(100.0)
    return counts.select(
        "band",
        "leads",
        F.when(F.col("scored") > 0, F.round(F.col("leads") * 100.0 / F.col("scored"), 1)).otherwise(0.0).alias("pct_of_scored"),
        step.alias("pct_of_high"),
    )


def signal_completeness(leads: DataFrame, top: int | None = 3) -> DataFrame:
    """Share of leads per source that carry each signal, for the largest sources."""
    sources = by_source(leads)
    if top is not None:
        sources = sources.orderBy(F.desc("total"), "source").limit(top)
    long = sources.select("source", "total", *SIGNALS).unpivot(["source", "total"], SIGNALS, "signal", "leads")
    return long.select("source", "signal", F.round(F.col("leads") * 100.0 / F.col("total"), 0).cast("long").alias("pct"))


def scored_completeness(leads: DataFrame) -> DataFrame:
    """The same for every source, over its scored leads: a signal is there if its field has any value."""
    scored = leads.filter(F.col("quality_score").isNotNull() & F.col("source").isNotNull())
    fields = {"email": "email", "phone": "phone_e164", "campaign": "campaign_id", "name": "first_name"}
    shares = [F.count(c).alias(n) for n, c in fields.items()] + [F.count_if("consent").alias("consent")]
    counts = scored.groupBy("source").agg(F.count("*").alias("total"), *shares)
    long = counts.unpivot(["source", "total"], [*fields, "consent"], "signal", "leads")
    return long.select("source", "signal", F.round(F.col("leads") * 100.0 / F.col("total"), 0).cast("long").alias("pct"))


def top_failures(invalid: DataFrame, limit: int = 8) -> DataFrame:
    """Most frequent reasons for a rejected row."""
    errors = F.from_json("errors", "array<struct<loc:array<string>,msg:string>>")
    reason = F.concat(
        F.coalesce(F.array_join("e.loc", "."), F.lit("unknown field")),
        F.lit(": "),
        F.coalesce("e.msg", F.lit("invalid value")),
    )
    return (
        invalid.select(F.explode(errors).alias("e"))
        .groupBy(reason.alias("reason"))
        .agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "reason")
        .limit(limit)
    )


def compliance_gaps(leads: DataFrame) -> DataFrame:
    row = leads.agg(
        F.count("*").alias("total"),
        F.count_if(~F.coalesce(F.col("consent"), F.lit(False))).alias("no marketing consent"),
        F.count_if(~present(F.col("campaign_id"))).alias("no campaign tag"),
    )
    gaps = row.unpivot(["total"], ["no marketing consent", "no campaign tag"], "gap", "leads")
    return gaps.select("gap", "leads", percent(F.col("leads"), F.col("total")).alias("pct"))


def outcome_split(leads: DataFrame, duplicates: DataFrame, invalid: DataFrame) -> DataFrame:
    names = ["clean", "flagged", "duplicate", "invalid"]
    row = _outcomes(leads, duplicates, invalid).agg(F.count("*").alias("total"), *[_outcome(n).alias(n) for n in names])
    split = row.unpivot(["total"], names, "outcome", "rows")
    return split.select("outcome", "rows", percent(F.col("rows"), F.col("total")).alias("pct"))


def overview_totals(leads: DataFrame, duplicates: DataFrame, invalid: DataFrame) -> DataFrame:
    """Rows processed and number of sources with leads. The sources are counted after grouping,
    so no task holds more than a few of them."""
    rows = _outcomes(leads, duplicates, invalid)
    per_source = rows.groupBy("source").agg(
        F.count("*").alias("rows"), F.max(F.col("outcome").isin(S.CLEAN, S.FLAGGED)).alias("has_leads")
    )
    return per_source.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("processed"),
        F.count_if("has_leads").alias("connected_sources"),
    )


def filtered_kpis(leads: DataFrame) -> DataFrame:
    """Figures above a filtered lead table."""
    scored = leads.filter(F.col("quality_score").isNotNull())
    return scored.agg(
        F.count("*").alias("scored"),
        F.count_if(F.col("quality_score") >= 70).alias("high"),
        F.count_if(F.col("quality_score") < 40).alias("low"),
        percent(F.count_if(F.col("quality_score") >= 70), F.count("*")).alias("high_pct"),
        percent(F.count_if(F.col("quality_score") < 40), F.count("*")).alias("low_pct"),
        percent(F.count_if(F.col("consent")), F.count("*")).alias("consent_pct"),
        _average(1).alias("avg_score"),
    )


def band_counts(leads: DataFrame) -> DataFrame:
    return leads.groupBy(band_or_unscored(F.col("quality_score")).alias("band")).agg(F.count("*").alias("leads"))


def failure_types(events: DataFrame) -> DataFrame:
    return events.groupBy("exception_type").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "exception_type")


def batch_summary(leads: DataFrame, duplicates: DataFrame, invalid: DataFrame) -> DataFrame:
    """What became of a batch, per dataset."""
    return _outcomes(leads, duplicates, invalid).groupBy("dataset_id").agg(
        _kept().alias("scored"), _outcome("duplicate").alias("duplicates"), _outcome("invalid").alias("invalid")
    )
