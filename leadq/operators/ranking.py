"""Ranked lists, search and the call queue over stored leads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadq import schema as S
from leadq.operators.store import scoped, with_disposition
from leadq.functions.scoring import concerns, listed, strengths
from leadq.operators.score import with_signals

SCORE_RANGES = {"all": (None, None), "high": (70, 100), "medium": (40, 69), "low": (0, 39)}


def scored_leads(
    leads: DataFrame,
    source: str | None = None,
    min_score: float | None = None,
    max_score: float | None = None,
    dataset_id: str | None = None,
) -> DataFrame:
    out = scoped(leads, dataset_id).filter(F.col("quality_score").isNotNull())
    if source:
        out = out.filter(F.col("source") == source)
    if min_score is not None:
        out = out.filter(F.col("quality_score") >= min_score)
    if max_score is not None:
        out = out.filter(F.col("quality_score") <= max_score)
    return out


def _best_first():
    return [F.col("quality_score").desc(), F.col("ord")]


def top_leads(leads: DataFrame, limit: int = 8, **filters) -> DataFrame:
    """Highest score first, the earlier submission among equals. Each task keeps `limit` rows."""
    return scored_leads(leads, **filters).orderBy(*_best_first()).limit(limit).select("ord", *S.VIEW_COLUMNS)


def ranked_page(
    leads: DataFrame, limit: int = 10, offset: int = 0, after: tuple[float, int] | None = None, **filters
) -> DataFrame:
    """One page of the ranking, with the true number of matches in `total`.

    `offset` counts from the top, as page buttons do. To walk far down a large table, pass the
    last row's `(quality_score, ord)` as `after` instead: then no task keeps more than a page.
    """
    matches = scored_leads(leads, **filters)
    total = matches.select(F.count("*")).scalar()
    page = matches
    if after is not None:
        score, last = after
        page = page.filter(
            (F.col("quality_score") < score) | ((F.col("quality_score") == score) & (F.col("ord") > last))
        )
    page = page.orderBy(*_best_first()).offset(offset).limit(limit)
    return page.select("ord", *S.VIEW_COLUMNS).withColumn("total", total)


def matching(
    leads: DataFrame,
    q: str | None = None,
    source: str | None = None,
    min_score: float | None = None,
    flagged: bool | None = None,
    dataset_id: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Case-insensitive substring match on names and email, with optional filters. As in LIKE,
    '%' and '_' in `q` are wildcards unless `literal`."""
    out = scoped(leads, dataset_id)
    if q and q.strip():
        needle = q.strip().lower()
        hit = F.lit(False)
        for c in ("first_name", "last_name", "email"):
            text = F.lower(F.col(c))
            found = text.contains(needle) if literal else text.like(f"%{needle}%")
            hit = hit | F.coalesce(found, F.lit(False))
        out = out.filter(hit)
    if source:
        out = out.filter(F.col("source") == source)
    if min_score is not None:
        out = out.filter(F.col("quality_score") >= min_score)
    if flagged is not None:
        out = out.filter(F.col("status") == (S.FLAGGED if flagged else S.CLEAN))
    return out


def search(leads: DataFrame, limit: int = 200, **filters) -> DataFrame:
    """Newest matches first, with the true number of matches in `total`."""
    matches = matching(leads, **filters)
    total = matches.select(F.count("*")).scalar()
    page = matches.orderBy(F.col("ord").desc()).limit(limit)
    return page.select("ord", *S.VIEW_COLUMNS).withColumn("total", total)


def preset(name: str, min_score: float = 0) -> dict:
    """Filters behind the quality presets of the lead table."""
    if name == "high":
        return {"flagged": False, "min_score": max(min_score, 70)}
    chosen = {"min_score": min_score} if min_score > 0 else {}
    return {**chosen, "flagged": True} if name == "suspicious" else chosen


def preset_counts(leads: DataFrame) -> DataFrame:
    """Number of leads behind every preset and score range, in one pass."""
    score, flagged = F.col("quality_score"), F.col("status") == S.FLAGGED
    rules = {
        "quality:high": (F.col("status") == S.CLEAN) & (score >= 70),
        "quality:suspicious": flagged,
        **{
            f"range:{name}": score.isNotNull() if lo is None else score.between(lo, hi)
            for name, (lo, hi) in SCORE_RANGES.items()
        },
    }
    counts = leads.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "preset", "leads")


def filter_leads(
    leads: DataFrame, sources: list[str], statuses: list[str], low: float = 0, high: float = 100
) -> DataFrame:
    """Leads of some sources and statuses in a score range; an unscored lead counts as 0."""
    return leads.filter(
        F.col("source").isin(sources)
        & F.col("status").isin(statuses)
        & F.coalesce("quality_score", F.lit(0.0)).between(low, high)
    )


def call_list(leads: DataFrame, dispositions: DataFrame, limit: int = 20, dataset_id: str | None = None) -> DataFrame:
    """Leads still to be called: urgent ones first, then by score."""
    queue = with_disposition(scored_leads(leads, dataset_id=dataset_id), dispositions).filter(
        F.col("disposition").isNull() | ~F.col("disposition").isin(S.CALL_LIST_HIDDEN)
    )
    urgent = F.when(F.col("disposition") == "high_priority", 0).otherwise(1)
    return queue.orderBy(urgent, *_best_first()).limit(limit).select("ord", *S.VIEW_COLUMNS, "disposition")


def without_consent(leads: DataFrame, limit: int = 25) -> DataFrame:
    """The first leads that were collected without consent."""
    return leads.filter(~F.col("consent")).orderBy("ord").limit(limit).select("ord", "first_name", "last_name", "email", "source", "quality_score", "status")


def lead_by_id(leads: DataFrame, lead_id: str) -> DataFrame:
    return leads.filter(F.col("lead_id") == lead_id).select("ord", *S.VIEW_COLUMNS)


def explained(leads: DataFrame) -> DataFrame:
    """Stored diagnosis of leads with the signals behind it as lists."""
    flags = F.col("_signals")
    return with_signals(leads).select(
        "lead_id",
        listed(strengths(flags, F.col("campaign_id"))).alias("positive_signals"),
        listed(concerns(flags)).alias("negative_signals"),
        "diagnosis", "suggested_action", "quality_score", "status",
    )
