"""Score, band and text explanation of a lead, from its signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadq import schema as S


def rule_score(flags: Column) -> Column:
    """Weighted sum of the signals, kept within 0..100."""
    points = [F.when(flags[name], weight).otherwise(0) for name, weight in S.SCORE_WEIGHTS.items()]
    total = reduce(lambda a, b: a + b, points)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total.cast("double")))


def final_score(rule: Column, model: Column | None = None) -> Column:
    """Two decimals; the model's answer goes first where there is one."""
    if model is None:
        return F.bround(rule, 2)
    kept = F.greatest(F.lit(0.0), F.least(F.lit(100.0), model.cast("double")))
    return F.bround(F.coalesce(F.when(model.isNotNull(), kept), rule), 2)


def shown_score(score: Column) -> Column:
    return F.bround(score, 0).cast("int")


def band(score: Column) -> Column:
    """Band of the whole number a person sees."""
    return F.when(shown_score(score) >= 70, "High").when(shown_score(score) >= 40, "Medium").otherwise("Low")


def band_or_unscored(score: Column) -> Column:
    return F.when(score.isNull(), "Unscored").otherwise(band(score))


def _phrases(*rules: tuple[Column, Column | str]) -> list[Column]:
    return [F.when(when, F.lit(text) if isinstance(text, str) else text) for when, text in rules]


def listed(phrases: list[Column]) -> Column:
    return F.array_compact(F.array(*phrases))


def joined(phrases: list[Column]) -> Column:
    """What `listed` holds, as one text; '' for none. No list is built."""
    return F.concat_ws(", ", *phrases)


def strengths(flags: Column, campaign_id: Column) -> list[Column]:
    """Phrases, each NULL unless it holds."""
    company = (
        flags["has_email"]
        & ~flags["email_is_free_provider"]
        & ~flags["email_is_disposable"]
        & ~flags["email_is_placeholder_like"]
    )
    return _phrases(
        (flags["consent"], "opted in to contact"),
        (company, "non-personal email domain"),
        (flags["has_email"] & flags["has_phone"], "both email and phone captured"),
        (flags["has_campaign_id"], F.concat(F.lit("attributed to campaign '"), campaign_id, F.lit("'"))),
    )


def concerns(flags: Column) -> list[Column]:
    return _phrases(
        (~flags["has_email"] & ~flags["has_phone"], "no email or phone on file"),
        (~flags["consent"], "no marketing consent captured"),
        (flags["email_is_disposable"], "disposable/throwaway email domain"),
        (flags["email_is_placeholder_like"], "placeholder-looking email (e.g. test@)"),
        (flags["name_is_placeholder_like"], "placeholder or keyboard-mash name"),
        (flags["phone_is_placeholder"], "unverifiable 555 phone number"),
        (flags["email_is_free_provider"], "personal (free) email, not a company domain"),
        (~flags["has_first_name"] & ~flags["has_last_name"], "no name captured"),
    )


def diagnosis(score: Column, positive: Column, negative: Column) -> Column:
    """`positive` and `negative` are joined phrases."""
    opening = F.when(score.isNull(), "Not yet scored.").otherwise(
        F.concat(band(score), F.lit("-quality lead (score "), shown_score(score).cast("string"), F.lit(")."))
    )
    return F.concat_ws(
        " ",
        opening,
        F.when(positive != "", F.concat(F.lit("Strengths: "), positive, F.lit("."))),
        F.when(negative != "", F.concat(F.lit("Concerns: "), negative, F.lit("."))),
        F.when(
            (positive == "") & (negative == ""),
            "No standout signals either way -- an ordinary, complete lead.",
        ),
    )


def suggested_action(score: Column, flags: Column) -> Column:
    """What to do next. A lead nobody can reach or that looks fake is not judged by its score."""
    tier = band(F.coalesce(score, F.lit(0.0)))
    by_tier = (
        F.when(tier == "High", "Contact within 24 hours -- high-quality, prioritize for a rep.")
        .when(tier == "Medium", "Add to an email nurture sequence; escalate to a rep if they engage.")
        .otherwise("Deprioritize -- low quality, not worth rep time right now.")
    )
    no_consent = F.when(
        ~flags["consent"], " No consent on file: do not cold-call (TCPA), email only with a lawful basis."
    ).otherwise("")
    fake = flags["email_is_disposable"] | flags["email_is_placeholder_like"] | flags["name_is_placeholder_like"]
    return (
        F.when(
            ~flags["has_email"] & ~flags["has_phone"],
            "Do not action yet -- no email or phone captured. "
            "Check the source form for a broken or unmapped contact field.",
        )
        .when(
            fake,
            "Verify before any outreach -- the email or name looks fake or test-generated. "
            "Confirm this is a real person before a rep spends time on it.",
        )
        .otherwise(F.concat(by_tier, no_consent))
    )


def needs_flag(flags: Column) -> Column:
    return (
        flags["email_is_disposable"]
        | flags["email_is_placeholder_like"]
        | flags["name_is_placeholder_like"]
        | flags["phone_is_placeholder"]
        | (~flags["has_email"] & ~flags["has_phone"])
    )


def completeness(c=F.col) -> Column:
    fields = ["first_name", "last_name", "email", "phone_e164", "campaign_id"]
    return reduce(lambda a, b: a + b, [F.when(c(f) != "", 1).otherwise(0) for f in fields])
