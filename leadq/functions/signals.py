"""Quality signals of a lead, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadq import schema as S
from leadq.functions.cleaning import email_domain
from leadq.functions.strings import any_of, present, strip


def is_free_provider(email: Column) -> Column:
    return F.coalesce(F.lower(email_domain(email)).isin(S.FREE_EMAIL_DOMAINS), F.lit(False))


def is_disposable(email: Column) -> Column:
    return F.coalesce(F.lower(email_domain(email)).isin(S.DISPOSABLE_EMAIL_DOMAINS), F.lit(False))


def email_class(email: Column) -> Column:
    return (
        F.when(~present(email), "none")
        .when(is_free_provider(email), "free")
        .when(is_disposable(email), "disposable")
        .otherwise("other")
    )


def is_placeholder_email(email: Column) -> Column:
    """The part before '@' is a stock word, alone or followed by digits only."""
    pattern = rf"^(?:{any_of(S.PLACEHOLDER_EMAIL_LOCALS)})[0-9]*@"
    return F.coalesce(F.lower(email).rlike(pattern), F.lit(False))


def is_placeholder_name(name: Column) -> Column:
    return F.coalesce(F.lower(strip(name)).isin(S.PLACEHOLDER_NAMES), F.lit(False))


def is_placeholder_phone(phone: Column) -> Column:
    """A North American number in the 555 exchange."""
    return F.coalesce(phone.rlike(r"^\+1.{3}555.{4}$"), F.lit(False))


def signals() -> dict[str, Column]:
    """Boolean signals over the canonical lead columns, by feature name."""
    c = F.col
    return {
        "has_first_name": present(c("first_name")),
        "has_last_name": present(c("last_name")),
        "has_email": present(c("email")),
        "has_phone": present(c("phone_e164")),
        "has_campaign_id": present(c("campaign_id")),
        "consent": F.coalesce(c("consent"), F.lit(False)),
        "email_is_free_provider": is_free_provider(c("email")),
        "email_is_disposable": is_disposable(c("email")),
        "email_is_placeholder_like": is_placeholder_email(c("email")),
        "name_is_placeholder_like": is_placeholder_name(c("first_name")) | is_placeholder_name(c("last_name")),
        "phone_is_placeholder": is_placeholder_phone(c("phone_e164")),
    }


def feature_columns(flags: Column) -> list[Column]:
    """The 17 numeric features in their fixed order, from a struct of signals."""
    one_hot = {f"source_{s}": F.col("source") == s for s in S.SOURCES}
    out = []
    for name in S.FEATURES:
        if name == "created_hour":
            value = F.hour("created_at")
        else:
            value = F.coalesce(one_hot[name], F.lit(False)) if name in one_hot else flags[name]
        out.append(value.cast("double").alias(name))
    return out
