"""Entity resolution: leads that share an exact email or phone are one person."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadq import schema as S
from leadq.functions.scoring import completeness
from leadq.operators.graph import connected_components
from leadq.operators.keys import DATASET, GLOBAL, KeyIndex, identifiers, known_keys, scoped_key  # noqa: F401
from leadq.operators.skew import HEAVY_ROWS, join_groups
from leadq.operators.validate import lead_id
from leadq.session import cut, staged


@dataclass
class Resolved:
    kept: DataFrame
    duplicates: DataFrame


def match_keys(leads: DataFrame, scope: str = DATASET, keep: list[str] | None = None) -> DataFrame:
    """One row per lead and identifier: `ord`, `key`, kept columns. Missing identifiers give no row."""
    world = F.col("dataset_id") if scope == DATASET else F.lit(None).cast("string")
    each = identifiers(leads, "ord", *(keep or []), world.alias("_dataset"))
    return each.select("ord", *(keep or []), scoped_key(F.col("kind"), F.col("value"), F.col("_dataset"), scope).alias("key"))


def shared_keys(keys: DataFrame) -> DataFrame:
    """Identifiers that occur on several leads, with their first lead and their size.
    The aggregate combines on the map side, so a hot identifier is one row per task."""
    return (
        keys.groupBy("key").agg(F.min("ord").alias("first_ord"), F.count("*").alias("size")).filter("size > 1")
    )


def match_edges(leads: DataFrame, scope: str = DATASET, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """`(ord, first_ord)` for every lead that shares an identifier: edges of a star per
    identifier, so n leads with one identifier give n edges."""
    keys = match_keys(leads, scope)
    return join_groups(keys, shared_keys(keys), "key", "size", heavy_rows).select("ord", "first_ord")


def components(leads: DataFrame, scope: str = DATASET, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """`(ord, component)` of all leads that share an identifier; component is the first `ord`.

    A lead touches at most two identifiers, each named by its first lead. Only a lead whose
    two identifiers differ ties them together, so the graph that is iterated on has one node per
    shared identifier rather than one per lead.
    """
    links = cut(
        match_edges(leads, scope, heavy_rows)
        .groupBy("ord")
        .agg(F.min("first_ord").alias("a"), F.max("first_ord").alias("b"))
    )
    edges = links.filter("a < b").select("a", "b")
    groups = connected_components(edges, heavy_rows)
    sizes = links.groupBy("a").agg(F.count("*").alias("size"))
    roots = sizes.join(groups, sizes["a"] == groups["node"], "left").select(
        "a", F.coalesce("component", "a").alias("component"), "size"
    )
    return join_groups(links, roots, "a", "size", heavy_rows).select("ord", "component")


def _rank() -> Column:
    """Best lead of a cluster: score, completeness, recency, then the earlier submission."""
    return F.struct(
        F.coalesce("quality_score", F.lit(0.0)).alias("score"),
        completeness().alias("filled"),
        F.col("created_at"),
        (-F.col("ord")).alias("earlier"),
    )


def survivors(leads: DataFrame, scope: str = DATASET, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """`(ord, component, best_ord, best_lead_id)` for the members of every cluster.

    The best member is an aggregate with a map-side combine, not a sort of the cluster. Ids that `leads` don't have yet are made for
    the best members only.
    """
    clusters = components(leads.select("ord", "email", "phone_e164", "dataset_id"), scope, heavy_rows)
    given = "lead_id" in leads.columns
    named = ["lead_id"] if given else ["dataset_id", "source"]
    ranked = leads.select("ord", *named, _rank().alias("rank"))  # ranks move, the fields they are made of don't
    members = cut(ranked.join(clusters, "ord").select("ord", "component", *named, "rank"))
    best = members.groupBy("component").agg(F.max_by(F.struct("ord", *named), F.col("rank")).alias("best"), F.count("*").alias("size"))
    best_id = F.col("best.lead_id") if given else lead_id(F.col("best.dataset_id"), F.col("best.source"), F.col("best.ord"))
    best = best.select("component", F.col("best.ord").alias("best_ord"), best_id.alias("best_lead_id"), "size")
    return join_groups(members.select("ord", "component"), best, "component", "size", heavy_rows).select(
        "ord", "component", "best_ord", "best_lead_id"
    )


def losers(leads: DataFrame, scope: str = DATASET, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """`(ord, duplicate_of_lead_id)` of the leads that a better one of their cluster stands for.

    `leads` is read several times; stage it first when it is expensive to compute.
    """
    found = survivors(leads, scope, heavy_rows).filter("ord != best_ord")
    return cut(found.select("ord", F.col("best_lead_id").alias("duplicate_of_lead_id")))


def decided(leads: DataFrame, stored: DataFrame | KeyIndex | None = None, scope: str = DATASET, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """`(ord, duplicate_of_lead_id)` of all duplicates: repeats within the batch first, then repeats of what is stored.
    Only identifiers move; whole rows meet the answer once, in `marked`."""
    within = losers(leads, scope, heavy_rows)
    if stored is None or (isinstance(stored, KeyIndex) and stored.own(scope).isEmpty()):  # nothing to repeat
        return within
    slim = staged(leads.select("ord", "email", "phone_e164", "dataset_id").join(within, "ord", "left_anti"), "fresh")  # read three times
    return cut(within.unionByName(stored_matches(slim, stored, scope, heavy_rows)))


def marked(leads: DataFrame, duplicates: DataFrame) -> DataFrame:
    """All leads with their status: clean, or a duplicate of the lead that `duplicates` names."""
    bare = leads.drop("status", "duplicate_of_lead_id").join(duplicates, "ord", "left")
    return bare.withColumn("status", F.when(F.col("duplicate_of_lead_id").isNull(), S.CLEAN).otherwise(S.DUPLICATE))


def _split(leads: DataFrame) -> Resolved:
    return Resolved(leads.filter(F.col("status") != S.DUPLICATE), leads.filter(F.col("status") == S.DUPLICATE))


def deduplicate(leads: DataFrame, scope: str = DATASET, heavy_rows: int = HEAVY_ROWS) -> Resolved:
    """Best lead of every cluster, and the others marked as duplicates of it."""
    return _split(marked(leads, losers(leads, scope, heavy_rows)))


def existing_keys(incoming: DataFrame, stored: DataFrame | KeyIndex, scope: str = DATASET) -> DataFrame:
    """`(key, stored_lead_id)` of the identifiers of `incoming` that are already stored, by a store's index or by its leads."""
    return known_keys(incoming, match_keys(incoming, scope).select("key").distinct(), stored, scope)


def stored_matches(
    incoming: DataFrame, stored: DataFrame | KeyIndex, scope: str = DATASET, heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """`(ord, duplicate_of_lead_id)` of incoming leads that are already stored; an email match
    goes before a phone match. The stored lead is never rewritten."""
    keys = match_keys(incoming, scope)
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"))
    known = known_keys(incoming, sizes.select("key"), stored, scope).join(sizes, "key")
    hits = join_groups(keys, known, "key", "size", heavy_rows)
    # 'email:' sorts before 'phone:', and a lead has one key of each kind at most
    return hits.groupBy("ord").agg(F.min_by("stored_lead_id", "key").alias("duplicate_of_lead_id"))


def against_stored(
    incoming: DataFrame, stored: DataFrame | KeyIndex, scope: str = DATASET, heavy_rows: int = HEAVY_ROWS
) -> Resolved:
    """First write wins: incoming leads that are already stored become duplicates of the stored one."""
    return _split(marked(incoming, cut(stored_matches(incoming, stored, scope, heavy_rows))))


def resolve(leads: DataFrame, stored: DataFrame | KeyIndex | None = None, scope: str = DATASET) -> Resolved:
    """Repeats within the batch first, then repeats of what is stored."""
    leads = staged(leads, "scored")
    return _split(marked(leads, decided(leads, stored, scope)))
