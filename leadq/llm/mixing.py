"""Mixing sources to target weights: random order, distributed prefix sums, an exact cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadq.llm.frames import text_of, without, word_count

WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST_EPOCHS = 3
#: Mean number of rows of a key range. Only the plan depends on it.
RANGE_ROWS = 4096
RESULT = ("size", "source_size", "target", "taken")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """`sizes(source, source_size, rows)`, one row per source, plus rank, weight, target.

    Sources take the weights in turn, in code point order with null last. The targets share the sum of all
    sizes by weight; none exceeds `most_epochs` times its source and the excess is shared again.
    That level is found in closed form: with the sources by cap / weight and the first i of them
    capped, the rest would share at level (total - caps) / (weights left), and the true level is the
    largest of these. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * most_epochs
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    )
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy(cap / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(by_ratio), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))
    level = F.max("__level").over(everything)
    return (
        ranked.withColumn("__level", left.cast("double") / weight_left)
        .withColumn("target", F.least(cap.cast("double"), level * F.col("weight")))
        .drop("__level")
    )


def random_key(doc_id: str = "doc_id", text: str = "text", seed: str = "mix") -> Column:
    """A digest of `seed`, doc_id and text, so that rows that share a doc_id or have none spread too."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(text))))


def range_of(key: str, ranges: Column) -> Column:
    """Which of so many equal ranges a random key lies in."""
    return F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * ranges, 32)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
    seed: str = "mix",
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """All rows and columns of `docs` plus size, source_size, target, taken.

    The size of a document is its number of words (null text: 0). Each document gets a random key,
    a digest of `seed`, doc_id and text. Within its source a document is taken whole once per full epoch of
    the target, and the remaining budget takes documents in key order; the one at the
    cut gives the words that are left, so a source's `taken` add up to its rounded target. Ties go by doc_id,
    then size; rows equal in both are interchangeable. Documents without a source form one source. An input column
    named like a result column is replaced. An empty table gives an empty result.

    Keys are uniform, so equal ranges of them hold about `range_rows` documents each, of a hot source
    as of any other, and of rows that share a doc_id or have none. Only rows equal in doc_id and text are in one range, whose running
    sum streams over sorted rows. Prefix sums run inside a range and over the sums of the ranges. Very long texts are counted and hashed
    where they are read.
    """
    rows = without(docs, *RESULT).withColumn("size", word_count(text_of(text)))
    sizes = rows.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    plan = targets(sizes, weights, most_epochs).select(
        F.col("source").alias("__source"),
        F.col("rank").alias("__rank"),
        F.ceil(F.col("rows") / range_rows).cast("long").alias("__ranges"),
        "source_size",
        "target",
    )
    keyed = (
        rows.withColumn("__key", random_key(doc_id, text, seed))
        .join(plan, F.col(source).eqNullSafe(F.col("__source")))
        .withColumn("__range", range_of("__key", F.col("__ranges")))
    )
    sums = keyed.groupBy("__rank", "__range").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("__rank").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__rank", "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0).cast("long")).alias("__start"))
    inside = Window.partitionBy("__rank", "__range").orderBy("__key", doc_id, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__start") - F.col("__inside") + F.col("size")))
    return (
        keyed.withColumn("__inside", F.sum("size").over(inside))
        .join(sums, ["__rank", "__range"])
        .withColumn("taken", (epochs * F.col("size") + part).cast("long"))
        .select(*[F.col(f"`{c}`") for c in rows.columns], "source_size", "target", "taken")
    )


def take(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixed corpus with the columns of `docs`: a row for each epoch that takes the document, and
    for a document at the cut a row with its first words, white space as it is. Nulls, ties, repeated rows, clashing columns and empty tables
    are as in `mix`; documents without words, null ones among them, are never taken. A very long text at the cut is split in one task."""
    mixed = mix(docs, text=text, **options)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    pieces = F.split(F.col(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, 1, rest), "")
    texts = F.when(rest > 0, F.concat(F.array_repeat(F.col(text), whole), F.array(cut))).otherwise(F.array_repeat(F.col(text), whole))
    return mixed.filter("taken > 0").withColumn("__text", F.explode(texts)).withColumn(text, F.col("__text")).select(*docs.columns)
