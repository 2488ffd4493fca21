"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadq.llm.frames import partitions, text_of, words_of

WIDTH = 5
#: One in so many shingle hashes is retained.
SCALE = 4
#: Before all ties of a key.
START = -(2**63)
#: A text of so many different shingles or fewer retains them all.
COMPLETE = 512


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of `width` words; a shorter text is one shingle, a text without words has none."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    short = F.when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n >= width, runs).otherwise(short)


def _threshold(scale: int) -> Column:
    return F.lit(-(2**63) + 2**64 // scale)


def _low(hashes: Column, scale: int) -> Column:
    return F.filter(hashes, lambda h: h < _threshold(scale))


def sketch_of(shingles: Column, scale: int = SCALE, complete: int = COMPLETE) -> Column:
    """The sketch of distinct shingle hashes: (complete, hashes), hashes sorted. See `with_sketch`."""
    few = F.size(shingles) <= complete
    return F.struct(few.alias("complete"), F.sort_array(F.when(few, shingles).otherwise(_low(shingles, scale))).alias("hashes"))


def with_shingles(df: DataFrame, text: str, name: str = "shingles", width: int = WIDTH) -> DataFrame:
    """`df` plus `name`: the distinct hashes of all shingles of `text`."""
    # each value is used more than once and so has a column of its own
    return df.withColumn("__words", words_of(F.col(text))).withColumn(name, F.array_distinct(shingle_hashes(F.col("__words"), width))).drop("__words")


def with_sketch(df: DataFrame, text: str, name: str = "sketch", width: int = WIDTH, scale: int = SCALE, complete: int = COMPLETE) -> DataFrame:
    """`df` plus `name`: the shingle hashes of `text` below one `scale`-th of the hash range, or, of a text of at most `complete`
    different shingles, all of them.

    The threshold is the same for every text, so sketches of very unequal texts compare: what both retain below the threshold is a
    fair sample of either. Short texts, whose sample would say little, are complete, and two complete sketches compare exactly.
    The sketch of a union of texts comes from their sketches alone (`merged`), because a union is complete only if both are.
    """
    return with_shingles(df, text, "__hashes", width).withColumn(name, sketch_of(F.col("__hashes"), scale, complete)).drop("__hashes")


def as_text(sketched: Column) -> Column:
    """A sketch as lowercase hex, 16 digits a hash, after `=` if it is complete."""
    told = F.array_join(F.transform(sketched["hashes"], lambda h: F.lpad(F.hex(h), 16, "0")), "")
    return F.concat(F.when(sketched["complete"], "=").otherwise(""), F.lower(told))


def merged(a: Column, b: Column, scale: int = SCALE, complete: int = COMPLETE) -> Column:
    """Sketch of the shingles of two documents together."""
    both = F.array_union(a["hashes"], b["hashes"])
    few = a["complete"] & b["complete"] & (F.size(both) <= complete)
    return F.struct(few.alias("complete"), F.sort_array(F.when(few, both).otherwise(_low(both, scale))).alias("hashes"))


def _comparable(a: Column, b: Column, scale: int) -> tuple[Column, Column]:
    """The hashes of two sketches that speak of the same shingles: all of them, or those below the threshold."""
    whole = a["complete"] & b["complete"]
    return tuple(F.when(whole | ~x["complete"], x["hashes"]).otherwise(_low(x["hashes"], scale)) for x in (a, b))


def containment(a: Column, b: Column, scale: int = SCALE, b_shingles: Column | None = None) -> Column:
    """Share of `a`'s shingles that `b` has, 0 to 1; 1 if `a` has none. Exact if both sketches are complete. Of a short `a` none may lie
    below the threshold that a long `b` retains: then it is null, unless all shingles of b are given."""
    if b_shingles is not None:
        return F.when(F.size(a["hashes"]) == 0, 1.0).otherwise(F.size(F.array_intersect(a["hashes"], b_shingles)) / F.size(a["hashes"]))
    mine, other = _comparable(a, b, scale)
    return F.when(F.size(a["hashes"]) == 0, 1.0).when(F.size(mine) > 0, F.size(F.array_intersect(mine, other)) / F.size(mine))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Jaccard similarity of two texts from their sketches, 0 to 1; exact if both are complete, else an estimate from the hashes below
    the threshold. Two texts without words are alike, and so are texts whose sketches are equal."""
    mine, other = _comparable(a, b, scale)
    common = F.size(F.array_intersect(mine, other))
    together = F.size(mine) + F.size(other) - common
    return F.when(together == 0, (a == b).cast("double")).otherwise(common / together)


def _bounds(docs: DataFrame, key: str, tie: Column, ranges: int) -> list[tuple]:
    """At most 2 * `ranges` increasing (key, tie) that cut `docs` into ranges of about equal numbers of rows, the first at or before all rows.

    Quantiles of the key, and, of each key that more than one range's worth of rows share (null among them), quantiles of the tie.
    There are fewer than `ranges` such keys.
    """
    value = F.col(key)
    told = docs.agg(F.min(value).alias("low"), F.percentile_approx(value, [i / ranges for i in range(1, ranges)] or [0.5], 10_000).alias("marks"), F.count("*").alias("n"), F.count_if(value.isNull()).alias("none")).first()
    # quantiles are doubles; the bounds are the smallest keys at or above them
    marks = F.array(*[F.lit(m).cast(docs.schema[key].dataType) for m in sorted({told["low"], *(told["marks"] or [])} - {None})] or [F.lit(None)])
    firsts = docs.groupBy(F.size(F.filter(marks, lambda m: m <= value)).alias("range")).agg(F.min(value).alias("first")).collect()
    bounds = {(r["first"], START) for r in firsts} - {(None, START)} | ({(None, START)} if told["none"] else set())
    worth = max(1, told["n"] // ranges)
    heavy = [r[0] for r in docs.groupBy(value).count().filter(F.col("count") > 2 * worth).collect()]  # at most ranges / 2
    if heavy:
        mine = docs.filter(value.isin([k for k in heavy if k is not None]) | (value.isNull() if None in heavy else F.lit(False)))
        cuts = mine.groupBy(value.alias("key")).agg(
            F.count("*").alias("n"), F.min(tie).alias("low"), F.percentile_approx(tie, [i / ranges for i in range(1, ranges)] or [0.5], 10_000).alias("ties")
        )
        for r in cuts.collect():
            step = max(1, ranges * worth // r["n"])
            bounds = (bounds - {(r["key"], START)}) | {(r["key"], t) for t in [r["low"], *r["ties"][::step]]}
    return sorted(bounds, key=lambda b: (b[0] is not None, b[0] or 0, b[1]))


def with_next(
    docs: DataFrame, key: str, columns: list[str], ranges: int | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, prepared: tuple[str, ...] = ()
) -> DataFrame:
    """`docs` with next_<column> of the row that follows by `key`, the first row's for the last. `prepare` adds the columns `prepared` after the
    rows have moved; they have a next_ too.

    Key ranges are cut at quantiles, one per shuffle partition, and the first row of every range also goes
    to the end of the range before, so that each range is one window and the rows move once. Rows without a key come first; rows with
    equal keys follow each other in the order of a hash of the first of `columns`, so a key that very many rows share, or lack, is cut
    into ranges like others. Only rows equal in both can't be parted; their window is sorted with spills and never gathered.
    """
    ranges = ranges or partitions(docs)
    told = docs.withColumn("__tie", F.shiftright(F.xxhash64(columns[0]), 11))  # exact as a double, for its quantiles
    kind = docs.schema[key].dataType
    bounds = _bounds(told, key, F.col("__tie"), ranges) or [(None, START)]
    marks = [F.struct(F.lit(k).cast(kind).alias("k"), F.lit(t).alias("t")) for k, t in bounds]
    place = F.struct(F.col(key).alias("k"), F.col("__tie").alias("t"))
    at = F.size(F.filter(F.array(*marks), lambda b: b <= place))
    # a row that may be the first of a range: one with its bound's tie, or with its bound's key if the bound stands before all ties
    opens = lambda b: b["k"].eqNullSafe(F.col(key)) & ((b["t"] == F.col("__tie")) | (b["t"] == START))
    home = lambda at, ghost: F.struct(at.alias("range"), F.lit(ghost).alias("ghost"))
    none = F.array().cast("array<struct<range:int,ghost:boolean>>")
    homes = [F.array(home(at, False))]
    if len(bounds) > 1:
        homes.append(F.when(F.exists(F.array(*marks[1:]), opens) & (at > 1), F.array(home(at - 1, True))).otherwise(none))
    homes.append(F.when(opens(marks[0]), F.array(home(F.lit(len(bounds)), True))).otherwise(none))
    placed = told.withColumn("__home", F.explode(F.concat(*homes))).withColumn("__range", F.col("__home.range"))
    placed = prepare(placed.repartition(ranges, "__range"))
    order = Window.partitionBy("__range").orderBy("__home.ghost", F.col(key).asc_nulls_first(), "__tie", columns[0])
    return (
        placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in [*columns, *prepared]})
        .filter(~F.col("__home.ghost"))
        .drop("__home", "__range", "__tie")
    )


def fingerprints(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """doc_id, text (null: empty) and sketch of every whole text."""
    rows = docs.select("doc_id", text_of().alias("text"))
    return with_sketch(rows, "text", "sketch", width, scale)


def edit_report(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends with the beginning of the next document by doc_id instead of its own last quarter.
    near_edited and near_next are likenesses of the fingerprints that are returned, the next document's for near_next: exact Jaccard similarities of
    the shingles where both are complete (up to COMPLETE shingles), else estimates with a standard error of
    sqrt(J (1 - J) / m), m about a `scale`-th of the shingles of both: at most 0.045 at the smallest such text, 0.016 at 4,000 words.
    Null texts count as empty; rows with one doc_id are documents of their own, in the order of a hash of their texts;
    a single row is its own next; other columns are ignored; an empty table gives an empty result.
    """
    sketched = lambda df, text, name: with_sketch(df, text, name, width, scale)
    told = with_next(docs.select("doc_id", text_of().alias("text")), "doc_id", ["text"], prepare=lambda df: sketched(df, "text", "own"), prepared=("own",))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    told = sketched(told.withColumn("edited", edited).drop("next_text"), "edited", "changed")
    return told.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), scale).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own"), scale).alias("near_next"),
    )
