"""Small helpers that the text operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Rows of a side that is broadcast, at most; a larger one is joined by a shuffle.
SMALL_ROWS = 500_000


def text_of(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for a text without words."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def word_count(text: Column) -> Column:
    """Number of words as a long."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without columns that a result column will replace."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def small(df: DataFrame, rows: int | None = None, tell: bool = False):
    """`df` marked for a broadcast if it has at most `rows` rows (SMALL_ROWS), else as it is; with `tell` also which of both. It is
    counted for that, up to the bound, so it should be written out."""
    rows = SMALL_ROWS if rows is None else rows
    bounded = df.limit(rows + 1).count() <= rows
    df = F.broadcast(df) if bounded else df
    return (df, bounded) if tell else df


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def even_keys(df: DataFrame, n: int) -> list[int]:
    """n integers, of which hash partitioning by an int column deals number p to partition p of n: no two parts meet in
    one task and none stays empty. At most n numbers reach the driver."""
    tried, found = 16 * n, {}
    while len(found) < n:
        ids = df.sparkSession.range(tried).select(F.col("id").cast("int").alias("key"))
        rows = ids.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("p")).agg(F.min("key").alias("key")).collect()
        found, tried = {r["p"]: r["key"] for r in rows}, 2 * tried
    return [found[p] for p in range(n)]


def bands_for(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at `threshold` with at least
    `recall`, using at most `most_hashes` hash functions."""
    best = None
    for rows in range(1, most_hashes + 1):
        found = threshold**rows
        bands = 1 if found >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-found)) if found > 1e-12 else most_hashes + 1
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches the recall with so few hashes")
    return best
