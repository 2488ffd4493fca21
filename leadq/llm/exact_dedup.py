"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadq.llm.frames import small, text_of, without
from leadq.session import staged

#: Leading code points that the second step hashes. It only decides which texts are hashed whole.
PREFIX = 64
RESULT = ("keep_id", "group_size", "kept")


def open_groups(rows: DataFrame) -> DataFrame:
    """(__len, __prefix) that more than one of `rows` has, written out.

    Rows are counted by length, and by prefix hash where the length is not alone, both with a map-side combine before any
    shuffle: however many rows share a length, a task sends one count for it. No text moves.
    """
    lengths = rows.groupBy("__len").count().filter("count > 1").select("__len")
    counts = rows.select("__len", "__prefix").join(small(staged(lengths, "exact-lengths")), "__len", "left_semi")
    counts = counts.groupBy("__len", "__prefix").count()
    return staged(counts.filter("count > 1").select("__len", "__prefix"), "exact-groups")


def mark_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prefix: int = PREFIX, drop_text: bool = False, sha: str | None = None
) -> DataFrame:
    """All rows and columns of `docs` plus keep_id, group_size, kept.

    Texts are equal when they are identical; null counts as empty. Of equal texts the row with
    the largest doc_id is kept (a null doc_id is the smallest); of repeated rows with one doc_id
    one is kept. An input column named like a result column is replaced. An empty table gives an
    empty result. Very long texts are hashed where they are read. With `sha` every row gets the text's digest in a column of that
    name, and it is the only hash a text gets; otherwise only texts of open groups are hashed.

    Lengths that occur once, then (length, prefix hash) pairs that occur once, leave the race on narrow counts. Rows then meet
    the open groups where they are: the groups are broadcast up to a checked number; beyond it every text is hashed as it is read
    and the hash, not the text, decides. So a text moves only if the caller keeps it and there are too many groups of copies to
    broadcast. Rows out of the race pass on without a shuffle, and no group is ever gathered.
    """
    rows = without(docs, *RESULT, *([sha] if sha else [])).withColumns(
        {"__len": F.octet_length(text_of(text)), "__prefix": F.xxhash64(F.substring(text_of(text), 1, prefix))}
    )
    columns = [c for c in rows.columns if not c.startswith("__") and not (drop_text and c == text)] + ([sha] if sha else [])
    groups = open_groups(rows)
    few, bounded = small(groups, tell=True)
    if bounded:
        rows = rows.join(few.withColumn("__open", F.lit(True)), ["__len", "__prefix"], "left")
    else:
        rows = rows.withColumn("__open", F.lit(True))
    digest = F.sha2(text_of(text), 256)
    rows = rows.withColumn("__key", digest if sha or not bounded else F.when(F.col("__open"), digest))
    if sha:
        rows = rows.withColumn(sha, F.col("__key"))
    hashed = staged(rows.withColumn("__row", F.monotonically_increasing_id()).select(*[F.col(f"`{c}`") for c in columns], "__key", "__open", "__row"), "exact-dedup")
    copies = (
        hashed.filter("__open")
        .groupBy("__key")
        .agg(
            F.max(doc_id).alias("keep_id"),
            F.coalesce(F.max_by("__row", doc_id), F.max("__row")).alias("__keep_row"),
            F.count("*").alias("group_size"),
        )
        .filter("group_size > 1")
    )
    copies = small(staged(copies, "exact-copies"))
    found = hashed.filter("__open").join(copies, "__key", "left")
    alone = F.col("__keep_row").isNull()
    told = found.withColumns(
        {
            "keep_id": F.when(alone, F.col(f"`{doc_id}`")).otherwise(F.col("keep_id")),
            "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
            "kept": alone | (F.col("__keep_row") == F.col("__row")),
        }
    )
    rest = hashed.filter("__open is null").withColumns({"keep_id": F.col(f"`{doc_id}`"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    return told.unionByName(rest, allowMissingColumns=True).select(*[F.col(f"`{c}`") for c in columns], *RESULT)


def drop_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs` with one row of each text, the one with the largest doc_id. Nulls, ties, repeated rows, long texts, clashing columns and empty
    tables are as in `mark_duplicates`."""
    return mark_duplicates(docs, text, doc_id).filter("kept").select(*docs.columns)
