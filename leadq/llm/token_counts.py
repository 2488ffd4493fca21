"""Token counts: an exact histogram of encoded lengths with suffix sums."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadq.llm import bpe
from leadq.llm import textvec as V
from leadq.session import staged

#: Lengths that share one window of the suffix sums.
RANGE = 256


def lengths(docs: DataFrame, codec: bpe.Codec) -> DataFrame:
    """n_tokens of every whole text, nothing else; a null text has none."""
    sent = bpe.shared(docs, codec)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in V.pieces(batches, "text", 4 * V.PIECE):
            counts = [len(own.encode(t or "")) // 4 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")


def histogram(docs: DataFrame, codec: bpe.Codec) -> DataFrame:
    """n_tokens, docs: how many documents have each encoded length. One row a length, combined before the shuffle.

    Null texts have length 0, repeated rows count each time, other columns are ignored, an empty table gives an
    empty result.
    """
    return lengths(docs, codec).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame, width: int = RANGE) -> DataFrame:
    """`hist` plus docs_from, tokens_from (documents at least so long, and their tokens), docs_up_to, tokens_up_to,
    truncated_total (all tokens if texts are cut at this length) and share (part of the documents up to this length).

    Suffix sums run inside ranges of lengths and over the sums of the ranges, so no task holds all lengths.
    A limit between two lengths is answered by the next length above: see `at_limits`. The histogram is written once and read
    twice, so no text is encoded twice.
    """
    hist = staged(hist, "lengths")
    rows = hist.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / width).cast("long").alias("range"))
    after = Window.partitionBy(F.lit(0)).orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    ranges = rows.groupBy("range").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(whole).alias("all_docs"),
        F.sum("t").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy("range").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({"d": F.sum("docs").over(inside), "t": F.sum("tokens").over(inside)}).join(ranges, "range")
    summed = summed.withColumns({"docs_from": F.col("d") + F.col("docs_after"), "tokens_from": F.col("t") + F.col("tokens_after")})
    longer = F.col("docs_from") - F.col("docs")
    return summed.select(
        "n_tokens",
        "docs",
        "docs_from",
        "tokens_from",
        (F.col("all_docs") - longer).alias("docs_up_to"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("tokens")).alias("tokens_up_to"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        ((F.col("all_docs") - longer) / F.col("all_docs")).alias("share"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> dict[int, int]:
    """All tokens if texts are cut at each of the `limits`, from the suffix sums at the next length above."""
    nearest = [F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("n_tokens") >= x, F.col("n_tokens"))).alias(f"at_{x}") for x in limits]
    row = sums.agg(F.max(F.col("tokens_up_to")).alias("total"), *nearest).first()
    total = row["total"] or 0
    return {x: total if row[f"at_{x}"] is None else total - row[f"at_{x}"]["tokens_from"] + x * row[f"at_{x}"]["docs_from"] for x in limits}


def quantiles(sums: DataFrame, shares: Sequence[float]) -> dict[float, int | None]:
    """Smallest length up to which at least each share of the documents goes."""
    row = sums.agg(*[F.min(F.when(F.col("share") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]).first()
    return {q: row[f"q{i}"] for i, q in enumerate(shares)}
