"""Similarity of short texts (headers) and of vectors, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadq.functions.strings import SPACE_RUN, strip


def normalized_header(name: Column) -> Column:
    return F.translate(F.lower(strip(name)), "_-", "  ")


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, SPACE_RUN), lambda t: t != "")), " ")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row over the characters of `a`."""
    chars_a = F.filter(F.split(a, ""), lambda c: c != "")
    chars_b = F.filter(F.split(b, ""), lambda c: c != "")
    zero = F.array_repeat(F.lit(0), F.size(chars_b) + 1)

    def next_row(row: Column, ch: Column) -> Column:
        def cell(done: Column, pair: Column) -> Column:
            j = pair["j"]
            best = F.when(pair["c"] == ch, F.get(row, j) + 1).otherwise(
                F.greatest(F.get(row, j + 1), F.get(done, j))
            )
            return F.concat(done, F.array(best))

        pairs = F.transform(chars_b, lambda c, j: F.struct(c.alias("c"), j.alias("j")))
        return F.aggregate(pairs, F.array(F.lit(0)), cell)

    return F.get(F.aggregate(chars_a, zero, next_row), F.size(chars_b))


def indel_ratio(a: Column, b: Column) -> Column:
    """0..100: twice the common subsequence over the total length."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(lcs_length(a, b) * 200.0 / total)


def best_possible_ratio(a: Column, b: Column) -> Column:
    """Upper bound of `indel_ratio` from the lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(F.least(F.length(a), F.length(b)) * 200.0 / total)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)
