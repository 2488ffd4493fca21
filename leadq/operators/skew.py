"""Joins of many rows to a table with one row per group, where a group may be huge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadq.session import cut

# A group with more rows than this is joined by broadcast. There are at most
# (rows / HEAVY_ROWS) such groups whatever the data looks like, so the broadcast side is bounded:
# 100,000 groups for 10^11 rows.
HEAVY_ROWS = 1_000_000


def join_groups(
    rows: DataFrame, groups: DataFrame, on: str, size: str, heavy_rows: int = HEAVY_ROWS, ready: bool = False
) -> DataFrame:
    """Inner join of `rows` to `groups` (one row per value of `on`, with its row count in `size`).

    Rows of heavy groups never move: they meet a broadcast of the few heavy groups. All other
    rows are shuffled on the key, where no group exceeds `heavy_rows`. Without a heavy group it
    is one plain join. The groups are aggregated once and written out, unless they are `ready`.
    """
    groups = groups if ready else cut(groups)
    heavy = groups.filter(F.col(size) > heavy_rows)
    if heavy.isEmpty():
        return rows.join(groups, on)
    in_place = rows.join(F.broadcast(heavy), on)
    moved = rows.join(F.broadcast(heavy.select(on)), on, "left_anti").join(groups.filter(F.col(size) <= heavy_rows), on)
    return in_place.unionByName(moved)
