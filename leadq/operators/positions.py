"""Dense positions: rows numbered 0, 1, 2, ... without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadq.session import staged

#: A row's number within its task takes this many bits of monotonically_increasing_id; the task's number the rest.
TASK_BITS = 33
#: Tasks whose starts are broadcast, at most; more of them are joined by a shuffle.
MOST_BROADCAST = 500_000


def dense(rows: DataFrame, name: str = "ord") -> DataFrame:
    """`rows`, written out, with their position in the order in which they are read.

    Two passes: the rows are written once with (task, number within the task), which needs no shuffle; then one row per task, its count,
    is summed up to the task's start. Reading adds start and number. The same files read in the same splits get the same
    positions. Empty tasks take no positions.
    """
    told = staged(rows.withColumn(name, F.monotonically_increasing_id()), "numbered")
    task = F.shiftright(name, TASK_BITS)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # over one row per task
    starts = told.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    starts = staged(starts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "starts")
    starts = F.broadcast(starts) if starts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else starts
    inside = F.col(name).bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    placed = told.withColumn("_task", task).join(starts, "_task")
    return placed.withColumn(name, F.col("_start") + inside).select(*told.columns)
