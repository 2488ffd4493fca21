"""Records of CSV files whose quoted values have line breaks, found in splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadq.session import staged

# A quoted value without its closing quote, whose own quotes are doubled. Possessive, so that long lines don't recurse.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
# Whole values, each with its comma: quoted, bare (a quote later in it is text), or empty.
_VALUES = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+'
#: Lines that one record may have. What a quote opens for longer than that is quarantined, line by line.
MOST_LINES = 10_000
#: Lines of a split that are gone through at a time (as bits of their number), and lines a task holds.
CHUNK_BITS, TASK_LINES = 18, 1 << 20


def opens(value: Column) -> Column:
    """Whether a line that begins outside quotes ends inside a quoted value. Only a quote at the beginning of a value opens one."""
    return value.rlike(rf'\A{_VALUES}"{_INSIDE}\z')


def stays(value: Column) -> Column:
    """Whether a line that begins inside a quoted value ends inside one: the same, or another that it opens."""
    rest = F.regexp_replace(value, rf'\A{_INSIDE}"[^,]*+,?', "")
    return value.rlike(rf"\A{_INSIDE}\z") | opens(rest)


def _after(out: Column, inside: Column, order, start: Column) -> Column:
    """State after each row: each row maps outside to `out` and inside to `inside`, and `start` is the state before the first.

    A row that maps both to one state forgets what was before; one that swaps them flips it. So the state is that of the last
    row that forgets, flipped by the number of swaps since: two running aggregates instead of a scan of states.
    """
    swaps = F.sum(F.when(out & ~inside, 1).otherwise(0)).over(order)
    reset = F.last(F.when(out == inside, F.struct(out.alias("state"), swaps.alias("swaps"))), ignorenulls=True).over(order)
    state, since = F.coalesce(reset["state"], start), swaps - F.coalesce(reset["swaps"], F.lit(0))
    return state != (since % 2 == 1)


def _file(spark: SparkSession, paths: list[str]) -> Column:
    """What tells a file from the others on each of its lines: a hash of its path, which is short, unless two paths have the same."""
    path = F.col("_metadata.file_path")
    hashes = spark.createDataFrame([(p,) for p in paths], "path string").select(F.xxhash64("path")).distinct().count()
    return F.xxhash64(path) if hashes == len(set(paths)) else path


def read_records(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, unclosed): `(value, header)` of every record of CSV files, a record being one or more lines, and the lines
    `(value)` of records that never seem to end.

    The files are read in splits, and a split is gone through in chunks, each of which is told from its neighbours only whether it begins inside a
    quoted value: every line maps (outside, inside) to the state at its end, a chunk's lines combine to one such map, and a running combination over
    the chunks of a file, a row each, gives the state at each chunk's start. Then every line knows whether it begins a record. Lines that are a record
    by themselves, nearly all, go on as they are; the others are grouped by the line that began their record, wherever they were read.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        _file(spark, paths).alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value"
    )
    lines = lines.withColumns({"out": opens(F.col("value")), "inside": stays(F.col("value"))})
    lines = staged(lines, "csv-lines")  # numbered once
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // TASK_LINES))
    chunk = ["file", "split", "chunk"]
    own = Window.partitionBy(*chunk).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out, inside = F.col("out"), F.col("inside")
    # states after every line for either state before the split
    numbers = lines.select("file", "split", F.shiftright("at", CHUNK_BITS).alias("chunk"), "at", "out", "inside")
    told = numbers.repartition(tasks, *chunk).withColumns(
        {"if_out": _after(out, inside, own, F.lit(False)), "if_in": _after(out, inside, own, F.lit(True))}
    )
    told = staged(told, "csv-states")
    chunks = told.groupBy(*chunk).agg(F.max_by("if_out", "at").alias("out"), F.max_by("if_in", "at").alias("in"))
    along = Window.partitionBy("file").orderBy("split", "chunk")  # a row per chunk
    chunks = chunks.withColumn("end", _after(F.col("out"), F.col("in"), along.rowsBetween(Window.unboundedPreceding, Window.currentRow), F.lit(False)))
    chunks = chunks.withColumn("begins_in", F.coalesce(F.lag("end").over(along), F.lit(False)))
    after = F.when(F.col("begins_in"), F.col("if_in")).otherwise(F.col("if_out"))
    states = told.repartition(tasks, *chunk).join(chunks.select(*chunk, "begins_in"), chunk).withColumn("after", after)
    before = F.coalesce(F.lag("after").over(Window.partitionBy(*chunk).orderBy("at")), F.col("begins_in"))
    states = states.withColumn("before", before)
    # only lines of records of several lines need to be told: where their record began, in their split or an earlier one
    parts = staged(states.filter("before or after").select(*chunk, "at", "before"), "csv-parts")
    start = F.when(~F.col("before"), F.col("at"))
    begun = F.last(start, ignorenulls=True).over(own)
    ends = parts.groupBy(*chunk).agg(F.max(start).alias("last"))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*chunk, F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    parts = parts.repartition(tasks, *chunk).withColumn("own", begun).join(ends, chunk).select("at", F.coalesce("own", "carried").alias("record"))
    sizes = parts.groupBy("record").agg(F.count("*").alias("n"))
    parts = staged(parts.join(sizes, "record").select("at", "record", (F.col("n") <= MOST_LINES).alias("whole")), "csv-records")
    headers = lines.filter("split = 0").groupBy("file").agg(F.min(F.when(F.trim("value") != "", F.col("at"))).alias("at")).select("at", F.lit(True).alias("header"))

    each = lines.select("at", "value").repartition(tasks, "at").join(parts, "at", "left").join(headers, "at", "left").withColumn("header", F.coalesce("header", F.lit(False)))
    plain = each.filter("record is null").select("value", "header")
    joined = each.filter("whole").groupBy("record").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("lines"), F.max("header").alias("header"))
    joined = joined.select(F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"), "header")
    records = plain.unionByName(joined).withColumn("value", F.regexp_replace("value", r"\r\z", ""))
    return records.filter(F.trim("value") != ""), each.filter("not whole").select("value")
