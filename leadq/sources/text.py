"""Raw text and JSON documents from uploaded files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def decode_text(content: Column) -> Column:
    """Text of raw bytes: no byte order mark, undecodable bytes as U+FFFD."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """`(path, text)`, one row per file."""
    return spark.read.format("binaryFile").load(path).select("path", decode_text(F.col("content")).alias("text"))


#: Lines of a file that tell its layout.
LEADING = 9
#: Groups of lines, by a hash of their position, whose lowest positions bound those of the leading lines.
GROUPS = 64


def _named(lines: DataFrame) -> DataFrame:
    """`(path, at, value)` of the lines that aren't blank in the splits at the start of files; others can't hold a first line."""
    named = lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        decode_text(F.col("value")).alias("value"),
    )
    return named.filter((F.col("start") == 0) & (F.trim("value") != "")).drop("start")


def _leading(lines: DataFrame, n: int) -> DataFrame:
    """The first `n` lines of every file that aren't blank, and at most a few more: what stands behind a bound from one aggregate is
    dropped, so no task sorts a whole split. The lowest positions of n groups of lines are those of n lines, so the first n are not behind them."""
    named = _named(lines)
    group = F.pmod(F.xxhash64("at"), F.lit(GROUPS)).alias("group")
    ends = named.groupBy("path", group).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    nth = F.get(F.array_sort(F.collect_list("low")), F.lit(n - 1))
    bounds = ends.groupBy("path").agg(F.coalesce(nth, F.max("high")).alias("bound"))
    return named.join(F.broadcast(bounds), "path").filter(F.col("at") <= F.col("bound")).drop("bound")  # a row per file


def first_lines(lines: DataFrame) -> DataFrame:
    """`(path, first)`: the first line of every file that isn't blank, from a scan of text files."""
    return _leading(lines, 1).groupBy("path").agg(F.min_by("value", "at").alias("first"))


def by_lines(lines: DataFrame) -> DataFrame:
    """`(path, by_lines)`: whether a file of JSON is one record a line: its first line is an object or array by itself, or most of
    the next ones are, so that one bad line at the top doesn't make a document of it."""
    place = F.row_number().over(Window.partitionBy("path").orderBy("at"))
    leading = _leading(lines, LEADING).withColumn("place", place).filter(F.col("place") <= LEADING)
    kind = F.schema_of_variant(_document(F.col("value")))
    told = leading.withColumn("record", F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False)))
    first, later = F.col("place") == 1, F.col("place") > 1
    most = 2 * F.count_if(later & F.col("record")) > F.count_if(later)
    return told.groupBy("path").agg((F.bool_or(first & F.col("record")) | most).alias("by_lines"))


def _unbalanced(lines: DataFrame) -> DataFrame:
    """`(path)` of files that can't be one JSON document, because they open more brackets than they close or the other way round. A JSON string
    has no line break in it, so each line is counted by itself. Files with a byte order mark are left out: a line's is dropped, a document's
    is not unless it comes first."""
    bare = F.regexp_replace(F.make_valid_utf8(F.col("value")), r'"(?:[^"\\]|\\.)*+"', "")
    depth = F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))
    marked = F.startswith(F.make_valid_utf8(F.col("value")), F.lit("\ufeff"))
    told = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.sum(depth).alias("depth"), F.count_if(marked).alias("marked"))
    return told.filter("depth != 0 and marked = 0").select("path")


def read_bodies(spark: SparkSession, path: str | list[str], layout: str = "auto") -> DataFrame:
    """`(value, whole)` rows of text: whole files, or single lines.

    `layout`: 'document' = one document per file, 'lines' = one per line, 'auto' = by content, whatever the size: a file
    whose first line, or most of the next ones, is a JSON object or array by itself is read by lines, in splits, and so is one whose
    brackets don't match; any other as one document, which a task holds whole. The
    paths of the documents come to the driver, which has listed all files for the scan anyway.
    """
    if layout == "auto":
        found = by_lines(spark.read.text(path)).collect()
        documents = [r["path"] for r in found if not r["by_lines"]]
        broken = {r["path"] for r in _unbalanced(spark.read.text(documents)).collect()} if documents else set()
        documents = [path for path in documents if path not in broken]  # no document: its lines are what is left to read
        lines = [r["path"] for r in found if r["by_lines"] or r["path"] in broken]
    else:
        documents, lines = (path, []) if layout == "document" else ([], path)
    parts = []
    if documents:
        whole = spark.read.text(documents, wholetext=True)
        parts.append(whole.select(decode_text(F.col("value")).alias("value"), F.lit(True).alias("whole")))
    if lines:
        parts.append(spark.read.text(lines).select(decode_text(F.col("value")).alias("value"), F.lit(False).alias("whole")))
    if not parts:
        return spark.createDataFrame([], "value string, whole boolean")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _document(value: Column) -> Column:
    """The text as a VARIANT if it is exactly one JSON document; NULL otherwise."""
    # inside brackets, because the parser would stop at the end of a first document
    alone = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))
    return F.when(F.try_variant_get(alone, "$[1]", "variant").isNull(), F.try_variant_get(alone, "$[0]", "variant"))


def json_items(bodies: DataFrame) -> DataFrame:
    """`(value, item, problem)`: JSON objects as VARIANT, or text with what is wrong with it.

    A body may be one object, an array of objects, or lines of such. Blank lines are skipped;
    a body that is a bare number, string or bool holds no records.
    """
    parsed = bodies.withColumn("doc", _document(F.col("value")))
    many = F.col("whole") & F.col("doc").isNull() & ~_is_array(F.col("value"))
    lines = parsed.filter(many).select(F.explode(F.split("value", r"\r\n|\n|\r")).alias("value"), F.lit(False).alias("whole"))
    documents = parsed.filter(~F.col("whole") | F.col("doc").isNotNull()).unionByName(lines.withColumn("doc", _document(F.col("value"))))
    documents = documents.filter(F.trim("value") != "").withColumn("kind", F.schema_of_variant("doc"))
    kind = F.col("kind")
    scalar_body = F.col("whole") & kind.isNotNull() & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get("doc", "$", "array<variant>")).otherwise(F.array("doc"))
    singles = documents.filter(~F.coalesce(scalar_body, F.lit(False))).select("value", F.explode(items).alias("item"))
    is_object = F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False))
    problem = F.when(F.col("item").isNull(), "malformed JSON").when(~is_object, "not an object")
    return singles.withColumn("problem", problem).unionByName(_long_arrays(parsed.filter(F.col("whole") & F.col("doc").isNull())))


def _is_array(value: Column) -> Column:
    """Whether a text is exactly one valid JSON array, of any length."""
    alone = F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1
    return F.coalesce(alone & F.ltrim(value).startswith("["), F.lit(False))


def _long_arrays(bodies: DataFrame) -> DataFrame:
    """Items of arrays that are too long for one VARIANT value: their elements are parsed one by one."""
    elements = F.from_json("value", "array<string>")
    items = bodies.filter(_is_array(F.col("value"))).select(F.explode(elements).alias("value"))
    items = items.withColumn("item", F.try_parse_json("value"))
    is_object = F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False))
    return items.withColumn("problem", F.when(~is_object, "not an object"))
