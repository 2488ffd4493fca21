"""Readers of the five feeds. Each gives raw records and quarantined rows:

    records:    source, raw MAP<STRING,STRING>, not_text ARRAY<STRING>
    quarantine: source, raw_data, reason, error_message, retries_used
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadq import schema as S
from leadq.functions.strings import last_entries
from leadq.operators import quarantine
from leadq.sources.records import opens, read_records
from leadq.sources.text import first_lines, json_items, read_bodies

_WEBHOOK = (
    "struct<entry:array<struct<changes:array<struct<field:string,value:struct<leadgen_id:string,form_id:string,"
    "page_id:string,created_time:string,field_data:array<struct<name:string,values:array<string>>>>>>>>>"
)
_BASE_KEYS = ["leadgen_id", "form_id", "page_id", "created_time"]
_NO_FIELDS = "array<string>"


@dataclass
class Feed:
    records: DataFrame
    quarantine: DataFrame


def _quarantined(items: DataFrame, source: str) -> DataFrame:
    bad = items.filter(F.col("problem").isNotNull())
    return quarantine.entries(bad, source, F.col("value"), F.lit("unreadable row"), F.col("problem"))


def flatten_webhook(payloads: DataFrame) -> DataFrame:
    """One raw map per lead event of webhook payloads (`payload` struct column).

    Other events are skipped. A submitted field goes over a base field of the same name; only
    its first value counts.
    """
    change = (
        payloads.select(F.explode("payload.entry").alias("entry"))
        .select(F.explode("entry.changes").alias("change"))
        .filter("change.field = 'leadgen'")
        .select("change.value")
    )
    base = [F.struct(F.lit(k).alias("key"), F.col(f"value.{k}").alias("value")) for k in _BASE_KEYS]
    submitted = F.transform(
        F.coalesce("value.field_data", F.array()),
        lambda f: F.struct(f["name"].alias("key"), F.get(f["values"], F.lit(0)).alias("value")),
    )
    return change.select(last_entries(F.concat(F.array(*base), submitted)).alias("raw"))


def facebook_feed(bodies: DataFrame) -> Feed:
    """Webhook deliveries: one document, an array of them, or one per line."""
    items = json_items(bodies)
    payload = F.expr(f"try_variant_get(item, '$', '{_WEBHOOK}')")
    items = items.withColumn("payload", F.when(F.col("problem").isNull(), payload))
    misshapen = F.col("problem").isNull() & F.col("payload").isNull()
    items = items.withColumn("problem", F.when(misshapen, "not a webhook payload").otherwise(F.col("problem")))
    records = flatten_webhook(items.filter(F.col("problem").isNull()))
    records = records.select(F.lit("facebook").alias("source"), "raw", F.array().cast(_NO_FIELDS).alias("not_text"))
    return Feed(records, _quarantined(items, "facebook"))


def read_facebook(spark: SparkSession, path: str, layout: str = "auto") -> Feed:
    return facebook_feed(read_bodies(spark, path, layout))


def landing_page_feed(bodies: DataFrame) -> Feed:
    """Flat JSON submissions: one object, an array of them, or one per line. Fields that hold
    something other than text are listed in `not_text`."""
    items = json_items(bodies)
    fields = F.expr("try_variant_get(item, '$', 'map<string,variant>')")
    good = items.filter(F.col("problem").isNull()).select(fields.alias("fields"))
    texts = F.transform_values("fields", lambda _, v: v.try_cast("string"))
    is_text = lambda v: F.schema_of_variant(v).isin("STRING", "VOID")
    odd = F.map_keys(F.map_filter("fields", lambda _, v: v.isNotNull() & ~is_text(v)))
    records = good.select(F.lit("landing_page").alias("source"), texts.alias("raw"), odd.alias("not_text"))
    return Feed(records, _quarantined(items, "landing_page"))


def read_landing_page(spark: SparkSession, path: str, layout: str = "auto") -> Feed:
    return landing_page_feed(read_bodies(spark, path, layout))


def na_to_null(value: Column, tokens: list[str] = S.NA_TOKENS) -> Column:
    """Text that a CSV reader takes as missing."""
    return F.when(~value.isin(tokens), value)


def _csv_groups(spark: SparkSession, path: str | list[str], multi_line: bool | None) -> list[tuple[str, list[str], bool]]:
    """Header line, files that share it, and whether a quoted value of them has a line break, from one scan of the text. The paths of the
    files come to the driver, which has listed them for the scan anyway."""
    lines = spark.read.text(path)
    opened = F.contains("value", F.lit('"')) & opens(F.col("value"))
    broken = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.bool_or(opened).alias("broken"))
    files = first_lines(lines).join(broken, "path").select("first", "path", "broken").collect()
    groups: dict[tuple[str, bool], list[str]] = {}
    for r in files:
        wanted = r["broken"] if multi_line is None else multi_line
        groups.setdefault((r["first"], wanted), []).append(r["path"])
    return [(first, sorted(paths), wanted) for (first, wanted), paths in sorted(groups.items())]


def header_names(line: str) -> list[str]:
    """Names in a header line. A name that comes again gets a number (`Email`, `Email.1`); one without text is `_c` and its place, which
    no profile looks at."""
    names: list[str] = []
    for i, text in enumerate(next(csv.reader([line.lstrip("\ufeff")]), [])):
        name, n = text or f"_c{i}", 0
        while name in names:
            n += 1
            name = f"{text}.{n}"
        names.append(name)
    return names


def read_csv(spark: SparkSession, path: str | list[str], source: str, multi_line: bool | None = None, na_tokens: list[str] = S.NA_TOKENS) -> Feed:
    """CSV exports with a header row and any columns, all of them text. The files of a folder may have different headers.

    All files are read in splits. Those in which a quoted value has a line break, as a scan of the text tells (a quote inside a bare value,
    like `5"`, opens none), are first put together from lines to records (`multi_line` decides for all files instead). A short row is
    filled with NULL, a row with too many values goes to quarantine, and so do the lines of a record that never closes its quote.
    """
    parts = [_read_csv(spark, first, paths, source, wanted, na_tokens) for first, paths, wanted in _csv_groups(spark, path, multi_line)]
    if not parts:
        return Feed(spark.createDataFrame([], f"source string, raw map<string,string>, not_text {_NO_FIELDS}"), quarantine.empty(spark))
    return _together(parts)


def _read_csv(spark: SparkSession, first: str, paths: list[str], source: str, multi_line: bool, na_tokens: list[str]) -> Feed:
    names = header_names(first)
    schema = ", ".join([*(f"c{i} string" for i in range(len(names))), "_bad_row string"])  # names may differ in case only
    options = {"escape": '"', "columnNameOfCorruptRecord": "_bad_row", "mode": "PERMISSIVE"}
    if multi_line:
        records, unclosed = read_records(spark, paths)
        parsed = records.filter(~F.col("header")).select(F.from_csv("value", schema, {**options, "multiLine": "true"}).alias("row"))
        feed = csv_feed(parsed.select("row.*"), source, na_tokens, names)
        lost = quarantine.entries(unclosed, source, F.col("value"), F.lit("unreadable row"), F.lit("unclosed quote"))
        return Feed(feed.records, feed.quarantine.unionByName(lost))
    # without pruning, because the parser would not notice values beyond the columns it was asked for
    reader = spark.read.options(header=True, columnPruning=False, **options)
    return csv_feed(reader.schema(schema).csv(paths), source, na_tokens, names)


def csv_feed(rows: DataFrame, source: str, na_tokens: list[str] = S.NA_TOKENS, headers: list[str] | None = None) -> Feed:
    """A feed from the text columns of a CSV scan, the last of which is `_bad_row`, the text of a row that doesn't fit. `headers` are the
    columns' names, if they have others there."""
    names = rows.columns[:-1]
    clean = headers or [n.lstrip("\ufeff") for n in names]
    # a scan may not read the bad-row column alone, so a bit of the first one goes with it
    bad_row = F.concat("_bad_row", F.coalesce(F.substring(F.col(f"`{names[0]}`"), 1, 0), F.lit("")))
    values = F.size(F.split(F.regexp_replace(bad_row, r'"(?:[^"]|"")*"', ""), ","))
    too_long = F.coalesce(values > len(names), F.lit(False))
    cells = [x for n, c in zip(names, clean) for x in (F.lit(c), F.make_valid_utf8(na_to_null(F.col(f"`{n}`"), na_tokens)))]
    records = rows.filter(~too_long).select(
        F.lit(source).alias("source"), F.create_map(*cells).alias("raw"), F.array().cast(_NO_FIELDS).alias("not_text")
    )
    bad = rows.filter(too_long)
    return Feed(records, quarantine.entries(bad, source, bad_row, F.lit("unreadable row"), F.lit("too many values")))


def _together(parts: list[Feed]) -> Feed:
    records, bad = parts[0].records, parts[0].quarantine
    for feed in parts[1:]:
        records, bad = records.unionByName(feed.records), bad.unionByName(feed.quarantine)
    return Feed(records, bad)


def read_instagram(spark: SparkSession, path: str, **options) -> Feed:
    return read_csv(spark, path, "instagram", **options)


def read_google_form(spark: SparkSession, path: str, **options) -> Feed:
    return read_csv(spark, path, "google_form", **options)


def read_csv_upload(spark: SparkSession, path: str, **options) -> Feed:
    return read_csv(spark, path, "csv_upload", **options)


READERS = {
    "facebook": read_facebook,
    "instagram": read_instagram,
    "google_form": read_google_form,
    "landing_page": read_landing_page,
    "csv_upload": read_csv_upload,
}


def ingest(spark: SparkSession, paths: dict[str, str], **options) -> Feed:
    """Read several feeds, `{source: path}`, into one frame of raw records."""
    unknown = set(paths) - set(READERS)
    if unknown:
        raise ValueError(f"unknown sources: {sorted(unknown)}; known are {S.SOURCES}")
    feed = _together([READERS[s](spark, p, **options) for s, p in paths.items()])
    return Feed(tagged(feed.records), feed.quarantine)


def tagged(records: DataFrame) -> DataFrame:
    """Put the feed's name into the raw record, unless the record brought one."""
    tag = F.when(F.map_contains_key("raw", "_source"), F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("_source"), F.col("source"))
    )
    return records.withColumn("raw", F.map_concat("raw", tag))


def numbered(records: DataFrame) -> DataFrame:
    """Give records their position `ord` without a global sort. Stage the result right away:
    "first wins" rules rest on it."""
    return records.withColumn("ord", F.monotonically_increasing_id())
