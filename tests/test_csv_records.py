import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from leadq.sources import feeds, records


def put(tmp_path, name, body):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "f.csv").write_text(body, newline="")
    return f"file:{folder}"


def told(feed):
    return sorted((tuple(sorted((k, v or "") for k, v in r.raw.items())) for r in feed.records.collect()))


def whole(spark, path, names):
    """The rows that Spark's own multiLine reader gives, one task per file."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return sorted(tuple(sorted(zip(names, [v or "" for v in r], strict=True))) for r in rows.collect())


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", ["128m", "2k"])
def test_records_are_those_of_the_whole_file_reader(spark, tmp_path, end, split):
    rng = random.Random(7)
    texts = ["a", "b c", 'say "hi"', "two\nlines", 'x","y', '"', 'end"\n', "\n\nlate", "é,ü", 'q"q', '""\n""', ",", "5 ft"]
    rows = [[f"id{i}", rng.choice(texts), rng.choice(texts), f"z{i}"] for i in range(900)]
    path = put(tmp_path, "f", written([["id", "one", "two", "last"], *rows], end))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        feed = feeds.read_csv_upload(spark, path)
        got = told(feed)
        splits = spark.read.text(path).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert splits > 5 if split == "2k" else splits < 5
    assert len(got) == 900 and got == whole(spark, path, ["id", "one", "two", "last"]) and feed.quarantine.isEmpty()


def test_a_quote_inside_a_bare_value_opens_nothing(spark, tmp_path):
    body = 'name,size\nann,5"\nbob,"6"" tall"\ncyd,7"8"9"\n"dee",\n'
    path = put(tmp_path, "odd", body)
    assert [wanted for _, _, wanted in feeds._csv_groups(spark, path, None)] == [False]
    want = [(("name", n), ("size", s)) for n, s in (("ann", '5"'), ("bob", '6" tall'), ("cyd", '7"8"9"'), ("dee", ""))]
    assert told(feeds.read_csv_upload(spark, path)) == want == told(feeds.read_csv_upload(spark, path, multi_line=True))


def test_states_of_lines(spark):
    cases = {
        "a,b": (False, True), '"a","b"': (False, False), '"a': (True, False), 'a,"b': (True, False), 'b",c': (False, False),
        '""': (False, True), '"""': (True, False), 'x""y': (False, True), 'a"b,"c': (True, True), "": (False, True), '",": ': (False, False), '",""': (False, False),
        'end","new': (False, True),
    }
    df = spark.createDataFrame([(k,) for k in cases], "value string")
    got = {r.value: (r.o, r.i) for r in df.select("value", records.opens(F.col("value")).alias("o"), records.stays(F.col("value")).alias("i")).collect()}

    def machine(line, inside):
        at, fresh = 0, not inside
        while at < len(line):
            c = line[at]
            if inside:
                if line[at : at + 2] == '""':
                    at += 1
                elif c == '"':
                    inside = False
            elif c == ",":
                fresh = True
                at += 1
                continue
            elif c == '"' and fresh:
                inside = True
            fresh = False
            at += 1
        return inside

    assert got == {k: (machine(k, False), machine(k, True)) for k in cases}


def test_a_quote_that_never_closes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MOST_LINES", 5)
    body = "a,b\n1,x\n2,\"two\nlines\"\n3,\"open\n" + "".join(f"{i},y\n" for i in range(20))
    feed = feeds.read_csv_upload(spark, put(tmp_path, "open", body))
    assert told(feed) == [(("a", "1"), ("b", "x")), (("a", "2"), ("b", "two\nlines"))]
    lost = feed.quarantine.collect()
    assert len(lost) == 21 and {r.error_message for r in lost} == {"unclosed quote"}


def test_headers_that_come_twice_or_are_empty(spark, tmp_path):
    feed = feeds.read_csv_upload(spark, put(tmp_path, "twice", "Email,Email,email,,Email.1\n1,2,3,4,5\n"))
    assert [dict(r.raw) for r in feed.records.collect()] == [{"Email": "1", "Email.1": "2", "email": "3", "_c3": "4", "Email.1.1": "5"}]
    assert feeds.header_names('﻿"A ""b""",B') == ['A "b"', "B"]


def test_chunks_of_a_split_are_put_together(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    texts = ["a", "two\nlines", '"', 'x","y', "\n\nlate", '""\n""', "a\nb\nc\nd\ne\nf\ng\nh\ni"]
    rows = [[f"id{i}", rng.choice(texts), rng.choice(texts)] for i in range(300)]
    path = put(tmp_path, "f", written([["id", "one", "two"], *rows]))
    monkeypatch.setattr(records, "CHUNK_BITS", 2)  # of four lines each
    monkeypatch.setattr(records, "TASK_LINES", 64)
    got = told(feeds.read_csv_upload(spark, path))
    assert len(got) == 300 and got == whole(spark, path, ["id", "one", "two"])


def test_tasks_follow_the_lines(spark, tmp_path, monkeypatch):
    """One split of many lines isn't one task's to sort."""
    path = put(tmp_path, "f", written([["id", "one"], *[[str(i), "x\ny"] for i in range(2000)]]))
    monkeypatch.setattr(records, "CHUNK_BITS", 5)
    monkeypatch.setattr(records, "TASK_LINES", 100)
    kept = {}
    staged = records.staged
    monkeypatch.setattr(records, "staged", lambda df, name, *a, **k: kept.setdefault(name, staged(df, name, *a, **k)))
    records.read_records(spark, [f.path for f in feeds_files(spark, path)])
    files = {r.f: r.n for r in kept["csv-states"].groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).collect()}
    assert sum(files.values()) == 4001 and max(files.values()) < 1000


def feeds_files(spark, path):
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path")).distinct().collect()
