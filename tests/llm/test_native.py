import hashlib
import os
import re
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from leadq.llm import chat, exact_dedup, fingerprint, frames, mixing, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    same_as_sql(spark, name)


# --- exact duplicates ---


@pytest.mark.parametrize("bound", [None, 0])
def test_exact_duplicates_of_odd_rows(spark, monkeypatch, bound):
    if bound is not None:
        monkeypatch.setattr(frames, "SMALL_ROWS", bound)  # more groups than are broadcast
    long = "x" * 1_000_000
    rows = [(1, "a"), (2, "b"), (3, "a"), (3, "a"), (4, None), (5, ""), (6, long + "1"), (7, long + "2"), (8, long + "1"), (None, "b"), (None, "lone"), (9, "é"), (10, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("x"), "count": F.lit(1)})
    got = exact_dedup.mark_duplicates(df, prefix=2).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "count", "keep_id", "group_size", "kept"}
    told = sorted(((r.doc_id or 0), (r.text or "")[-1:], r.keep_id or 0, r.group_size, r.kept) for r in got)
    assert told == [
        (0, "b", 2, 2, False), (0, "e", 0, 1, True), (1, "a", 3, 3, False), (2, "b", 2, 2, True), (3, "a", 3, 3, False), (3, "a", 3, 3, True),
        (4, "", 5, 2, False), (5, "", 5, 2, True), (6, "1", 8, 2, False), (7, "2", 7, 1, True), (8, "1", 8, 2, True), (9, "é", 9, 1, True), (10, "e", 10, 1, True),
    ]
    assert exact_dedup.drop_duplicates(df).count() == 8 and exact_dedup.drop_duplicates(df).columns == df.columns
    assert exact_dedup.mark_duplicates(df.filter("doc_id = -1")).count() == 0
    told = exact_dedup.mark_duplicates(df, drop_text=True, sha="sha").collect()
    assert len(told) == len(rows) and "text" not in told[0].asDict()
    assert {(r.doc_id, r.sha) for r in told} == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_exact_dedup_moves_no_text(spark, monkeypatch):
    plans = []
    stage = exact_dedup.staged
    monkeypatch.setattr(exact_dedup, "staged", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stage(df, name))[1])
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for bound in (1000, 0):
        monkeypatch.setattr(frames, "SMALL_ROWS", bound)
        last = exact_dedup.mark_duplicates(docs, drop_text=True, sha="sha")
        for plan in [*plans, last._jdf.queryExecution().executedPlan().toString()]:
            assert "Python" not in plan
            for exchange in re.finditer(r"Exchange hashpartitioning\(([^)]*)\)", plan):
                assert "text" not in exchange[1]
            below = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
            assert not below or not re.search(r"Exchange.*\n.*Project \[[^\]]*(?<!_)\btext#", plan)


# --- mixing ---


def test_targets_by_repeated_sharing(spark):
    sizes = [("a", 10, 1), ("b", 1000, 5), ("c", 7, 1), ("d", 300, 2), (None, 40, 1), ("é", 0, 1)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long, rows long")).collect()}
    order = ["a", "b", "c", "d", "é", None]
    size, weight = {s: n for s, n, _ in sizes}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, want = float(sum(size.values())), set(order), {}
    while full := {s for s in open_ if 3 * size[s] < left / sum(weight[x] for x in open_) * weight[s]}:
        want |= {s: 3.0 * size[s] for s in full}
        left, open_ = left - sum(3.0 * size[s] for s in full), open_ - full
    want |= {s: left / sum(weight[x] for x in open_) * weight[s] for s in open_}
    assert got == pytest.approx(want)


def test_mix_cuts_exactly_whatever_the_ranges(spark):
    rows = [(i, f"s{i % 4}" if i % 11 else None, " ".join(["w"] * (i % 17))) for i in range(500)] + [(7, "s3", "w w"), (None, "s3", "w w w"), (600, "s0", None), (601, "s1", "w " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("taken", F.lit("x"))
    told = [sorted(map(tuple, mixing.mix(df, range_rows=n).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=repr) for n in (3, 100_000)]
    assert told[0] == told[1] and len(told[0]) == len(rows)
    by = {}
    for _, source, size, source_size, target, taken in told[0]:
        assert 0 <= taken <= 3 * size
        by.setdefault(source, []).append((size, taken, source_size, target))
    for rows_of in by.values():
        assert sum(r[1] for r in rows_of) == int(rows_of[0][3] + 0.5) and sum(r[0] for r in rows_of) == rows_of[0][2]
    assert mixing.mix(df.filter("doc_id < -5")).count() == 0


def test_mix_where_a_third_of_all_rows_have_no_id(spark):
    rows = [(None if i % 3 == 0 else i, f"s{i % 2}", f"w {i} " + "w " * (i % 5)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.mix(df, range_rows=100)
    per = df.withColumn("key", mixing.random_key()).withColumn("range", mixing.range_of("key", F.lit(30))).groupBy("source", "range").count()
    assert per.agg(F.max("count")).first()[0] < 160 and per.count() == 60
    plan = {r.source: r for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert all(r.taken == int(r.target + 0.5) for r in plan.values())


def test_take_repeats_and_cuts_texts(spark):
    rows = [(1, "a", " one two\nthree  four five"), (2, "b", "x"), (3, "c", "y " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = {r.doc_id: r for r in mixing.mix(df).collect()}
    taken = mixing.take(df)
    assert taken.columns == df.columns
    got = {}
    for r in taken.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[1].count(rows[0][2]) == 3 and got[2] == ["x"] * 3
    assert sum(len(t.split()) for t in got[3]) == plan[3].taken and got[3][0] == "y " * (plan[3].taken - 1) + "y"


# --- fingerprints ---



def test_fingerprints_of_edited_texts(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in queries.op2_document_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for _, t in docs]
    by_text = {}
    errors = []
    for i, (d, t) in enumerate(docs):
        r, (_, after) = got[d], docs[(i + 1) % len(docs)]
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        words = edited.split()
        own = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        assert len(r.fingerprint.lstrip("=")) % 16 == 0 and (r.fingerprint[:1] == "=") == (len(grams[i]) <= fingerprint.COMPLETE)
        union = max(1, len(own | grams[i]))
        exact = len(own & grams[i]) / union if union and (own or grams[i]) else 1.0
        if max(len(own), len(grams[i])) <= fingerprint.COMPLETE:
            assert r.near_edited == exact
        else:
            errors.append(abs(r.near_edited - exact) / (exact * (1 - exact) / (union / fingerprint.SCALE)) ** 0.5 if exact < 1 else r.near_edited - exact)
    assert sum(errors) / len(errors) < 1.2 and max(errors) < 5  # in standard errors


def parsed(told):
    digits = told.removeprefix("=")
    return told.startswith("="), {int(digits[i : i + 16], 16) for i in range(0, len(digits), 16)}


def like(a, b):
    """Likeness of two fingerprints as text: only what they say."""
    (whole_a, a), (whole_b, b) = parsed(a), parsed(b)
    if not (whole_a and whole_b):
        low = lambda s: {h for h in s if h >= 2**63 and h < 2**63 + 2**64 // fingerprint.SCALE}  # noqa: E731  the lowest signed hashes
        a, b = low(a), low(b)
    return len(a & b) / len(a | b) if a | b else float(whole_a == whole_b)


def test_likenesses_come_from_the_fingerprints(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(queries.op2_document_fingerprints(spark, SF).collect(), key=lambda r: r.doc_id)
    assert len(rows) == docs.count() and any(not r.fingerprint.startswith("=") for r in rows)
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        assert r.near_edited == like(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == like(r.fingerprint, after.fingerprint)


def sketches(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {r.id: set(r.sketch.hashes) for r in fingerprint.with_sketch(df, "text", **options).collect()}


def test_sketches_merge_and_contain(spark):
    a, b, c = " ".join(f"a{i}" for i in range(4000)), " ".join(f"b{i}" for i in range(300)), " ".join(f"b{i}" for i in range(6, 12))
    texts = [a, b, a + "\n" + b, "", " one  two", "one two", c, " ".join(f"c{i}" for i in range(200)), b + " " + c]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    told = fingerprint.with_shingles(fingerprint.with_sketch(df, "text"), "text", "whole")
    s = {r.id: r for r in told.collect()}
    assert [s[i].sketch.complete for i in range(9)] == [False, True, False, True, True, True, True, True, True]
    assert s[3].sketch.hashes == [] and s[4].sketch == s[5].sketch and len(s[4].sketch.hashes) == 1
    assert abs(len(s[0].sketch.hashes) / 3996 - 1 / fingerprint.SCALE) < 0.04
    pairs = told.alias("x").join(told.alias("y"), F.lit(True))
    x, y, sketch = F.col("x.sketch"), F.col("y.sketch"), F.col
    rows = pairs.select(
        sketch("x.id").alias("i"),
        sketch("y.id").alias("j"),
        (fingerprint.merged(x, y) == fingerprint.sketch_of(F.array_union("x.whole", "y.whole"))).alias("merges"),
        fingerprint.containment(x, y).alias("guess"),
        fingerprint.containment(x, y, b_shingles=F.col("y.whole")).alias("share"),
        fingerprint.likeness(x, y).alias("like"),
    ).collect()
    whole = {i: set(r.whole) for i, r in s.items()}
    for r in rows:
        p, q = whole[r.i], whole[r.j]
        exact = len(p & q) / len(p) if p else 1.0
        assert r.merges and (r.share == exact or not s[r.i].sketch.complete)
        if s[r.i].sketch.complete and s[r.j].sketch.complete:
            assert r.guess == exact and r.like == (len(p & q) / len(p | q) if p | q else 1.0)
        else:
            assert r.guess is None or abs(r.guess - exact) < 0.3
        assert (r.like == 1.0) == (p == q)
    assert {(r.i, r.j) for r in rows if r.guess is None} <= {(i, j) for i in (4, 5, 6) for j in (0, 2)}


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_next_row_across_ranges(spark, ranges):
    rows = [(i * i, f"t{i}") for i in range(40)] + [(9, "a twin"), (400, "t20 twin"), (None, "no id"), (None, "another")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for part in (df, df.filter("doc_id is not null"), df.filter("doc_id = 4"), df.filter("doc_id = -4"), df.filter("doc_id is null")):
        hashes = {r.text: r.h for r in part.select("text", F.xxhash64("text").alias("h")).collect()}
        own = sorted([tuple(r) for r in part.collect()], key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
        want = {r: own[(i + 1) % len(own)][1] for i, r in enumerate(own)}
        got = {(r.doc_id, r.text): r.next_text for r in fingerprint.with_next(part, "doc_id", ["text"], ranges).collect()}
        assert got == want


def test_fingerprints_of_odd_rows(spark):
    rows = [(1, None, 5), (1, None, 5), (2, "", 0), (3, "one two three", 1), (None, "x " * 300_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = fingerprint.edit_report(df).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got) == [0, 0, 0, 13, 600_000]
    assert fingerprint.edit_report(df.filter("doc_id = 8")).count() == 0


def test_short_texts_are_compared_by_all_their_shingles(spark):
    rows = [(i, " ".join(f"w{i}x{k}" if k >= 8 else f"w{i // 2}y{k}" for k in range(12 + i % 5))) for i in range(60)]
    grams = lambda t: {tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} if t else set()
    jaccard = lambda a, b: len(a & b) / len(a | b)
    got = {r.doc_id: r for r in fingerprint.edit_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        after = rows[(i + 1) % len(rows)][1]
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        assert got[i].near_edited == jaccard(grams(text.split()), grams(edited.split()))
        assert got[i].near_next == jaccard(grams(text.split()), grams(after.split()))


def test_next_row_of_ids_beyond_doubles(spark):
    rows = [(2**62 + i, f"t{i}") for i in range(500)]
    got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"], 8)
    assert {r.text: r.next_text for r in got.collect()} == {f"t{i}": f"t{(i + 1) % 500}" for i in range(500)}


@pytest.mark.parametrize("key", [None, 7])
def test_next_row_where_a_third_of_all_rows_share_a_key(spark, key):
    rows = [(key if i % 3 == 0 else i, f"t{i % 1500}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    own = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = sorted((*r, own[(i + 1) % len(own)][1]) for i, r in enumerate((str(a), b) for a, b in own))
    got = fingerprint.with_next(df, "doc_id", ["text"], 8)
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in got.collect()) == want
    bounds = fingerprint._bounds(df.withColumn("tie", F.shiftright(F.xxhash64("text"), 11)), "doc_id", F.col("tie"), 8)
    place = lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]] >> 11)
    marks = [(k is not None, k or 0, t) for k, t in bounds]
    sizes = [sum(m <= place(r) and (i + 1 == len(marks) or place(r) < marks[i + 1]) for r in rows) for i, m in enumerate(marks)]
    assert sum(sizes) == 3000 and max(sizes) < 900


# --- chat ---


def talk(conv, *said, role="user"):
    return [(conv, i, role, text) for i, text in enumerate(said)]


def test_snapshots_collapse_to_the_longest(spark):
    rows = talk(1, "a") + talk(2, "a", "b") + talk(3, "a", "b", "c") + talk(4, "a", "b", "c") + talk(5, "a", "x") + talk(6, "b", "a") + talk(7, "a", "b", role="other")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for segment in (2, 4096):
        got = sorted(map(tuple, chat.maximal(df, segment).collect()))
        assert got == [(3, 3, 2), (5, 2, 1), (6, 2, 1), (7, 2, 1)]
    texts = {r.conv_id: r.text for r in chat.render(df).collect()}
    assert texts[5] == "<|im_start|>user\na<|im_end|>\n<|im_start|>user\nx<|im_end|>\n"
    parts = {(r.conv_id, r.part): r.text for r in chat.render(df, 2).collect()}
    assert parts[(3, 0)].count("<|im_end|>") == 2 and parts[(3, 1)].count("<|im_end|>") == 1


def test_chat_of_odd_rows(spark):
    rows = talk(1, "a", None) + talk(2, "a", "") + [(3, None, None, "late"), (3, 0, "user", "a"), (3, 0, "user", "a"), (None, 0, "user", "nobody")]
    rows += [(8, i, "user", "long " * 50) for i in range(9000)] + [(9, i, "user", "long " * 50) for i in range(8999)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    got = {(r.conv_id, r.part): (r.n_turns, r.copies, r.text) for r in chat.render(df).collect()}
    assert got.keys() == {(1, 0), (3, -1), (3, 0), (None, 0), (8, 0), (8, 1), (8, 2)}
    assert got[(1, 0)][:2] == (2, 2) and got[(3, 0)][0] == 3 and got[(3, -1)][2] == "<|im_start|>\nlate<|im_end|>\n"
    assert got[(8, 0)][2].count("<|im_start|>") == 4096 and got[(8, 2)][:2] == (9000, 1)
    assert chat.render(df.filter("conv_id = 77")).count() == 0
