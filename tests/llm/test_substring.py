from collections import Counter

import hypothesis.strategies as st
import numpy as np
import pyarrow as pa
from hypothesis import given, settings

from pyspark.sql import functions as F

from leadq.llm import frames, substring, textvec

ASCII_SPACE = " \t\n\x0b\x0c\r"


def brute(rows, width):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = [w.decode() for w in (text or "").encode().split()]
        gone = set()
        for i in range(len(words) - width + 1):
            run = tuple(words[i : i + width])
            if run in seen:
                gone |= set(range(i, i + width))
            seen.add(run)
        out[doc_id] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def answer(spark, rows, schema="doc_id long, text string", **options):
    df = substring.remove_repeats(spark.createDataFrame(rows, schema), **options)
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in df.collect()}


def test_removes_later_copies_only(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own{i} a{i}\n{passage}\tend{i}") for i in range(30)]
    rows += [(100, passage + " " + passage), (101, None), (102, ""), (103, " \n "), (104, "short text"), (105, passage)]
    assert answer(spark, rows) == brute(rows, 20)


def test_small_chunks_and_buckets_agree(spark):
    rows = [(i, " ".join("abc"[(i * j * j) % 3] for j in range(80))) for i in range(20)]
    want = brute(rows, 5)
    assert answer(spark, rows, width=5, chunk=50, task_bytes=150) == want
    assert answer(spark, rows[::-1], width=5) == want


def test_very_long_text_and_long_words(spark):
    long = " ".join(f"w{i % 50021}" for i in range(300_000))
    rows = [(1, long), (2, "x" * 2_500_000 + " " + " ".join(f"w{i}" for i in range(30)))]
    assert answer(spark, rows) == brute(rows, 20)


def test_repeated_rows_and_null_ids(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(1, passage), (1, passage), (2, passage), (None, passage)]
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_removed) for r in found) == [(False, 1, 25), (False, 1, 25), (False, 2, 25), (True, None, 0)]
    found = substring.remove_repeats(spark.createDataFrame(rows[:3], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(1, 0), (1, 0), (2, 25)]


def test_different_texts_without_an_id_or_with_one_are_documents_of_their_own(spark):
    passage, other = (" ".join(f"{c}{i}" for i in range(25)) for c in "pq")
    clean = " ".join(f"c{i}" for i in range(60))
    for doc_id in (None, 7):
        rows = [(doc_id, passage + " one end"), (doc_id, passage + " another end"), (doc_id, clean), (doc_id, other), (doc_id, other), (9, other)]
        found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk=40).collect()
        got = sorted((r.doc_id == 9, r.n_words, r.n_removed) for r in found)
        assert sorted(r[2] for r in got if r[1] == 27) == [0, 25]  # of the passage at the same start, one stays
        assert [r for r in got if r[1] != 27] == [(False, 25, 0), (False, 25, 0), (False, 60, 0), (True, 25, 25)]
        assert {r.kept_text for r in found if r.n_words == 60} == {clean}


def test_empty_table_and_extra_columns(spark):
    assert answer(spark, []) == {}
    rows = [(1, "a b c", "x", 1), (2, "a b c", "y", 2)]
    assert answer(spark, rows, "doc_id int, text string, kept_text string, n_words int", width=3)[2] == (3, 3, "")


def test_tasks_follow_the_size_of_the_texts_and_are_dealt_evenly(spark):
    docs = spark.createDataFrame([(i, "é" * 500) for i in range(40)] + [(40, None)], "doc_id long, text string")
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [substring.task_parts(docs, b) for b in (1000, 999, 10**9)] == [max(shuffle, n) for n in (40, 41, 1)]
    for n in (1, 7, 41):
        keys = spark.createDataFrame([(k,) for k in frames.even_keys(docs, n)], "key int")
        found = keys.repartition(n, "key").select(F.spark_partition_id().alias("p"), "key").orderBy("p").collect()
        assert [r.p for r in found] == list(range(n)) and [r.key for r in found] == frames.even_keys(docs, n)


def test_known_repeats_of_a_chunk_meet_in_no_bucket():
    text = " ".join(f"p{i}" for i in range(60))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(400), pa.int64()), "text_key": pa.array([1] * 400, pa.int64()), "text": [text] * 400})
    places = Counter()
    for row in substring._windows([batch], 20, n_buckets=4, homes=8, chunk=10**6):
        places[row["bucket"], row["hashes"] is None] += row["n"]
    assert all((bucket >= 4) == known for bucket, known in places)
    known = [n for (_, known), n in places.items() if known]
    assert sum(known) == 399 * 41 and len(known) == 8 and max(known) < 2 * np.mean(known)


@given(st.lists(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1), min_size=1, max_size=4))
def test_packed_numbers_come_back(lists):
    arrays = [np.array(x, dtype=np.int64) for x in lists]
    got = substring._unpack(substring._pack(*arrays), *map(len, arrays))
    assert [a.tolist() for a in got] == lists


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\t\n ", max_size=30), max_size=6))
def test_words_and_windows(texts):
    data, offsets = textvec.bytes_of(pa.array(texts, pa.string()))
    hashes, counts = textvec.word_hashes(data, offsets)
    words = [t.encode().split() for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [x for w in words for x in w]
    assert [[a == b for b in flat] for a in flat] == [[a == b for b in hashes] for a in hashes]
    at, own = textvec.window_starts(counts, 2)
    runs = [tuple(w[i : i + 2]) for w in words for i in range(len(w) - 1)]
    got = textvec.window_hashes(hashes, 2)[at]
    assert own.tolist() == [max(len(w) - 1, 0) for w in words]
    assert [[a == b for b in runs] for a in runs] == [[a == b for b in got] for a in got]
