import hashlib
import os
import re
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from leadq.llm import decontam, frames  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, width):
    owners = {}
    for item, text in items:
        own = words(text)
        for i in range(max(len(own) - width, 0) + 1 if own else 0):
            owners.setdefault(tuple(own[i : i + width]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for n in {len(run) for run in owners}:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in owners:
                    found |= owners[tuple(own[i : i + n])]
                    hit |= set(range(i, i + n))
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, "the Cat sat on the mat"), (2, "on the mat"), (10, "one"), (2, "a b"), (None, "Ça VA bien, École"), (3, None), (4, "  !! "), (5, "the the the the"), (6, "the cat sat on the mat"), (7, "never seen before")]
DOCS = [
    (1, "He said: the CAT sat on the mat."), (1, "the cat sat on"), (None, "ON THE MAT"), (None, "On the mat... on THE mat!"), (None, None), (2, ""), (3, "   \t"),
    (4, "the the the the the the"), (5, "ça va bien École ça va"), (6, "Ça va bien école"), (7, "a b a b one"), (7, "a b a b one"), (8, "it sat the cat on mat the"), (9, "x" * 100_000 + " one"),
]


def tables(spark, docs=DOCS, items=ITEMS):
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "term", "n_words", "item_id")})
    return docs, spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "wid", "tid")})


def test_odd_rows(spark, monkeypatch):
    for width in (1, 3, 5, 10):
        got = sorted(map(tuple, decontam.report(*tables(spark), width).collect()), key=repr)
        assert got == brute(DOCS, ITEMS, width)
    monkeypatch.setattr(frames, "SMALL_ROWS", 0)  # beyond the bound for a broadcast
    assert sorted(map(tuple, decontam.report(*tables(spark), 3).collect()), key=repr) == brute(DOCS, ITEMS, 3)


def test_empty_tables(spark):
    assert decontam.report(*tables(spark, docs=[])).count() == 0
    clean = decontam.report(*tables(spark, items=[])).collect()
    assert len(clean) == len(DOCS) and not any(r.contaminated or r.n_hit or r.n_items for r in clean)


def test_passage_and_words_that_are_everywhere(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    docs = [(i, f"the a the {passage} the {i}" if i % 3 == 0 else "the a " * (i % 50)) for i in range(2000)]
    items = [(1, passage), (2, "the a the a the a the a the a the"), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9 other")]
    assert sorted(map(tuple, decontam.report(*tables(spark, docs, items)).collect()), key=repr) == brute(docs, items, 10)


def test_proximity(spark):
    docs = [(1, "mat x x the x cat"), (2, "cat a a a a a a a a the mat"), (3, "cat the"), (4, "the the mat the cat"), (5, None)]
    terms, placed, owners = decontam.windows(spark.createDataFrame([(1, "the cat mat")], "item_id long, text string"))
    postings = decontam.index(spark.createDataFrame(docs, "doc_id long, text string"), terms)
    ids = postings.filter("tid is null").select("row", "doc_id")
    for span in (2, 3, 4, 9):
        near = decontam.proximity(postings, placed, span).join(ids, "row")
        got = {r.doc_id for r in near.collect()}
        rarest = "cat mat the".split()
        counts = {w: sum(words(t).count(w) for _, t in docs) for w in rarest}
        want = set()
        for anchor in [w for w in rarest if counts[w] == min(counts.values())]:  # of equally rare ones the first in the window
            if anchor == min((w for w in rarest if counts[w] == min(counts.values())), key="the cat mat".split().index):
                for d, t in docs:
                    own = words(t)
                    if any(w == anchor and all(any(o == other and abs(i - j) <= span for j, o in enumerate(own)) for other in rarest) for i, w in enumerate(own)):
                        want.add(d)
        assert got == want


def test_main_path_is_native_and_documents_stay_in_place(spark):
    docs, items = tables(spark)
    terms, placed, owners = decontam.windows(items)
    plan = decontam.report(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    each = docs.select(decontam.terms_of(F.col("text")).alias("w"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in each
