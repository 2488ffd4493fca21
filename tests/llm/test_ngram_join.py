import random

import numpy as np
from pyspark.sql import functions as F

from leadq.llm import frames, ngram_join, queries

SF = "/root/testdata/sf0.001"


def grams(text, width=5):
    words = tuple((text or "").encode().split())
    return {words[i : i + width] for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    near = [[bool(a) and i != j and len(a & b) / len(a | b) >= threshold for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min([group[i], *(group[j] for j in range(len(rows)) if near[i][j])]) for i in range(len(rows))]
    ids = [r[0] for r in rows]
    low = {g: min(ids[i] for i in range(len(rows)) if group[i] == g) for g in set(group)}
    same = [min(ids[j] for j in range(len(rows)) if i == j or (sets[i] and (rows[i][1] or "").split() == (rows[j][1] or "").split())) for i in range(len(rows))]
    return sorted((ids[i], same[i], sum(near[i]), low[group[i]]) for i in range(len(rows)))


def answer(spark, rows, **options):
    return sorted(map(tuple, ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()))


def family(size, words, edits, seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            own[rnd.randrange(words)] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_small_families_short_texts_and_copies(spark):
    texts = family(12, 120, 3, 1) + family(5, 60, 1, 2) + ["a b c", "a  b\nc", "a b", None, "", " \n", "a b c d e", "a b c d e"]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    assert answer(spark, rows, recall=0.9999, hashes=400) == brute(rows)


def test_blocks_of_a_large_bucket_agree(spark):
    rows = list(enumerate(family(60, 150, 6, 3)))
    want = brute(rows)
    assert sum(r[2] for r in want) > 500
    for block in (4, 7, 256):
        assert answer(spark, rows, recall=0.999999, hashes=600, block=block) == want


def test_recall_on_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows)
    got = sorted(map(tuple, queries.op1_ngram_join(spark, SF).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(g[2] <= w[2] for g, w in zip(got, want, strict=True))
    assert sum(r[2] for r in got) >= 0.995 * sum(r[2] for r in want)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 70001}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "x y"), (3, "x y"), (None, "x y"), (4, "one thing"), (4, "other words")]
    got = answer(spark, rows[:2])
    assert got == [(1, 1, 1, 1), (2, 2, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_links": F.lit("x"), "class_id": F.lit(1)})
    found = ngram_join.join(df)
    assert found.count() == len(rows) and found.filter("doc_id = 3 and n_links = 2").count() == 2
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 4]
    assert ngram_join.join(df.filter("doc_id < 0")).count() == 0


def test_common_counts_by_matrix_and_by_pair():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 9000, 5000).astype(np.uint64)) for _ in range(9)]
    x, y = np.triu_indices(9, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]
    assert ngram_join.common_counts(sets, np.tile(x, 3), np.tile(y, 3)).tolist() == want * 3
    assert ngram_join.common_counts(sets, x[:5], y[:5]).tolist() == want[:5]


def test_banding_reaches_the_recall():
    for threshold, recall, most in ((0.8, 0.999, 144), (0.5, 0.95, 128), (0.95, 0.99, 64)):
        bands, rows = frames.bands_for(threshold, recall, most)
        assert bands * rows <= most and 1 - (1 - threshold**rows) ** bands >= recall


def test_rows_without_an_id_or_with_one_in_common_are_documents_of_their_own(spark):
    near, other, third = (family(3, 120, 2, seed) for seed in (11, 12, 13))
    rows = [(None, near[0]), (None, other[0]), (None, third[0]), (None, "alone here"), (1, near[1]), (1, near[0]), (2, near[2])]
    rows += [(5, other[1]), (5, third[1]), (6, third[2]), (None, None), (None, ""), (7, None), (7, " ")]
    want = brute([(i, t) for i, (_, t) in enumerate(rows)])
    found = spark.createDataFrame(rows, "doc_id long, text string")
    named = [None if r[0] is None else r[0] for r in rows]
    low = lambda i, c: min((named[k] for k in range(len(rows)) if want[k][c] == want[i][c] and named[k] is not None), default=None)
    expected = [(named[i], low(i, 1), want[i][2], low(i, 3)) for i in range(len(rows))]
    order = lambda r: tuple((v is not None, v or 0) for v in r)
    got = map(tuple, ngram_join.join(found, recall=0.9999, hashes=400).collect())
    assert sorted(got, key=order) == sorted(expected, key=order)
    kept = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(found, recall=0.9999, hashes=400).collect()), key=str)
    assert kept == sorted([*rows[:4], *rows[-4:]], key=str)


def test_cells_are_bounded_by_documents_and_words_and_each_pair_has_one_group(spark):
    # two buckets of 60 that overlap in 30, and a small one for each two documents: two homes that meet; a third is long
    reps = [(i, 1000 if i % 3 == 0 else 10, [7 if i < 60 else 9, 100 + i // 2, 8 if i >= 30 else 200 + i]) for i in range(90)]
    shared = [(a, b) for a in range(90) for b in range(a + 1, 90) if set(reps[a][2]) & set(reps[b][2])]
    df = spark.createDataFrame(reps, "rep long, n_words long, bands array<long>")
    for block, words, side in ((8, 10**9, 4), (256, 4000, 2048), (256, 10**9, 16)):
        rows = ngram_join.meetings(df, block, words, side).collect()
        assert len({(r.rep, r.x, r.y) for r in rows}) == len(rows) and all(r.cell in (r.x, r.y) for r in rows)
        groups = {}
        for r in rows:
            groups.setdefault((r.x, r.y), {})[r.rep] = r.cell
        cells = {r.cell for r in rows}
        assert len(cells) >= (90 // block if words == 10**9 else 30 * 1000 // words)
        seen = [
            (a, b)
            for (x, y), own in groups.items()
            for a in own
            for b in own
            if a < b and (own[a] != own[b] if x != y else True)
        ]
        assert len(set(seen)) == len(seen) and set(shared) <= set(seen)
        assert len(rows) <= 90 * len(cells)


def test_a_bucket_far_above_a_cell(spark):
    rows = list(enumerate(family(450, 120, 2, 8)))
    got = answer(spark, rows, block=32)
    want = brute(rows)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert sum(r[2] for r in got) >= 0.995 * sum(r[2] for r in want) > 50_000
    assert all(g[2] <= w[2] for g, w in zip(got, want, strict=True))


def test_pairs_share_a_band():
    bands = np.array([[1, 2], [1, 3], [4, 3], [5, 6]])
    every = np.arange(4)
    assert list(zip(*map(list, ngram_join.band_pairs(bands, every, every)), strict=True)) == [(0, 1), (1, 2)]
    assert list(zip(*map(list, ngram_join.band_pairs(bands, every[:2], every[2:])), strict=True)) == [(1, 2)]
