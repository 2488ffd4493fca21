import hashlib
import os
import sys

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from leadq.llm import bpe, quality  # noqa: E402
from leadq.llm import textvec as V  # noqa: E402

SF = "/root/testdata/sf0.001"


def grams(text):
    w = text.encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def mixed(rows):
    """(doc_id, text) as often as the mix takes them, for rows of (doc_id, text, source)."""
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.encode().split())
    names = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(sum(size.values())), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * size[s] < level * weight[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    out = []
    for s in names:
        budget = int(target[s] + 0.5)
        epochs, rest = divmod(budget, size[s])
        for d, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"mix:{r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()):
            words = t.split()
            out += [(d, t)] * epochs
            if rest > 0:
                took = min(rest, len(words))
                cut, at = t, 0
                if took < len(words):
                    for w in words[:took]:
                        at = t.index(w, at) + len(w)
                    cut = t[:at]
                out.append((d, cut))
                rest -= took
    return [(d, t) for d, t in out]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs)
    rows = sorted((r.doc_id, r.text, r.source) for r in docs.collect())
    good = model.score(quality.Looked(pa.array([r[1] for r in rows], pa.string()))) >= 0.5
    rows = [r for r, g in zip(rows, good) if g]
    assert 0 < len(rows) < docs.count()
    last = {t: d for d, t, _ in rows}
    rows = [r for r in rows if last[r[1]] == r[0]]
    sets = [grams(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    rows = [r for i, r in enumerate(rows) if group[i] == i]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((d, np.array(library.encode_ordinary(t), "<u4").tobytes(), hashlib.sha256(t.encode()).hexdigest()) for d, t in mixed(rows))
    got = sorted((r.doc_id, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", None, 0), (9002, "", "en", None, 0), (None, "The cat and the dog are in the house.", "en", "src1", 37)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.filter("doc_id < 40").union(odd), SF).schema.names == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("doc_id < 40").union(odd), SF).count() >= 30
        assert stage(spark, docs.filter("false"), SF).count() == 0


def test_workers_get_rows_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)

    def stage(spark, docs, sf_dir):
        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

        long = spark.range(0, 9000, 1, 1).selectExpr("id AS doc_id", "repeat('abcdefghij', 200) AS text")
        return corpus_pipeline.sparing(long).mapInArrow(sizes, "size long")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", stage)])
    seen = [r["size"] for r in corpus_pipeline.run(spark, SF).collect()]
    assert sum(seen) > 18_000_000 and max(seen) < 3_000_000
    assert spark.conf.get(name) == was


def test_workers_keep_little_and_hash_the_same(monkeypatch):
    text = pa.array(["word " * 300_000 + "x" * 300_000, None, "ä b", "last one"])
    looked = []
    for step in (V.STEP, V.PIECE, 1000):
        monkeypatch.setattr(V, "STEP", step)
        monkeypatch.setattr(V, "_powers", {})
        words, counts = V.word_hashes(*V.bytes_of(text))
        looked.append((words.tolist(), counts.tolist(), V.window_hashes(words, 5).tolist(), quality.Looked(text).features.tolist()))
    assert looked[0] == looked[1] == looked[2]


def test_workers_hand_memory_back(monkeypatch):
    told = []
    monkeypatch.setattr(V, "_powers", {})
    monkeypatch.setattr(V, "release", lambda: told.append(1))
    batches = iter([pa.RecordBatch.from_pydict({"text": ["some words " * 200_000, "b"]})])
    for piece in V.pieces(batches, "text"):
        V.word_hashes(*V.bytes_of(piece.column("text")))
        assert not told
    assert told == [1]
    assert sum(a.nbytes for both in V._powers.values() for a in both) < 4_000_000
