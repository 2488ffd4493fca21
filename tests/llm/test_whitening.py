import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from leadq.llm import whitening as W  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute(rows, k=4):
    """{(key, occurrence)...} with numpy's eigensolver."""
    x = np.floor(256 * np.array([v for _, v in rows], dtype=float)).astype(np.int64)
    fitted = np.unique(x, axis=0)
    n, sums = len(fitted), fitted.sum(axis=0)
    centred = fitted - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_eigen_of_hard_spectra(d):
    rng = np.random.default_rng(d)
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    for values in (rng.random(d), 10.0 ** -np.arange(d), np.repeat([1.0, 2.0], [d // 2, d - d // 2]), np.ones(d), np.zeros(d), 1 + 1e-9 * rng.random(d), rng.normal(size=d)):
        a = (turn * values) @ turn.T
        a = (a + a.T) / 2
        got, vectors = W.eigen(a)
        size = np.linalg.norm(a) or 1
        assert np.all(np.diff(got) <= 0) and np.abs(got - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13 and np.abs(a @ vectors - vectors * got).max() <= 1e-13 * size


def test_polar_factor():
    a = np.diag([3.0, 1e-9, -1e-12, -5.0])
    assert np.allclose(W.polar(a), np.diag([1, 1, -1, -1]), atol=1e-12)


def test_query_against_numpy(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    raw = df.select("vec_id", "embedding").collect()
    n, deviation, white, explained = brute([tuple(r) for r in raw])
    got = {(r.vec_id, r.component): r for r in W.whiten(df).collect()}
    assert len(got) == 4 * len(raw)
    for c in range(4):
        own = [got[r.vec_id, c + 1] for r in raw]
        sign = np.sign(sum(o.whitened * w for o, w in zip(own, white[:, c])))
        assert np.allclose([o.whitened for o in own], sign * white[:, c], rtol=0, atol=1e-10)
        assert [o.deviation for o in own] == deviation.tolist() and {o.n for o in own} == {n}
        assert np.allclose([o.explained for o in own], explained[c], rtol=1e-9) and max(o.identity_error for o in own) < 1e-9


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("x", "n", "component", "whitened")})


def test_odd_rows(spark):
    good = [(1, [0.5, 1.0, 2.0]), (2, [0.5, -1.0, 0.25]), (2, [0.1, 0.2, 0.9]), (None, [3.0, 0.0, 1.0]), (5, [0.5, 1.0, 2.0]), (6, [0.50001, 1.0, 2.0]), (7, [9.0, 9.0, -9.0])]
    bad = [(10, None), (11, [1.0, None, 2.0]), (12, [float("nan"), 1.0, 2.0]), (13, [float("inf"), 1.0, 2.0]), (14, []), (15, [1.0]), (16, [1.0, 2.0])]
    got = W.whiten(frame(spark, bad + good * 3)).collect()
    n, deviation, white, explained = brute(good)
    assert n == 5 and len(got) == 3 * 3 * len(good)
    assert sorted(r.deviation for r in got) == sorted(deviation.tolist() * 9)
    for c in range(3):
        assert np.allclose(sorted(abs(r.whitened) for r in got if r.component == c + 1), sorted(abs(white[:, c]).tolist() * 3))
        assert np.allclose([r.explained for r in got if r.component == c + 1], explained[c])
    assert W.whiten(frame(spark, [])).count() == 0 and W.whiten(frame(spark, bad[:5])).count() == 0


def test_vectors_without_variance(spark):
    same = W.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(4)])).collect()
    assert len(same) == 8 and all(r.n == 1 and r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in same)
    line = W.whiten(frame(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True)}
    assert all(abs(r.explained - (2 - r.component)) < 1e-12 and r.identity_error < 1e-9 for r in line)


def test_large_entries(spark):
    rows = [(i, [1e9 * (i % 7), float(i % 5), -3e8 * (i % 3)]) for i in range(40)]
    got = W.whiten(frame(spark, rows)).collect()
    n, _, white, _ = brute(rows)
    assert len(got) == 120 and max(r.identity_error for r in got) < 1e-4
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in rows]
    distinct = {tuple(v) for v in x}
    sums = [sum(v[j] for v in distinct) for j in range(3)]
    exact = [sum((len(distinct) * v[j] - sums[j]) ** 2 for j in range(3)) for v in x]
    assert sorted((r.deviation is None, r.deviation or 0) for r in got if r.component == 1) == sorted((e >= 2**63, e if e < 2**63 else 0) for e in exact)


def test_sums_of_many_tasks(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    points = W.grid(df).select("vec_id", "x").repartition(9)
    whole = W.fit(points)
    monkeypatch.setattr(W, "FAN_IN", 2)
    cut = W.fit(points)
    assert whole.n == cut.n and list(whole.sums) == list(cut.sums) and np.array_equal(whole.components, cut.components)
