"""Embedding whitening: components by QDWH spectral divide and conquer, then a broadcast projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadq.session import staged

#: Entries become integers: floor(GRID * entry).
GRID = 256
COMPONENTS = 4
#: Partial sums that one task adds up, and the most that the driver does.
FAN_IN = 256
#: Integers below this are exact as doubles.
EXACT = 2**53
EPS = float(np.finfo(np.float64).eps)


# --- the eigenproblem of one d x d matrix ---


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by the QR-based dynamically weighted Halley iteration.

    Weights follow a lower bound of the smallest singular value, so six rounds suffice from a condition number of 1/eps. Each round
    is one QR of the stacked matrix [sqrt(c) X; I], which needs no inverse.
    """
    n = len(a)
    scale = np.linalg.norm(a)
    if scale == 0:
        return np.eye(n)
    x, low = a / scale, EPS
    for _ in range(30):
        gain = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + gain)
        p = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * gain + 8 * (2 - low**2) / (low**2 * root)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        q1, q2 = np.split(np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(n)]))[0], 2)
        new = (q / r) * x + (p - q / r) / np.sqrt(r) * (q1 @ q2.T)
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        moved = np.linalg.norm(new - x)
        x = (new + new.T) / 2
        if abs(1 - low) < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def _bases(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a spectral projector's range and of its complement. Columns are taken by largest remaining norm."""
    rest, picked = projector.copy(), []
    for _ in range(rank):
        j = int(np.argmax(np.einsum("ij,ij->j", rest, rest)))
        q = rest[:, j] / np.linalg.norm(rest[:, j])
        picked.append(projector[:, j])
        rest -= np.outer(q, q @ rest)
    full = np.linalg.qr(np.column_stack([*picked, np.eye(len(projector))]))[0]
    return full[:, :rank], full[:, rank : len(projector)]


def eigen(a: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by falling eigenvalue.

    Spectral divide and conquer: the polar factor U of a - shift gives the projector (U + I) / 2 of the eigenvalues above the shift; in
    bases of its range and its complement the matrix falls into two blocks, which are split alike down to single components. A shift that hits an
    eigenvalue, or leaves one side empty, is replaced by the next one. A block that no shift splits is a multiple of the identity to
    working precision: its basis stays as it is.
    """
    n = len(a)
    a = (a + a.T) / 2
    scale = np.linalg.norm(a) if scale is None else scale
    if n == 1:
        return a[0], np.ones((1, 1))
    diagonal = np.diag(a)
    if np.linalg.norm(a - np.diag(diagonal)) <= EPS * scale / n:
        order = np.argsort(-diagonal, kind="stable")
        return diagonal[order], np.eye(n)[:, order]
    spread = np.linalg.norm(a - np.eye(n) * diagonal.mean())
    for shift in (np.median(diagonal), diagonal.mean(), *(diagonal.mean() + spread * f / n for f in (0.37, -0.37, 0.11, -0.11, 0.83, -0.83, 1.7, -1.7))):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n:
            continue
        upper, lower = _bases(projector, rank)
        if np.linalg.norm(lower.T @ a @ upper) > 50 * n * EPS * scale:
            continue
        parts = [(eigen(basis.T @ a @ basis, scale), basis) for basis in (upper, lower)]
        values = np.concatenate([part[0] for part, _ in parts])
        vectors = np.hstack([basis @ part[1] for part, basis in parts])
        order = np.argsort(-values, kind="stable")
        return values[order], vectors[:, order]
    order = np.argsort(-diagonal, kind="stable")
    return diagonal[order], np.eye(n)[:, order]


# --- sums over rows, as one matrix per task ---


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _split(total: list[int]) -> tuple[list[int], list[int]]:
    """Whole numbers as (high, low) parts of 40 bits below, so that sums of parts can't overflow."""
    return [t >> 40 for t in total], [t & (2**40 - 1) for t in total]


def _summed(df: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """Entrywise sums of array columns, as float64 or Python integers. Tasks add up rows as they stream by; as long as there
    are many tasks their sums are added up in fewer tasks. The driver gets one row for each of at most FAN_IN tasks."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows:
                own = [_matrix(batch.column(i), len(batch.column(i)[0])).sum(axis=0) for i in range(batch.num_columns)]
                sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.list_(pa.from_numpy_dtype(s.dtype))) for s in sums], batch.schema.names)

    tasks = df.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        df = df.repartition(tasks).mapInArrow(add, schema)
    rows = df.collect()
    if not rows:
        return []
    return [np.sum([np.array(r[c], dtype=object if isinstance(r[c][0], int) else float) for r in rows], axis=0) for c in columns]


def _per_task(vectors: DataFrame, work: Callable[[np.ndarray, list | None], list], finish: Callable[[list], tuple], schema: str, width: int) -> DataFrame:
    """One row per task: `work` folds the matrix of each batch into a state, `finish` makes columns of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = work(_matrix(batch.column(0), width), state)
        if state is not None:
            row = finish(state)
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in row], [f"c{i}" for i in range(len(row))])

    return vectors.mapInArrow(run, schema)


# --- the model ---


@dataclass
class Whitening:
    """n distinct vectors, their sums by dimension, unit components as columns, eigenvalues, the covariance's trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(eigenvalue); not a number for components without variance, which can't be whitened."""
        floor = len(self.sums) * EPS * max(self.values.max(initial=0.0), 0.0)
        return np.array([1 / np.sqrt(e) if e > floor else np.nan for e in self.values])


def grid(df: DataFrame, vector: str = "embedding", scale: int = GRID) -> DataFrame:
    """`df` plus x: floor(scale * entry) as longs. Rows whose vector is null, empty, or holds a null or an entry that isn't finite go."""
    entry = F.col(vector).cast("array<double>")
    whole = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & whole).withColumn("x", F.transform(entry, lambda c: F.floor(c * scale)))


def common_width(points: DataFrame) -> int:
    """The most frequent length of x, of equally frequent ones the largest; 0 for an empty table."""
    found = points.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return found["width"] if found else 0


def _covariance(fitted: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance of whole vectors. They are centred at the whole number nearest to the mean before they are multiplied,
    so the products are small, their sums exact, and the result doesn't depend on the order of rows; what the mean is off that
    point is corrected exactly in the end. Vectors too large for that are centred at the mean and summed as doubles."""
    d = len(sums)
    centre = np.array([(2 * int(s) + n) // (2 * n) for s in sums], dtype=np.int64)
    bound = F.transform("x", lambda c: F.abs(c.cast("double")))
    far = fitted.agg(F.max(F.array_max(bound))).first()[0] + float(np.abs(centre.astype(float)).max())
    rows_at_once = int(EXACT / far**2) if far else 1 << 20
    if rows_at_once >= 64:

        def work(x: np.ndarray, state: list | None) -> list:
            z = (x - centre).astype(np.float64)
            state = state or [0, 0]
            for start in range(0, len(z), rows_at_once):
                part = z[start : start + rows_at_once]
                state[0] = state[0] + (part.T @ part).astype(np.int64).astype(object)
                state[1] = state[1] + part.sum(axis=0).astype(np.int64).astype(object)
            return state

        def finish(state: list) -> tuple:
            return (*_split(state[0].ravel().tolist()), state[1].tolist())

        high, low, offset = _summed(_per_task(fitted, work, finish, "c0 array<bigint>, c1 array<bigint>, c2 array<bigint>", d), ["c0", "c1", "c2"])
        products = np.array([(int(h) << 40) + int(b) for h, b in zip(high, low, strict=True)], dtype=object).reshape(d, d)
        exact = products * n - np.outer(offset, offset)
        return np.array([[int(v) / (n * n) for v in row] for row in exact])
    mean = np.array([int(s) / n for s in sums])

    def work_far(x: np.ndarray, state: list | None) -> list:
        z = x.astype(np.float64) - mean
        return [(0 if state is None else state[0]) + z.T @ z]

    return _summed(_per_task(fitted, work_far, lambda s: (s[0].ravel().tolist(),), "c0 array<double>", d), ["c0"])[0].reshape(d, d) / n


def _identity_error(fitted: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the covariance of the whitened fit list, less the identity: one more pass over it, centred at its own mean."""
    usable = np.isfinite(model.scales)
    if not usable.any():
        return None
    mean, turn, n = np.array([int(s) / model.n for s in model.sums]), (model.components * model.scales)[:, usable], model.n
    k = turn.shape[1]

    def total(x: np.ndarray, state: list | None) -> list:
        return [(0 if state is None else state[0]) + ((x.astype(np.float64) - mean) @ turn).sum(axis=0)]

    middle = _summed(_per_task(fitted, total, lambda s: (s[0].tolist(),), "c0 array<double>", len(mean)), ["c0"])[0] / n

    def products(x: np.ndarray, state: list | None) -> list:
        z = (x.astype(np.float64) - mean) @ turn - middle
        return [(0 if state is None else state[0]) + z.T @ z]

    found = _summed(_per_task(fitted, products, lambda s: (s[0].ravel().tolist(),), "c0 array<double>", len(mean)), ["c0"])[0]
    return float(np.abs(found.reshape(k, k) / n - np.eye(k)).max())


def fit(points: DataFrame, components: int | None = COMPONENTS) -> Whitening | None:
    """The whitening of vectors x (longs of one length), each distinct vector counted once. None for an empty table.

    The distinct vectors are found by a hash aggregate, so copies of one vector combine before the shuffle, and written once. Three
    passes over them leave one row per task each. The driver holds matrices of d x d only.
    """
    fitted = staged(points.select("x").distinct(), "whitening-fit")
    width = fitted.select(F.size("x")).first()
    if width is None:
        return None

    def work(x: np.ndarray, state: list | None) -> list:
        state = state or [0, 0]
        safe = float(np.abs(x.astype(float)).max()) * len(x) < 2**62
        return [state[0] + len(x), state[1] + (x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0))]

    def finish(state: list) -> tuple:
        return ([state[0]], *_split(state[1].tolist()))

    count, high, low = _summed(_per_task(fitted, work, finish, "c0 array<bigint>, c1 array<bigint>, c2 array<bigint>", width[0]), ["c0", "c1", "c2"])
    n, sums = int(count[0]), np.array([(int(h) << 40) + int(b) for h, b in zip(high, low, strict=True)], dtype=object)
    covariance = _covariance(fitted, n, sums)
    values, vectors = eigen(covariance)
    k = len(values) if components is None else min(components, len(values))
    model = Whitening(n, sums, vectors[:, :k], values[:k], float(np.trace(covariance)))
    model.identity_error = _identity_error(fitted, model)
    return model


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 as whole numbers; None beyond 64 bits."""
    far = model.n * float(np.abs(x.astype(float)).max()) + max(abs(int(s)) for s in model.sums)
    if far**2 * x.shape[1] < 2**62:
        off = x * model.n - model.sums.astype(np.int64)
        return (off * off).sum(axis=1).tolist()
    off = x.astype(object) * model.n - model.sums
    return [int(v) if v < 2**63 else None for v in (off * off).sum(axis=1)]


def project(points: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """A row per vector and component: key, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error."""
    kind = points.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    shared = points.sparkSession.sparkContext.broadcast(model)  # d x (components + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.values)
        mean = np.array([int(s) / model.n for s in model.sums])
        explained = [e / model.trace if model.trace > 0 else None for e in model.values]
        for batch in batches:
            m = batch.num_rows
            if m == 0:
                continue
            x = _matrix(batch.column(1), len(mean))
            white = ((x.astype(np.float64) - mean) @ (model.components * model.scales)).ravel()
            deviation = np.array(_deviations(x, model), dtype=object).repeat(k)
            columns = [
                batch.column(0).take(pa.array(np.arange(m).repeat(k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array([model.n] * (m * k), pa.int64()),
                pa.array(deviation.tolist(), pa.int64()),
                pa.array(white, from_pandas=True),
                pa.array(explained * m, pa.float64()),
                pa.array([model.identity_error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return points.select(key, "x").mapInArrow(run, schema)


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int | None = COMPONENTS) -> DataFrame:
    """Every usable vector of `df` on the leading components of the distinct ones: see `project` for the columns.

    Entries become floor(256 * entry). Rows whose vector is null, empty, or holds a null or an entry that isn't finite are dropped, and
    so are vectors of another length than the most frequent (of ties the largest). Equal vectors count once in n, the mean and the
    covariance but all their rows come back; rows that share a key, or have none, are rows of their own. There are as many components as dimensions at
    most. A component without variance has a null whitened value; if no vector varies, explained is null too. deviation is exact, or null
    beyond 64 bits. An empty table gives an empty result. Other columns are ignored. Only d x d numbers reach the driver, and d x
    components numbers are broadcast.
    """
    points = grid(df.select(F.col(f"`{key}`"), F.col(f"`{vector}`")), vector).select(F.col(f"`{key}`"), "x")
    width = common_width(points)
    points = points.filter(F.size("x") == width)
    model = fit(points, components) or Whitening(0, np.zeros(0, object), np.zeros((0, 0)), np.zeros(0), 0.0)
    return project(points, model, key)
