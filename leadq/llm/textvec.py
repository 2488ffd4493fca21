"""Whole Arrow batches of texts as numpy arrays: words, hashes of words and of word windows.

Hashes are polynomials modulo 2^64 over random values, with an odd base, so that a difference of prefix
sums times a power of the inverse base is the hash of any span (Rabin-Karp without a loop).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once. A longer text is one piece; only its words are kept whole.
PIECE = 1 << 20
#: Bytes or words that are hashed at once: the powers kept by a worker and the arrays of a step are that long. Hashes don't depend on it.
STEP = 1 << 17
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xC2B2AE3D27D4EB4F

_random = np.random.default_rng(2024)
_BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finishing step of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, STEP + 4096)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span; spans ascend."""
    up, down = powers(len(values) + 1, base)
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column, null as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], text: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes in a string or binary column each, one row at least. After the last one the
    worker, which later tasks use again, hands back the memory that it doesn't need."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
        del batch
    release()


def release() -> None:
    """Hand free memory back to the system: Arrow's own, and that of the C library, which numpy and Python use."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts): byte spans of all words, and the number of words of each text."""
    inside = _IS_WORD[data]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    edge = np.empty(len(data), dtype=bool)
    edge[:1] = True
    edge[1:] = ~inside[:-1]
    edge[cuts] = True
    starts = np.flatnonzero(inside & edge)
    edge[-1:] = True
    edge[:-1] = ~inside[1:]
    edge[cuts - 1] = True
    ends = np.flatnonzero(inside & edge) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, number of words of each text)."""
    starts, ends, counts = word_spans(data, offsets)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + STEP, side="right")))
        out[i:j] = spans(_BYTE_VALUES[data[a : ends[j - 1]]], starts[i:j] - a, ends[i:j] - a, BASE)
        i = j
    out += (ends - starts).astype(np.uint64)
    return mix64(out), counts


def window_hashes(words: np.ndarray, width: int, base: int = BASE) -> np.ndarray:
    """Hash of every window of `width` word hashes (also of those that cross texts)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for i in range(0, n, STEP):
        m = min(STEP, n - i)
        starts = np.arange(m)
        out[i : i + m] = spans(words[i : i + m + width - 1], starts, starts + width, base)
    return out


def window_starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the windows that lie in one text, number of them in each text)."""
    own = np.maximum(counts - width + 1, 0)
    first = np.cumsum(counts) - counts
    within = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    return np.repeat(first, own) + within, own


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups only, from batches sorted by integer `keys`."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        differs = np.zeros(batch.num_rows, dtype=bool)
        goes_on = bool(kept)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            differs |= values != values[-1]
            goes_on = goes_on and kept[-1].column(k)[-1].as_py() == values[-1]
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut or not goes_on:
            done = [*kept, batch.slice(0, cut)] if cut else kept
            if done:
                yield pa.Table.from_batches(done)
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """Where the groups of sorted key columns start, plus the end."""
    n = len(columns[0])
    new = np.zeros(max(n - 1, 0), dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]]) if n else np.zeros(1, dtype=np.int64)
