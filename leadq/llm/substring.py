"""Substring deduplication: repeated windows of words, merged into maximal removal intervals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadq.llm import textvec as V
from leadq.llm.frames import even_keys, partitions, text_of

WIDTH = 20
#: Windows that a task gathers before it sends them on.
CHUNK = 1 << 21
#: Bytes of text whose windows meet in one task. A text of n bytes has at most n / 2 windows, so a task holds
#: 4 million of them at most and a third of that in common prose.
TASK_BYTES = 1 << 23
#: Stands for a null doc_id: the smallest.
NO_ID = -(2**63)


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as compressed differences: the sign in the lowest bit, and the lowest bytes of all values first, then the next."""
    steps = np.concatenate([np.diff(a, prepend=0).astype(np.int64) for a in arrays])
    steps = (steps << 1) ^ (steps >> 63)
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(blob: bytes, *lengths: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    steps = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()
    steps = ((steps >> 1) & np.int64(2**63 - 1)) ^ -(steps & 1)
    return [np.cumsum(part) for part in np.split(steps, np.cumsum(lengths)[:-1])]


def _rows(bucket: int, names: np.ndarray, docs: np.ndarray, starts: np.ndarray, hashes: np.ndarray | None) -> dict:
    """A row for windows in the order of documents: which documents, how many windows each, their starts, their hashes.
    `docs` are numbers of documents in `names`, whose rows are doc_id and text key."""
    bounds = V.group_bounds(docs)
    own = names[docs[bounds[:-1]]]
    return {
        "bucket": bucket,
        "n_docs": len(own),
        "places": _pack(own[:, 0], np.diff(bounds), starts),
        "keys": own[:, 1].tobytes(),
        "n": len(docs),
        "hashes": None if hashes is None else hashes.tobytes(),
    }


def _numbered(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, numbers): the distinct documents by doc_id, then text key, and which of them each given one is."""
    order = np.lexsort((keys, ids))
    ids, keys = ids[order], keys[order]
    bounds = V.group_bounds(ids, keys)
    numbers = np.empty(len(order), dtype=np.int32)
    numbers[order] = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    return np.stack([ids[bounds[:-1]], keys[bounds[:-1]]], axis=1), numbers


def _unpacked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, docs, starts) of the windows of all rows."""
    places = []
    for row in rows:
        ids, counts, at = _unpack(row["places"], row["n_docs"], row["n_docs"], row["n"])
        places.append((ids, counts, at.astype(np.int32)))
    keys = np.concatenate([np.frombuffer(row["keys"], dtype=np.int64) for row in rows])
    names, numbers = _numbered(np.concatenate([p[0] for p in places]), keys)
    docs = np.repeat(numbers, np.concatenate([p[1] for p in places]))
    return names, docs, np.concatenate([p[2] for p in places])


def _by_home(names: np.ndarray, docs: np.ndarray, starts: np.ndarray, homes: int, first_home: int = 0) -> Iterator[dict]:
    """Rows for places known to go, one per home of their documents. Homes are numbered from `first_home`."""
    ids, keys = names.view(np.uint64).T
    home = (V.mix64(V.mix64(ids) + keys) % np.uint64(homes)).astype(np.int32)[docs]
    order = np.lexsort((starts, docs, home))
    docs, starts, home = docs[order], starts[order], home[order]
    bounds = V.group_bounds(home)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield _rows(first_home + int(home[a]), names, docs[a:b], starts[a:b], None)


def _sent(
    names: np.ndarray, docs: np.ndarray, starts: np.ndarray, hashes: np.ndarray, buckets: np.ndarray, n_buckets: int, homes: int
) -> Iterator[dict]:
    """Rows for the windows of a chunk, given by document and start. A window that repeats in the chunk is sent
    once, from where it starts first; its later places are known to go and are sent without a hash to the homes
    of their documents, which are numbered from `n_buckets`."""
    order = np.argsort(hashes, kind="stable")
    bounds = V.group_bounds(hashes[order])
    first = np.repeat(order[bounds[:-1]], np.diff(bounds))
    again = order[(docs[order] != docs[first]) | (starts[order] != starts[first])]
    if len(again):
        yield from _by_home(names, docs[again], starts[again], homes, n_buckets)
    sent = order[bounds[:-1]]
    sent.sort()
    sent = sent[np.argsort(buckets[sent], kind="stable")]
    cuts = V.group_bounds(buckets[sent])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = sent[a:b]
        yield _rows(int(buckets[at[0]]), names, docs[at], starts[at], hashes[at])


def _windows(batches: Iterable[pa.RecordBatch], width: int, n_buckets: int, homes: int, chunk: int) -> Iterator[dict]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[dict]:
        ids, keys, own, starts, hashes, buckets = (np.concatenate(x) for x in zip(*held, strict=True))
        names, numbers = _numbered(ids, keys)
        docs = np.repeat(numbers, own)
        if (np.diff(docs) < 0).any():
            order = np.lexsort((starts, docs))
            docs, starts, hashes, buckets = docs[order], starts[order], hashes[order], buckets[order]
        return _sent(names, docs, starts, hashes, buckets, n_buckets, homes)

    for batch in V.pieces(batches, "text"):
        words, counts = V.word_hashes(*V.bytes_of(batch.column("text")))
        at, own = V.window_starts(counts, width)
        if not len(at):
            continue
        ids, keys = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "text_key"))
        starts = (at - np.repeat(np.cumsum(counts) - counts, own)).astype(np.int32)
        hashes = V.mix64(V.window_hashes(words, width)[at])
        buckets = (V.mix64(V.window_hashes(words, width, V.BASE2)[at]) % np.uint64(n_buckets)).astype(np.int32)
        held.append((ids, keys, own, starts, hashes, buckets))
        size += len(at)
        if size >= chunk:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


_SENT = "part int, bucket int, n_docs int, places binary, keys binary, n int, hashes binary"
_SENT_ARROW = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("n_docs", pa.int32()), ("places", pa.binary()), ("keys", pa.binary()), ("n", pa.int32()), ("hashes", pa.binary())])


def _dealt(rows: Iterable[dict], parts: np.ndarray) -> list[dict]:
    """Rows with the part that their bucket or home belongs to."""
    return [{"part": int(parts[row["bucket"] % len(parts)]), **row} for row in rows]


def _later_places(table: pa.Table, parts: np.ndarray) -> pa.Table:
    """Of the windows of a bucket, those whose hash also stands at a smaller document or start; a row per home. Rows
    that are on their way home go on as they are."""
    bucket = table.column("bucket")[0].as_py()
    if bucket >= len(parts):
        return table.set_column(1, "bucket", pa.array(np.full(len(table), bucket - len(parts), dtype=np.int32)))
    rows = table.to_pylist()
    names, d, s = _unpacked(rows)
    h = np.concatenate([np.frombuffer(row["hashes"], dtype=np.uint64) for row in rows])
    order = np.argsort(h)
    bounds = V.group_bounds(h[order])
    several = order[np.repeat(np.diff(bounds) > 1, np.diff(bounds))]
    several = several[np.lexsort((s[several], d[several], h[several]))]
    bounds = V.group_bounds(h[several])
    first = np.repeat(several[bounds[:-1]], np.diff(bounds))
    later = several[(d[several] != d[first]) | (s[several] != s[first])]
    return pa.Table.from_pylist(_dealt(_by_home(names, d[later], s[later], len(parts)), parts), schema=_SENT_ARROW)


def _cover(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal intervals (from, to) of words that windows at sorted `starts` cover."""
    new = np.flatnonzero(np.diff(starts) > width)
    return starts[np.concatenate([[0], new + 1])], starts[np.concatenate([new, [len(starts) - 1]])] + width


def _merged(table: pa.Table, width: int) -> pa.Table:
    """doc_id, text_key, begins, ends of the documents of a home: windows to remove merged into maximal intervals."""
    names, d, s = _unpacked(table.to_pylist())
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    bounds = V.group_bounds(d)
    covers = [_cover(s[a:b], width) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    kind = pa.list_(pa.int32())
    own = names[d[bounds[:-1]]]
    begins, ends = (pa.array([c[i] for c in covers], kind) for i in (0, 1))
    return pa.table({"doc_id": own[:, 0], "text_key": own[:, 1], "begins": begins, "ends": ends})


def _text_key() -> Column:
    """Tells rows with one doc_id, or without any, apart by their texts."""
    return F.xxhash64(text_of())


def task_parts(docs: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks among which the windows of `docs` are dealt: one for each `task_bytes` of text, but not fewer than there are
    shuffle partitions."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_of())), F.lit(0))).first()[0]
    return max(partitions(docs), -(-size // task_bytes))


def removal_intervals(docs: DataFrame, width: int = WIDTH, task_bytes: int = TASK_BYTES, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_key and the document's maximal intervals of words to remove, as arrays `begins` and `ends` (end exclusive).

    A document is a doc_id (null: NO_ID) and a text, named by a 64-bit hash of it, so rows share intervals
    only if their texts are equal.

    Each window of `width` words has a 64-bit Rabin-Karp hash and, by a second hash, a bucket; both
    together identify it. There is a bucket for each `task_bytes` of all texts, so what a
    task holds at once doesn't grow with the corpus; the chance that any two different windows of n share
    both is n^2 / (2^65 * buckets). A task sends a hash that repeats within a chunk of its windows
    once, so the most common window arrives in its bucket once per chunk, not once per document. Its other places
    and what a bucket finds go back packed by the home of the document, a hash of its name. Buckets and homes are dealt
    to tasks in turn, not by hash. A row carries what a chunk has for one bucket: far beyond
    10^5 parts, raise `task_bytes` and `chunk` together.
    """
    n_parts = task_parts(docs, task_bytes)
    parts = np.array(even_keys(docs, n_parts), dtype=np.int32)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), _text_key().alias("text_key"), "text")

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _windows(batches, width, n_parts, n_parts, chunk):
            yield pa.RecordBatch.from_pylist(_dealt([row], parts), schema=_SENT_ARROW)

    def judge(table: pa.Table) -> pa.Table:
        return _later_places(table, parts)

    def merge(table: pa.Table) -> pa.Table:
        return _merged(table, width)

    def met(sent: DataFrame):
        return sent.repartition(n_parts, "part").groupBy("part", "bucket")

    later = met(rows.mapInArrow(send, _SENT)).applyInArrow(judge, _SENT)
    return met(later).applyInArrow(merge, "doc_id long, text_key long, begins array<int>, ends array<int>")


def remove_repeats(docs: DataFrame, width: int = WIDTH, task_bytes: int = TASK_BYTES, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_removed, begins, ends, kept_text of every row of `docs`.

    A word goes if a window of `width` words covers it whose words also start earlier: in a document with a
    smaller doc_id or further up in the same one. kept_text joins the other words by one space. Null
    texts count as empty; a null doc_id is the smallest. Rows with one doc_id, or without any, are one document if their
    texts are equal: they don't repeat each other, and the same words go in all. If their texts differ they are documents
    of their own, in the order of a hash of the text. Other columns are ignored.
    An empty table gives an empty result. `docs` should be a table: hot windows are combined per task, so a task that
    runs again must see its rows in the same order.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=1)
        for batch in V.pieces(batches, "text", 8 * V.PIECE):
            packed = [shrink.compress((text.as_py() or "").encode()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "__id", "__key")), pa.array(packed, pa.binary())], ["doc_id", "__id", "__key", "packed"])

    # texts travel to their intervals compressed, which takes a third less than the shuffle's own compression
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("__id"), _text_key().alias("__key"), "text")
    rows = rows.mapInArrow(pack, f"doc_id {kind}, __id long, __key long, packed binary")
    gone = removal_intervals(docs, width, task_bytes, chunk).withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})

    def strip(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in V.pieces(batches, "packed", 4 * V.PIECE):
            counts, removed, kept = [], [], []
            for packed, begins, ends in zip(*(batch.column(c) for c in ("packed", "begins", "ends")), strict=True):
                words = unpack.decompress(packed.as_py()).split()
                counts.append(len(words))
                stay = words
                if begins.is_valid and len(begins):
                    stay, at = [], 0
                    for a, b in zip(begins.values.to_numpy(), ends.values.to_numpy(), strict=True):
                        stay += words[at:a]
                        at = b
                    stay += words[at:]
                removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), batch.column("begins"), batch.column("ends"), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "begins", "ends", "kept_text"])

    schema = f"doc_id {kind}, n_words long, n_removed long, begins array<int>, ends array<int>, kept_text string"
    return rows.join(gone, ["__id", "__key"], "left").mapInArrow(strip, schema)
