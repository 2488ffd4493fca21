"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame

from leadq.llm import textvec as V

#: Characters that are pre-tokenised at once.
STRETCH = 1 << 20
#: Pre-tokens that a worker remembers, about; the least recently used go first.
REMEMBERED = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a .tiktoken file: a token in base64 and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Minimal perfect hash of a fixed set of keys (hash and displace), with the key and value at its slot.

    Keys fall into buckets of about three. From the largest bucket on, each gets the first displacement that sends all
    its keys to free slots; buckets of one key are pointed at a free slot directly (as -slot - 1).
    """

    def __init__(self, items: dict[bytes, int]):
        self.n = n = max(1, len(items))
        self.n_buckets = n // 3 + 1
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        self.shift = [0] * self.n_buckets
        buckets: list[list[bytes]] = [[] for _ in range(self.n_buckets)]
        for key in items:
            buckets[xxhash.xxh3_64_intdigest(key) % self.n_buckets].append(key)
        free = n - 1
        second = {key: xxhash.xxh3_64_intdigest(key, 1) for key in items}
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:
                while self.keys[free] is not None:
                    free -= 1
                slots, self.shift[b] = [free], -free - 1
            else:
                d = 0
                while True:
                    slots = [self._slot(second[key], d) for key in own]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                    d += 1
                self.shift[b] = d
            for key, s in zip(own, slots, strict=True):
                self.keys[s], self.values[s] = key, items[key]

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 24) % self.n

    def get(self, key: bytes) -> int | None:
        d = self.shift[xxhash.xxh3_64_intdigest(key) % self.n_buckets]
        s = -d - 1 if d < 0 else self._slot(xxhash.xxh3_64_intdigest(key, 1), d)
        return self.values[s] if self.keys[s] == key else None


def merge(piece: bytes, rank_of: Callable[[bytes], int | None]) -> list[int]:
    """Ranks of the tokens of a pre-token: the pair of neighbours with the lowest rank, leftmost first, is
    joined until no pair is in the vocabulary. Nodes are linked by where they end and by what stands before."""
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = rank_of(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if j < 0 or j >= e or end[j] != e:  # one of the two has been joined to something else
            continue
        end[i], end[j] = e, -1
        if e < n:
            before[e] = i
            r = rank_of(piece[i : end[e]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[e]))
        p = before[i]
        if p >= 0:
            r = rank_of(piece[p:e])
            if r is not None:
                heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(rank_of(piece[i : end[i]]))
        i = end[i]
    return out


class _Remembered(dict):
    """str pre-token -> its ids as little-endian 32-bit integers; what isn't remembered is worked out. When half of the
    entries are new, those not used since the last time are forgotten."""

    def __init__(self, vocabulary: PerfectHash, ranks: dict[bytes, int], most: int):
        super().__init__()
        self.vocabulary, self.rank_of, self.most = vocabulary, ranks.get, most
        self.before: dict[str, bytes] = {}

    def __missing__(self, token: str) -> bytes:
        out = self.before.get(token)
        if out is None:
            piece = token.encode()
            whole = self.vocabulary.get(piece)
            ids = [whole] if whole is not None else merge(piece, self.rank_of)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.most // 2:
            self.before = dict(self)
            self.clear()
        self[token] = out
        return out


class Codec:
    """Encodes and decodes as a byte-level BPE without special tokens.

    Each match of `pattern` is encoded by itself. A text is pre-tokenised in stretches that end
    before a single space between two other characters, where the pattern always breaks.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.vocabulary, self.ranks = PerfectHash(ranks), ranks
        self.pattern, self.remembered = pattern, remembered
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _stretches(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > STRETCH:
            found = self._break.search(text, at + STRETCH)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not hasattr(self, "_split"):
            self._split = regex.compile(self.pattern).findall
            self._break = regex.compile(r"(?<=\S) (?=\S)")
            self._known = _Remembered(self.vocabulary, self.ranks, self.remembered)
        return b"".join(b"".join(map(self._known.__getitem__, self._split(part))) for part in self._stretches(text))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist()))


@functools.lru_cache(maxsize=4)
def load(path: str, pattern: str, remembered: int = REMEMBERED) -> Codec:
    """The codec of a vocabulary file that the driver can read."""
    return Codec(load_ranks(path), pattern, remembered)


_sent: dict[tuple[str, int], tuple[Codec, Broadcast]] = {}


def shared(docs: DataFrame, codec: Codec) -> Broadcast:
    """The codec for tasks: one broadcast per application, whose size is that of the vocabulary file whatever the corpus."""
    context = docs.sparkSession.sparkContext
    key = (context.applicationId, id(codec))
    if key not in _sent:
        _sent[key] = codec, context.broadcast(codec)
    return _sent[key][1]


def encode(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of every whole text.

    Null texts count as empty and give no ids. Rows are independent of each other: nothing is shuffled, repeated rows
    give repeated results, other columns are ignored, an empty table gives an empty result.
    """
    sent = shared(docs, codec)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in V.pieces(batches, "text", 4 * V.PIECE):
            ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
            arrays = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """All rows and columns of `encoded` plus decoded, the bytes that its ids stand for."""
    sent = shared(encoded, codec)
    schema = encoded.drop("decoded").schema.add("decoded", "binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in V.pieces(batches, "ids", 4 * V.PIECE):
            decoded = [None if x is None else own.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.drop("decoded").mapInArrow(run, schema)


def digests(docs: DataFrame, codec: Codec, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: encoded, decoded again, both digested in one pass.
    Also the ids themselves if asked for."""
    sent = shared(docs, codec)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in V.pieces(batches, "text", 4 * V.PIECE):
            counts, of_ids, of_text, all_ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = own.encode(text or "")
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(all_ids, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
