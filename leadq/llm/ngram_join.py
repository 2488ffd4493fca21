"""N-gram Jaccard join: MinHash bands find candidate pairs, full n-gram sets decide them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadq.llm import textvec as V
from leadq.llm.frames import bands_for, partitions, small
from leadq.operators.graph import connected_components
from leadq.session import staged

WIDTH = 5
THRESHOLD = 0.8
#: Share of the pairs at the threshold that have a band in common. Pairs above it miss less.
RECALL = 0.999
HASHES = 144
#: Documents of a cell, and words of their texts, about. Two cells meet in one group of rows, so no group holds more than two.
BLOCK = 256
BLOCK_WORDS = 1 << 18
#: Members of a bucket that meet its cells in one part of the join.
SIDE = 2048
#: Word sequences that a task remembers, so that copies of one text leave it once.
SEEN = 1 << 16


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, number per text, word hashes, words per text). A text of fewer than `width` words is one shingle."""
    words, counts = V.word_hashes(*V.bytes_of(texts))
    at, own = V.window_starts(counts, width)
    hashes = V.window_hashes(words, width)[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = (np.cumsum(counts) - counts)[short]
        whole = V.spans(words, first, first + counts[short], V.BASE) + counts[short].astype(np.uint64)
        hashes = np.insert(hashes, (np.cumsum(own) - own)[short], whole)
        own = own.copy()
        own[short] = 1
    return V.mix64(hashes), own, words, counts


def band_hashes(hashes: np.ndarray, own: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Texts x bands: hash of each band of the MinHash signature of each text that has shingles."""
    random = np.random.default_rng(5)
    flips = random.integers(0, 2**63, bands * rows, dtype=np.uint64)
    odds = random.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = (np.cumsum(own) - own)[own > 0]
    out = np.empty((len(starts), bands), dtype=np.uint64)
    work = np.empty_like(hashes)
    for b in range(bands):
        band = np.full(len(starts), b + 1, dtype=np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            np.bitwise_xor(hashes, flips[k], out=work)
            np.multiply(work, odds[k], out=work)
            band = V.mix64(band * np.uint64(V.BASE2) + np.minimum.reduceat(work, starts))
        out[:, b] = band
    return out


def sequence_hashes(words: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the word sequence of each text. Texts without words get different ones: they are no copies."""
    first = np.cumsum(counts) - counts
    keys = [V.mix64(V.spans(words, first, first + counts, b)).view(np.int64) for b in (V.BASE, V.BASE2)]
    bare = np.flatnonzero(counts == 0)
    for key in keys:
        key[bare] = bare
    return keys


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """id, n_words, two hashes of the word sequence, and the band hashes of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.pieces(batches, "text"):
            hashes, own, words, counts = shingles(batch.column("text"), width)
            keys = sequence_hashes(words, counts)
            found = band_hashes(hashes, own, bands, rows).view(np.int64).ravel() if own.any() else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum((own > 0) * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts.astype(np.int64)), *map(pa.array, keys), lists], ["id", "n_words", "a", "b", "bands"])

    return docs.mapInArrow(run, "id long, n_words long, a long, b long, bands array<long>")


def _cell(home: str, part: str) -> Column:
    return F.xxhash64(home, part)


def _placed(members: DataFrame, block: int, block_words: int) -> DataFrame:
    """`members(h, n, rep, n_words)` -> rep, home, cell, parts, docs. Documents have a home: of all documents that they share a bucket with, and
    themselves, the one with the largest buckets. So near copies of one text have the plainest of them as their home. The `docs` documents of
    a home are dealt over as many cells as keep each at about `block` documents and `block_words` words."""
    weights = members.groupBy("rep").agg(F.struct(F.sum("n").alias("weight"), F.col("rep").alias("home")).alias("hub"))
    hubs = members.select("h", "rep").join(weights, "rep").groupBy("h").agg(F.max("hub").alias("hub"))
    homes = members.join(hubs, "h").groupBy("rep").agg(F.max("hub")["home"].alias("home"), F.max("n_words").alias("n_words"))
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_words") / block_words))
    sizes = homes.groupBy("home").agg(parts.alias("parts"), F.count("*").alias("docs"))
    dealt = homes.join(sizes, "home").withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    return dealt.select("rep", "home", _cell("home", "part").alias("cell"), "parts", "docs")


def _group(cell: str, other: str) -> list[Column]:
    """The name of the group in which two cells meet."""
    return [F.least(cell, other).alias("x"), F.greatest(cell, other).alias("y")]


def meetings(reps: DataFrame, block: int = BLOCK, block_words: int = BLOCK_WORDS, side: int = SIDE) -> DataFrame:
    """`reps(rep, n_words, bands)` -> rep, cell, x, y: which documents the group of the cells x and y (x <= y) is made of, each once.

    Every pair of documents with a band hash in common is in exactly one group, that of their two cells. Pairs are not
    written. All cells of a home meet, because its documents share a band with one document: m near copies are m rows for
    each of their m / `block` cells, however many bands they share. Only documents that share a bucket across homes are
    looked up by bucket; a large bucket does that in parts of `side` documents and `side` cells.
    """
    rows = reps.select("rep", "n_words", F.explode("bands").alias("h"))
    buckets = rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    members = staged(rows.join(buckets, "h"), "members")
    placed = staged(_placed(members, block, block_words), "placed")
    within = placed.filter("docs > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    within = within.select("rep", "cell", _cell("home", "part").alias("other")).select("rep", "cell", *_group("cell", "other"))

    found = members.select("h", "n", "rep").join(placed.select("rep", "home", "cell"), "rep")
    mixed = found.groupBy("h").agg(F.min("home").alias("low"), F.max("home").alias("high")).filter("low < high").select("h")
    found = staged(found.join(mixed, "h"), "mixed")
    parts = F.ceil(F.col("n") / side)
    every = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    own = found.select("h", "rep", "home", "cell", F.pmod(F.xxhash64("rep"), parts).alias("i"), every.alias("j")).alias("own")
    cells = found.select("h", "n", "home", "cell").distinct()
    cells = cells.select("h", "home", "cell", F.pmod(F.xxhash64("cell"), parts).alias("j"), every.alias("i")).alias("met")
    same = [F.col(f"own.{c}") == F.col(f"met.{c}") for c in ("h", "i", "j")]
    across = own.join(cells, reduce(and_, same) & (F.col("own.home") != F.col("met.home")))
    return within.unionByName(across.select("rep", "own.cell", *_group("own.cell", "met.cell")).distinct())


def _sequences(docs: DataFrame, seen: int | None = None) -> DataFrame:
    """`docs` plus __n, the number of words, and __a and __b, two hashes of the word sequence. With `seen`, copies of one text leave a task about once:
    it remembers so many of them."""
    schema = docs.select("*").schema.add("__n", "long").add("__a", "long").add("__b", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int, int]] = set()
        for batch in V.pieces(batches, "text"):
            words, counts = V.word_hashes(*V.bytes_of(batch.column("text")))
            added = [pa.array(c.astype(np.int64)) for c in (counts, *sequence_hashes(words, counts))]
            batch = pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)
            if seen is not None:
                new = []
                for i, key in enumerate(zip(*(c.to_pylist() for c in added), strict=True)):
                    if key not in known:
                        if len(known) >= seen:
                            known.clear()
                        known.add(key)
                        new.append(i)
                batch = batch.take(pa.array(new, pa.int64()))
            yield batch

    return docs.mapInArrow(run, schema)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """node and its sorted distinct shingle hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.pieces(batches, "text"):
            hashes, own, _, _ = shingles(batch.column("text"), width)
            ends = np.cumsum(own)
            sets = [np.unique(hashes[e - n : e]).tobytes() for e, n in zip(ends, own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles binary")


def common_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Size of the intersection of sets[x] and sets[y] for each pair."""
    if len(x) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y, strict=True)], dtype=np.int64)
    # many pairs of few sets: multiply the matrix of the shingles that two sets at least have, some columns at a time
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    common = np.zeros((len(sets), len(sets)), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    wide = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        s, e = np.searchsorted(column, [at, at + wide])
        has = np.zeros((len(sets), wide), dtype=np.float32)
        has[owner[s:e], column[s:e] - at] = 1
        common += (has @ has.T).astype(np.int64)  # at most `wide` each, so exact
    return common[x, y]


def band_pairs(bands: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a row in `left` and a row in `right` of `bands` that have a band hash in common; each once if both are the same rows."""
    met = np.zeros((len(left), len(right)), dtype=bool)
    for k in range(bands.shape[1]):
        met |= bands[left, k][:, None] == bands[right, k][None, :]
    if left is right:
        met = np.triu(met, 1)
    a, b = np.nonzero(met)
    return left[a], right[b]


def _linked(group: pa.Table, threshold: float) -> tuple[list[int], list[int], list[int]]:
    """Of the group of two cells: its linked nodes, how many documents each is linked with here, and the smallest node each is
    tied to here."""
    group = group.sort_by("node")
    nodes, weight, cell = (group.column(c).to_numpy() for c in ("node", "copies", "cell"))
    own = [np.frombuffer(blob, dtype=np.uint64) for blob in group.column("shingles").to_pylist()]
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
    low, high = group.column("x")[0].as_py(), group.column("y")[0].as_py()
    left = np.flatnonzero(cell == low)
    x, y = band_pairs(bands, left, left if low == high else np.flatnonzero(cell == high))
    common = common_counts(own, x, y)
    sizes = np.array([len(s) for s in own])
    near = common / (sizes[x] + sizes[y] - common) >= threshold
    x, y = x[near], y[near]
    links = np.zeros(len(nodes), dtype=np.int64)
    np.add.at(links, x, weight[y])
    np.add.at(links, y, weight[x])
    root = np.arange(len(nodes))
    while True:  # the smallest root reached spreads along the links
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            break
        root = low
    some = links > 0
    return nodes[some].tolist(), links[some].tolist(), nodes[root[some]].tolist()


def _verified(met: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """node, links, low for every group of `met(node, cell, x, y)` and linked node in it. `sets` has node, copies, bands, shingles."""
    sent = met.join(sets, "node").select("x", "y", "cell", "node", "copies", "bands", "shingles")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in V.whole_groups(batches, ["x", "y"]):
            cuts = V.group_bounds(*(table.column(c).to_numpy() for c in ("x", "y")))
            found: tuple[list[int], ...] = ([], [], [])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                for all_of, some in zip(found, _linked(table.slice(s, e - s), threshold), strict=True):
                    all_of += some
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["node", "links", "low"])

    return sent.repartition(partitions(met), "x", "y").sortWithinPartitions("x", "y").mapInArrow(run, "node long, links long, low long")


def _resolved(docs: DataFrame, width: int, threshold: float, recall: float, hashes: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(id, n_words, a, b of every row; a, b, n_words, rep, copies, low, nameless, links, component of every class of
    equal word sequences). A node of the graph is a class under a number of its own, so what rows have as doc_id, or
    whether they have one, changes no link. Numbers hold because the classes are staged."""
    bands, rows = bands_for(threshold, recall, hashes)
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    signed = staged(signatures(own, width, bands, rows), "signatures")
    key = ["a", "b", "n_words"]
    classes = signed.filter("n_words > 0").groupBy(*key).agg(
        F.min("id").alias("low"), F.count_if(F.col("id").isNull()).alias("nameless"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")
    )
    classes = staged(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    met = staged(meetings(classes.select("rep", "n_words", "bands"), block).withColumnRenamed("rep", "node"), "met")
    marks = ["__a", "__b", "__n"]
    known = classes.withColumnRenamed("rep", "node")
    wanted = known.join(met.select("node").distinct(), "node", "left_semi").select(*[F.col(k).alias(m) for k, m in zip(key, marks, strict=True)], "node")
    texts = _sequences(own.select("text"), SEEN).join(small(staged(wanted, "wanted")), marks).groupBy(*marks).agg(F.any_value("node").alias("node"), F.any_value("text").alias("text"))
    sets = _sets(texts.select("node", "text"), width).join(known.select("node", "copies", "bands"), "node")
    linked = staged(_verified(met, sets, threshold), "linked")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(linked.filter("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")))
    nodes = links.join(groups, "node", "left").withColumnRenamed("node", "rep")
    return signed.drop("bands"), classes.drop("bands").join(nodes, "rep", "left")


def join(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links, group_id of every row of `docs`.

    Two documents are linked if the Jaccard similarity of their sets of `width`-word n-grams reaches `threshold`. class_id is the
    smallest doc_id with the same words; n_links counts the documents linked with this one, copies included;
    group_id is the smallest doc_id reached over links. A text of 1 to `width` - 1 words is one n-gram; a text without
    words (null, empty) is linked with nothing. Every row is a document of its own, also if it has no doc_id or shares
    it with others; class_id and group_id are null only where no document of the class or group has a doc_id. Other
    columns are ignored; an empty table gives an empty result.

    Bands and rows are the most selective ones that reach `recall` at the threshold with so many hashes. Copies
    are one representative before any band is shuffled. Full sets meet in groups of two cells of about `block` documents, and of
    bounded words; pairs with a band in common are found and verified there and are never written. A single very long text
    is one value. A shingle is a 64-bit hash.
    """
    signed, known = _resolved(docs, width, threshold, recall, hashes, block)
    lows = known.filter("component is not null").groupBy("component").agg(F.min("low").alias("group_low"))
    known = known.join(lows, "component", "left")
    id_kind = docs.schema["doc_id"].dataType
    doc_id = F.col("id").cast(id_kind).alias("doc_id")
    told = signed.filter("n_words > 0").join(known, ["a", "b", "n_words"]).select(
        doc_id,
        F.col("low").cast(id_kind).alias("class_id"),
        (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("group_low", "low").cast(id_kind).alias("group_id"),
    )
    bare = signed.filter("n_words = 0")
    return told.unionByName(bare.select(doc_id, doc_id.alias("class_id"), F.lit(0).cast("long").alias("n_links"), doc_id.alias("group_id")))


def keep_one(
    docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, block: int = BLOCK
) -> DataFrame:
    """`docs` without the documents in whose group one has a smaller doc_id (null is the smallest). Of different texts that
    share the smallest one, one stays. Repeated rows of the one that stays all stay: exact duplicates are
    another operator's."""
    _, known = _resolved(docs, width, threshold, recall, hashes, block)
    # a class as (has an id, smallest id, hashes): the smallest of a group stays
    first = F.struct(F.col("nameless") == 0, F.when(F.col("nameless") == 0, F.col("low")), "a", "b", "n_words")
    firsts = known.filter("component is not null").groupBy("component").agg(F.min(first).alias("first"))
    known = known.join(firsts, "component", "left").select(
        *["a", "b", "n_words"],
        F.coalesce(F.col("first") == first, F.lit(True)).alias("__stays"),
        F.when(F.col("nameless") == 0, F.col("low")).alias("__low"),
        "copies",
    )
    known = known.filter("not __stays or copies > 1")
    known = known.select(F.struct("a", "b", "n_words", "__stays", "__low").alias("__class"))  # no name of a column of `docs`
    same = (F.col("__class.a") == F.col("__a")) & (F.col("__class.b") == F.col("__b")) & (F.col("__class.n_words") == F.col("__n"))
    stays = F.col("__class.__stays") & F.col("doc_id").cast("long").eqNullSafe(F.col("__class.__low"))
    # with few classes of copies no text moves
    return _sequences(docs).join(small(staged(known, "known")), same & ~stays, "left_anti").select(*docs.columns)
