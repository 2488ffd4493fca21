"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, and a hashed
linear scorer trained on the posterior labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadq.llm import textvec as V

DIM = 1 << 16
#: Documents that the scorer is trained on, at most; the labellers' accuracies come from all documents.
SAMPLE = 8000
#: A document is kept if its score reaches this.
KEEP = 0.5
#: Words' worth of no evidence that every text is given, so that very short texts stay near the prior.
SHRINK = 2
#: With fewer words than these the labellers that look at shares of words abstain.
ENOUGH, MANY = 5, 15

# --- fixed values: function words of four languages ---
FUNCTION_WORDS = (
    "the of and to in is that it was for on are as with be at by this from or an not",
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "de la le et les des en un du une que est pour qui dans par sur plus pas au avec ce",
    "de la que el en y a los se del las un por con no una su para es al lo como",
)
# --- end of fixed values ---

_A, _UPPER, _DIGIT = 1, 2, 3
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[c for c in range(33, 127)]] = np.arange(33, 127)
_KIND[ord("a") : ord("z") + 1] = _A
_KIND[0x80:] = _A
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[0:9] = _KIND[14:32] = _KIND[127] = 4
_VALUES = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)
_IS_TEXT = np.isin(np.arange(256), [_A, _UPPER, _DIGIT, *map(ord, ".,;:'\"!?()-/@_+=")])


def _hashes_of(words: list[str]) -> np.ndarray:
    data, offsets = V.bytes_of(pa.array(words))
    return V.word_hashes(data, offsets)[0]


_FUNCTION = np.unique(_hashes_of(sorted({w for line in FUNCTION_WORDS for w in line.split()})))


LABELLERS = ("symbols", "marks", "capitals", "doubled", "repeats", "echoes", "variety", "commonest", "function_words", "word_length", "sentences")


class Looked:
    """The words of some texts, as the labellers and the scorer look at them."""

    def __init__(self, texts: pa.Array):
        data, offsets = V.bytes_of(texts)
        self.starts, self.ends, self.counts = V.word_spans(data, offsets)
        self.words, _ = V.word_hashes(data, offsets)
        self.kinds = _KIND[data]
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.first = np.zeros(len(self.starts), dtype=bool)
        self.first[(np.cumsum(self.counts) - self.counts)[self.counts > 0]] = True
        self.again = np.zeros(len(self.starts), dtype=bool)
        self.again[1:] = (self.words[1:] == self.words[:-1]) & ~self.first[1:]

    @property
    def votes(self) -> np.ndarray:
        """Texts x labellers: 1 good, -1 bad, 0 abstains."""
        words, kinds, doc, counts, starts, ends = self.words, self.kinds, self.doc, self.counts, self.starts, self.ends
        n, texts, lengths = len(starts), len(counts), ends - starts
        some = np.maximum(counts, 1)

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.bincount(doc, weights=values, minlength=texts)

        def within(flags: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
            return sums[ends] - sums[starts]

        upper, plain = within(kinds == _UPPER), within((kinds > 0) & (kinds <= _DIGIT))
        letters = plain - within(kinds == _DIGIT)
        odd = lengths - within(_IS_TEXT[kinds])
        echo = np.zeros(n, dtype=bool)
        echo[2:] = (words[2:] == words[:-2]) & (doc[2:] == doc[:-2])
        last = kinds[ends - 1]
        doubled = (last == kinds[np.maximum(ends - 2, 0)]) & (last > 4) & (lengths > 1) & (last != ord("."))
        sentence = np.isin(last, np.frombuffer(b".!?", np.uint8)) & ~doubled
        common = _FUNCTION[np.minimum(np.searchsorted(_FUNCTION, words), len(_FUNCTION) - 1)] == words
        # distinct words and the commonest one, from the words sorted within each text
        order = np.argsort((words >> np.uint64(20)) | (doc.astype(np.uint64) << np.uint64(44)), kind="stable")
        at, of = words[order], doc[order]
        new = np.ones(n, dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
        distinct = np.bincount(of[new], minlength=texts)
        commonest = np.zeros(texts, dtype=np.int64)
        np.maximum.at(commonest, of[new], np.diff(np.append(np.flatnonzero(new), n)))

        def vote(good: np.ndarray, bad: np.ndarray, can: np.ndarray) -> np.ndarray:
            return np.where(can, np.where(bad, -1, np.where(good, 1, 0)), 0).astype(np.int8)

        enough, many = counts >= ENOUGH, counts >= MANY
        symbols = per_text(odd) / np.maximum(per_text(lengths), 1)
        marks = per_text(plain == 0) / some
        capitals = per_text(upper) / np.maximum(per_text(letters), 1)
        twice = per_text(doubled) / some
        repeats = per_text(self.again) / np.maximum(counts - 1, 1)
        echoes = per_text(echo) / np.maximum(counts - 2, 1)
        variety, top = distinct / some, commonest / some
        function_words = per_text(common) / some
        word_length = per_text(letters) / some
        sentences = per_text(sentence) / some
        return np.stack(
            [
                vote(symbols < 0.05, symbols > 0.15, counts > 0),
                vote(marks < 0.1, marks > 0.25, enough),
                vote(capitals < 0.3, capitals > 0.6, enough),
                vote(twice < 0.05, twice > 0.3, enough),
                vote(repeats < 0.15, repeats > 0.4, enough),
                vote(echoes < 0.15, echoes > 0.3, many),
                vote(variety > 0.4, variety < 0.25, many & (counts < 2000)),
                vote(top < 0.2, top > 0.25, many),
                vote((function_words > 0.08) & (function_words < 0.6), (function_words < 0.03) | (function_words > 0.75), many),
                vote((word_length >= 3) & (word_length <= 7), (word_length < 2.5) | (word_length > 10), enough),
                vote((sentences > 0.02) & (sentences < 0.4), (sentences == 0) | (sentences > 0.8), many),
            ],
            axis=1,
        )

    @property
    def features(self) -> np.ndarray:
        """Words x 4 hashed features: shape (runs of letters and of digits are one), pair of shapes, repeat, short word."""
        kinds, starts, ends, n = self.kinds, self.starts, self.ends, len(self.starts)
        stay = np.ones(len(kinds), dtype=bool)
        stay[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] > 4)
        stay[starts] = True
        kept = np.concatenate([[0], np.cumsum(stay, dtype=np.int64)])
        shaped, a, b = kinds[stay], kept[starts], kept[ends]
        shape = np.empty(n, dtype=np.uint64)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(b, a[i] + V.STEP, side="right")))
            shape[i:j] = V.spans(_VALUES[shaped[a[i] : b[j - 1]]], a[i:j] - a[i], b[i:j] - a[i], V.BASE)
            i = j
        shape = V.mix64(shape)
        pair = np.zeros(n, dtype=np.uint64)
        pair[1:] = shape[1:] * np.uint64(V.BASE2) + shape[:-1]
        pair[self.first] = shape[self.first] + np.uint64(9)
        lengths = ends - starts
        short = np.where(lengths <= 4, self.words, np.minimum(lengths, 40).astype(np.uint64))
        features = np.empty((n, 4), dtype=np.int32)
        for k, h in enumerate((shape, pair, self.again.astype(np.uint64), short)):
            features[:, k] = V.mix64(h + np.uint64(k * 0x51ED270B)) >> np.uint64(64 - 16)
        return features


def code(votes: np.ndarray) -> np.ndarray:
    """The votes on a text as one number in base 3."""
    return (votes.astype(np.int64) + 1) @ 3 ** np.arange(votes.shape[1])


def decode(codes: np.ndarray, n: int) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(n)) % 3 - 1


@dataclass
class Labels:
    """Share of good documents, and of each labeller how often it says good of good and bad of bad ones when it votes."""

    prior: float
    on_good: np.ndarray
    on_bad: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that a document is good given its votes (texts x labellers)."""
        good = np.log(self.prior) + np.where(votes == 0, 0, np.where(votes > 0, np.log(self.on_good), np.log1p(-self.on_good))).sum(axis=1)
        bad = np.log1p(-self.prior) + np.where(votes == 0, 0, np.where(votes < 0, np.log(self.on_bad), np.log1p(-self.on_bad))).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def expectation_maximisation(votes: np.ndarray, weights: np.ndarray, rounds: int = 200) -> Labels:
    """Accuracies of labellers that err independently of each other given the truth, from vote patterns and how many documents
    have each. Starts from the vote counts; ends when nothing moves. Add-one smoothing keeps probabilities inside (0, 1)."""
    against = (votes < 0).sum(axis=1)
    good = np.where(against == 0, 0.95, np.where(against == 1, 0.5, 0.05))
    labels = None
    for _ in range(rounds):
        g, b = good * weights, (1 - good) * weights
        prior = (g.sum() + 1) / (weights.sum() + 2)
        on_good = ((g @ (votes > 0)) + 2) / ((g @ (votes != 0)) + 3)
        on_bad = ((b @ (votes < 0)) + 1) / ((b @ (votes != 0)) + 2)
        labels = Labels(prior, on_good, on_bad)
        now = labels.posterior(votes)
        moved = np.abs(now - good).max(initial=0)
        good = now
        if moved < 1e-9:
            break
    return labels


def train_scorer(examples: list[tuple[np.ndarray, np.ndarray, float]], prior: float, epochs: int = 8, rate: float = 2.0, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic model of the mean weight of a text's features, by adaptive gradient steps on soft
    labels. The bias is then moved from the share of good examples to the share of good documents, `prior`."""
    weights, squares, bias, bias_square = np.zeros(DIM), np.full(DIM, 1e-8), 0.0, 1e-8
    order = np.random.default_rng(3)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, values, label = examples[i]
            p = 1 / (1 + np.exp(-np.clip(weights[at] @ values + bias, -30, 30)))
            step = (p - label) * values + l2 * weights[at]
            squares[at] += step**2
            weights[at] -= rate * step / np.sqrt(squares[at] + 1e-6)
            bias_square += (p - label) ** 2
            bias -= 0.1 * (p - label) / np.sqrt(bias_square)
    share = (sum(x[2] for x in examples) + 1) / (len(examples) + 2)
    return weights, bias + np.log(prior / (1 - prior)) - np.log(share / (1 - share))


@dataclass
class Model:
    labels: Labels
    weights: np.ndarray
    bias: float

    def score(self, looked: Looked) -> np.ndarray:
        """Probability that each text is good; 0 for a text without words."""
        sums = np.concatenate([[0], np.cumsum(self.weights[looked.features].sum(axis=1))])
        ends = np.cumsum(looked.counts)
        mean = (sums[ends] - sums[ends - looked.counts]) / (4 * (looked.counts + SHRINK))
        return np.where(looked.counts > 0, 1 / (1 + np.exp(-np.clip(mean + self.bias, -30, 30))), 0.0)


def fit(docs: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> Model:
    """A model of `docs(text, <key>)`, without any given label.

    Every document votes: the counts of vote patterns (at most 3^11) are combined in Spark, and the
    accuracies come from them. The scorer is trained on at most `sample` documents, half of them of the likelier bad
    ones if there are so many, drawn by the hash of `key`; the driver holds their sparse features.
    """
    rows = docs.select("text", F.xxhash64(F.col(key)).alias("draw"))

    def patterns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.pieces(batches, "text"):
            looked = Looked(batch.column("text"))
            found, n = np.unique(code(looked.votes[looked.counts > 0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["pattern", "n"])

    counted = rows.select("text").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counted = sorted((r.pattern, r.n) for r in counted)
    if not counted:
        return Model(Labels(0.5, np.full(len(LABELLERS), 0.5), np.full(len(LABELLERS), 0.5)), np.zeros(DIM), 0.0)
    votes = decode(np.array([p for p, _ in counted]), len(LABELLERS))
    weights = np.array([n for _, n in counted], dtype=float)
    labels = expectation_maximisation(votes, weights)
    good = labels.posterior(votes)
    sides = [weights[good < 0.5].sum(), weights[good >= 0.5].sum()]
    shares = [min(1.0, sample / 2 / max(n, 1)) for n in sides]
    below = [min(2**63 - 1, int(x * 2**64) - 2**63) for x in shares]

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.pieces(batches, "text"):
            looked = Looked(batch.column("text"))
            label, features, ends = labels.posterior(looked.votes), looked.features, np.cumsum(looked.counts)
            draws = batch.column("draw").to_numpy()
            chosen = np.flatnonzero((looked.counts > 0) & (draws <= np.where(label < 0.5, below[0], below[1])))
            for i in chosen:
                at, n = np.unique(features[ends[i] - looked.counts[i] : ends[i]], return_counts=True)
                share = n / (4 * (looked.counts[i] + SHRINK))
                blobs = [pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), share.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([pa.array([int(draws[i])], pa.int64()), pa.array([float(label[i])]), *blobs], ["draw", "label", "at", "share"])

    drawn = rows.filter(F.col("draw") <= max(below)).mapInArrow(featured, "draw long, label double, at binary, share binary")
    found = drawn.orderBy("draw", "label", "at", "share").limit(sample).collect()  # the limit only matters where very many rows share a key
    examples = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["share"], np.float32).astype(float), r["label"]) for r in found]
    return Model(labels, *train_scorer(examples, labels.prior))


def classify(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """All columns of `docs` but its text, plus score (probability that the text is good) and kept, for every whole text.

    A text without words (null, empty) has score 0 and isn't kept. Input columns named like the result are replaced. Rows are independent of
    each other; an empty table gives an empty result. The model has a fixed size and is broadcast.
    """
    others = [c for c in docs.columns if c.lower() not in ("text", "score", "kept")]
    schema = docs.select(*others).schema.add("score", "double").add("kept", "boolean")

    def result(batch: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(score), pa.array(score >= keep)], names=schema.names)

    return _scored(docs.select(*others, "text"), model, result, schema)


def weak_labels(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` but its text, plus weak_label: the posterior of the labellers' votes on it."""
    others = [c for c in docs.columns if c.lower() not in ("text", "weak_label")]
    sent = docs.sparkSession.sparkContext.broadcast(model.labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.pieces(batches, "text"):
            looked = Looked(batch.column("text"))
            label = np.where(looked.counts > 0, sent.value.posterior(looked.votes), 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(label)], [*others, "weak_label"])

    return docs.select(*others, "text").mapInArrow(run, docs.select(*others).schema.add("weak_label", "double"))


def keep_good(docs: DataFrame, keep: float = KEEP, **options) -> DataFrame:
    """The rows of `docs` that a model fitted on them keeps, with all their columns."""
    return _scored(docs, fit(docs, **options), lambda batch, score: batch.filter(pa.array(score >= keep)), docs.schema)


def _scored(docs: DataFrame, model: Model, result: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: StructType) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in V.pieces(batches, "text"):
            yield result(batch, sent.value.score(Looked(batch.column("text"))))

    return docs.mapInArrow(run, schema)
