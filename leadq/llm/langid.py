"""Language identification: multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3)
DIM = 1 << 15
#: Documents that the weights are fitted on, at most; counts and frequencies come from all training documents.
SAMPLE = 6000
UNKNOWN = "und"
#: Code points of a text that are worked on at once.
STRETCH = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def counts_of(text: str | None) -> np.ndarray | None:
    """How often each hashed n-gram of 1 to 3 characters occurs; None for a text without a letter.

    The text is lowercase, every run of other characters than letters is one space, and a space stands at both ends.
    """
    total, tail, lettered = None, np.array([32], dtype=np.uint64), False
    for at in range(0, len(text or ""), STRETCH):
        codes = np.frombuffer(text[at : at + STRETCH].lower().encode("utf-32-le"), dtype=np.uint32)
        letter = _letters()[codes]
        lettered |= bool(letter.any())
        codes = np.where(letter, codes, 32).astype(np.uint64)
        if at + STRETCH >= len(text):
            codes = np.append(codes, np.uint64(32))
        codes = np.concatenate([tail[-1:], codes])
        codes = codes[1:][(codes[1:] != 32) | (codes[:-1] != 32)]
        tail = np.concatenate([tail[-2:], codes])
        grams = []
        for n in ORDERS:  # those that end in the new codes
            first = max(0, len(tail) - len(codes) - n + 1)
            h = np.full(max(0, len(tail) - n + 1 - first), n, dtype=np.uint64)
            for k in range(n):
                h = (h + tail[first + k : first + k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            grams.append((h >> np.uint64(64 - DIM.bit_length() + 1)).astype(np.int64))
        found = np.bincount(np.concatenate(grams), minlength=DIM)
        total = found if total is None else total + found
    return total if lettered else None


@dataclass
class Model:
    """Languages, inverse document frequencies, weights (features x languages), bias and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        values = (1 + np.log(counts[at])) * self.idf[at]
        length = np.sqrt(values @ values)
        return at, values / length if length else values

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        at, values = self.features(counts)
        return softmax((values @ self.weights[at] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(
    examples: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by follow-the-regularised-leader with an elastic net, one example at a time.

    Weights are a closed form of the summed gradients z and squared gradients n; a weight stays zero while |z| is at
    most `l1`, so the model is sparse. The bias isn't penalised.
    """
    z, n = np.zeros((DIM + 1, n_languages)), np.zeros((DIM + 1, n_languages))
    penalty = np.full((DIM + 1, 1), l1)
    penalty[DIM] = 0

    def solved(at: np.ndarray | slice) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty[at], 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, values, language = examples[i]
            at, values = np.append(at, DIM), np.append(values, 1.0)
            w = solved(at)
            error = softmax(values @ w)
            error[language] -= 1
            gradient = values[:, None] * error
            step = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / alpha
            z[at] += gradient - step * w
            n[at] += gradient**2
    w = solved(slice(None))
    return w[:DIM], w[DIM]


def calibrated(logits: np.ndarray, languages: np.ndarray) -> float:
    """The temperature under which the logits of unseen examples are most likely."""

    def loss(t: float) -> float:
        p = softmax(logits / t)[np.arange(len(languages)), languages]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    grid = np.geomspace(0.05, 20, 121)
    return float(min(grid, key=loss)) if len(languages) else 1.0


def fit(training: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> Model:
    """A model of `training(text, lang, <key>)`; rows without lang or without a letter teach nothing.

    Languages, their counts and all document frequencies come from every row, as sums per task and feature.
    The weights are fitted on at most `sample` rows: about as many of each language, those with the
    smallest hash of `key`, of which a fifth sets the temperature only. The driver holds their sparse features, the frequencies and the weights.
    """
    rows = training.filter(F.col("lang").isNotNull()).select("text", "lang", F.xxhash64(F.col(key)).alias("draw"))

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIM, dtype=np.int64)
        per_language: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(*(batch.column(c).to_pylist() for c in ("text", "lang")), strict=True):
                counts = counts_of(text)
                if counts is not None:
                    seen += counts > 0
                    per_language[lang] = per_language.get(lang, 0) + 1
        at = np.flatnonzero(seen)
        kind = pa.schema([("feature", pa.int32()), ("lang", pa.string()), ("n", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.string()), pa.array(seen[at])], schema=kind)
        langs = list(per_language)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(langs), pa.int32()), pa.array(langs, pa.string()), pa.array(per_language.values(), pa.int64())], schema=kind)

    sums = rows.mapInArrow(frequencies, "feature int, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n")).collect()
    per_language = {r.lang: r.n for r in sums if r.lang is not None}  # DIM rows and one per language
    languages = sorted(per_language)
    total = sum(per_language.values())
    df = np.zeros(DIM)
    for r in sums:
        if r.lang is None:
            df[r.feature] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1
    model = Model(languages, idf, np.zeros((DIM, len(languages))), np.zeros(len(languages)))
    if len(languages) < 2:
        return model
    each = max(1, sample // len(languages))
    # a hash below the language's share of the hash range
    bound = {lang: min(2**63 - 1, int(each / n * 2**64) - 2**63) for lang, n in per_language.items()}
    limit = F.create_map(*[F.lit(x) for lang in languages for x in (lang, bound[lang])])
    drawn = rows.filter(F.col("draw") <= limit[F.col("lang")])

    def featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang, draw in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "draw")), strict=True):
                counts = counts_of(text)
                if counts is not None:
                    at, values = model.features(counts)
                    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int32), values.astype(np.float32))]
                    yield pa.RecordBatch.from_arrays([pa.array([draw], pa.int64()), pa.array([lang], pa.string()), *blobs], ["draw", "lang", "at", "values"])

    # the limit only matters where very many rows share a key
    found = drawn.mapInArrow(featured, "draw long, lang string, at binary, values binary").orderBy("draw", "lang", "at", "values").limit(sample).collect()
    number = {lang: i for i, lang in enumerate(languages)}
    examples = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["values"], np.float32).astype(np.float64), number[r["lang"]]) for r in found]
    aside = examples[::5] if len(examples) >= 100 else []  # too few to tell: temperature 1
    used = [x for i, x in enumerate(examples) if i % 5] if aside else examples
    model.weights, model.bias = train_ftrl(used, len(languages))
    logits = np.array([values @ model.weights[at] + model.bias for at, values, _ in aside])
    model.temperature = calibrated(logits, np.array([x[2] for x in aside], dtype=np.int64))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` but its text, plus lang_pred and score, for every whole text.

    lang_pred is `und` with score 0 if the text is null or has no letter, or if no language was learned; the score is the
    calibrated probability of the language. Nothing but the text is read for it. Input columns named like the result are replaced. Rows are
    independent of each other; an empty table gives an empty result. The model's size is fixed by the features and
    languages, so it is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c.lower() not in ("text", "lang_pred", "score")]
    schema = docs.select(*others).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found, scores = [], []
            for text in batch.column("text"):
                counts = counts_of(text.as_py()) if own.languages else None
                if counts is None:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    p = own.probabilities(counts)
                    found.append(own.languages[int(p.argmax())])
                    scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*others, "text").mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: its checksum has remainder 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
