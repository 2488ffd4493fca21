import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadq.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- language ---


def test_held_out_accuracy(spark, docs):
    found = queries.op6_language_id(spark, SF)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(docs.select("doc_id", "lang", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").alias("away")), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.held_out == r.away and 0 <= r.score <= 1 for r in rows)
    away = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in away]) > 0.98
    assert abs(np.mean([r.score for r in away]) - np.mean([r.lang == r.lang_pred for r in away])) < 0.05


def test_counts_are_those_of_the_whole_text(monkeypatch):
    text = "Ça va? Oui, très bien;\n\nmerci 123 bien! " * 30
    want = langid.counts_of(text)
    assert langid.counts_of("12 34 !?\n") is None and langid.counts_of(None) is None and langid.counts_of("") is None
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = " " + " ".join(words) + " "
    assert want.sum() == sum(len(line) - n + 1 for n in langid.ORDERS) - 1  # the space in front is no n-gram
    for stretch in (1, 2, 97):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        assert (langid.counts_of(text) == want).all()


def test_ftrl_learns_sparse_weights_and_calibrates():
    rnd = np.random.default_rng(0)
    examples = []
    for i in range(400):
        at = np.sort(rnd.choice(200, 12, replace=False))
        at[0] = 1000 + i % 3
        examples.append((at, np.full(12, 12**-0.5), i % 3))
    weights, bias = langid.train_ftrl(examples, 3)
    assert (weights != 0).mean() < 0.01
    assert np.mean([int((values @ weights[at] + bias).argmax()) == y for at, values, y in examples]) == 1
    logits = rnd.normal(size=(4000, 3))
    labels = np.array([rnd.choice(3, p=langid.softmax(z / 2)) for z in logits])
    assert abs(langid.calibrated(logits, labels) - 2) < 0.4


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", 5), (2, "le chat et le chien", "fr", 1), (3, None, "en", 0), (4, "123 ...", None, 0), (4, "123 ...", None, 0), (None, "the dog", None, 2)]
    rows += [(5, "the cat and the dog " * 100_000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.fit(df)
    got = langid.predict(df, model).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "en"), (1, "en"), (2, "fr"), (3, "und"), (4, "und"), (4, "und"), (5, "en")]
    assert langid.predict(df.filter("doc_id = 99"), model).count() == 0
    nothing = langid.fit(df.filter("doc_id = 99"))
    assert {(r.lang_pred, r.score) for r in langid.predict(df, nothing).collect()} == {("und", 0.0)}


# --- quality ---


def test_junk_goes_and_clean_documents_stay(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op3_quality_classifier(spark, SF).join(labels, "doc_id").collect()
    clean, junk = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r.kept for r in clean]) >= 0.99
    assert np.mean([r.kept for r in junk]) <= 0.05


def test_expectation_maximisation_finds_the_accuracies():
    rnd = np.random.default_rng(4)
    truth = rnd.random(60_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.7])
    votes = np.where(rnd.random((len(truth), 5)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    votes[rnd.random(votes.shape) < 0.3] = 0
    codes, n = np.unique(quality.code(votes), return_counts=True)
    assert (quality.decode(codes, 5) == np.unique(votes, axis=0)[np.argsort(quality.code(np.unique(votes, axis=0)))]).all()
    found = quality.expectation_maximisation(quality.decode(codes, 5), n.astype(float))
    assert abs(found.prior - 0.8) < 0.03
    assert np.abs(found.on_good - right).max() < 0.03 and np.abs(found.on_bad - right).max() < 0.06


def test_votes_look_at_whole_words():
    texts = ["WE SELL!! CHEAP!! THINGS!! NOW!! BUY!!", "go go go go go go go go go go go go go go go go", None, "", "a | b | c | d | e | f | g | h", "And this is a plain sentence of the kind that many people write, using quite ordinary words and saying things plainly."]
    looked = quality.Looked(pa.array(texts))
    votes = dict(zip(quality.LABELLERS, looked.votes.T.tolist()))
    assert votes["capitals"][0] == votes["doubled"][0] == -1
    assert votes["repeats"][1] == votes["echoes"][1] == votes["commonest"][1] == votes["variety"][1] == -1
    assert all(v[2] == v[3] == 0 for v in votes.values()) and looked.counts[2:4].tolist() == [0, 0]
    assert votes["marks"][4] == -1
    assert all(v[5] == 1 for v in votes.values())


def test_quality_of_odd_rows(spark, docs):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "x"), (None, "The cat and the dog are in the house of the man.", "x"), (4, "word " * 400_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = quality.fit(docs)
    got = quality.classify(df, model).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in got) == [(0, True), (1, False), (1, False), (2, False), (4, False)]
    assert quality.weak_labels(df, model).count() == 5
    empty = df.filter("doc_id = 99")
    assert quality.keep_good(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
