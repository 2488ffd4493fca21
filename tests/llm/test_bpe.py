import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from leadq.llm import bpe, queries, token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    return queries.codec()


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(blob):
    return np.frombuffer(blob, dtype="<u4").tolist()


def test_perfect_hash_is_minimal_and_exact():
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    table = bpe.PerfectHash(ranks)
    assert table.n == len(ranks) and None not in table.keys
    assert all(table.get(k) == v for k, v in ranks.items())
    assert table.get(b"surely not a token of the vocabulary") is None
    assert bpe.PerfectHash({}).get(b"a") is None


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(alphabet="ab 's\n\té漢1!", max_size=60)))
def test_as_the_library(codec, library, text):
    assert ids(codec.encode(text)) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


def test_long_texts_break_where_the_pattern_does(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCH", 37)
    text = "Some words  and   spaces, it's 12 o'clock\n\n é\t漢字 <|endoftext|> " * 40
    assert ids(codec.encode(text)) == library.encode_ordinary(text)
    assert ids(codec.encode("x" * 5000)) == library.encode_ordinary("x" * 5000)


def test_query_on_whole_texts_and_odd_rows(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: library.encode_ordinary(r.text or "") for r in docs.collect()}
    for r in queries.op8_byte_bpe(spark, SF).collect():
        packed = np.array(want[r.doc_id], dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]), hashlib.sha256(packed).hexdigest())
    assert queries.op8_byte_bpe(spark, SF).filter("decoded_sha256 = sha2('', 256)").count() == sum(not x for x in want.values())


def test_nulls_repeats_empty_tables_extra_columns(spark, codec, library):
    long = "one two " * 300_000
    rows = [(1, None, 3), (1, None, 3), (2, "", 0), (None, "text here", 1), (5, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.decode(bpe.encode(docs, codec), codec).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded).decode()) for r in got) == sorted(
        (a or 0, len(library.encode_ordinary(t or "")), t or "") for a, t, _ in rows
    )
    empty = docs.filter("doc_id = -1")
    assert bpe.digests(empty, codec).count() == 0
    assert token_counts.suffix_sums(token_counts.histogram(empty, codec)).count() == 0


def test_token_counts_answer_every_limit(spark, codec, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lengths = [len(library.encode_ordinary(r.text or "")) for r in docs.select("text").collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(docs, codec), width=64).cache()
    for r in sums.collect():
        assert r.docs == lengths.count(r.n_tokens)
        assert (r.docs_from, r.tokens_from) == (sum(x >= r.n_tokens for x in lengths), sum(x for x in lengths if x >= r.n_tokens))
        assert (r.docs_up_to, r.tokens_up_to) == (sum(x <= r.n_tokens for x in lengths), sum(x for x in lengths if x <= r.n_tokens))
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in lengths)
    limits = [0, 1, 77, 500, 4096, 10**9]
    assert token_counts.at_limits(sums, limits) == {x: sum(min(y, x) for y in lengths) for x in limits}
    ordered = sorted(lengths)
    assert token_counts.quantiles(sums, [0.5, 1.0]) == {0.5: ordered[(len(ordered) + 1) // 2 - 1], 1.0: ordered[-1]}
