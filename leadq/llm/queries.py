"""The registered queries of the text operators, and their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadq.llm import bpe, chat, decontam, exact_dedup, fingerprint, langid, mixing, ngram_join, quality, repair, substring, token_counts, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codec(remembered: int = bpe.REMEMBERED) -> bpe.Codec:
    return bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, remembered)


@register
def op1_ngram_join(spark, sf):
    return ngram_join.join(table(spark, sf, "documents"))


@register
def op2_document_fingerprints(spark, sf):
    return fingerprint.edit_report(table(spark, sf, "documents"))


@register
def op3_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.fit(docs))


@register
def op4_token_counts(spark, sf):
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf, "documents"), codec()))


@register
def op5_chat_formatting(spark, sf):
    return chat.render(table(spark, sf, "conversations"))


@register
def op6_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.fit(docs.filter("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model)


@register
def op7_exact_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return exact_dedup.mark_duplicates(docs, drop_text=True, sha="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register
def op8_byte_bpe(spark, sf):
    return bpe.digests(table(spark, sf, "documents"), codec())


@register
def op9_mixing_sources(spark, sf):
    return mixing.mix(table(spark, sf, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


@register
def op10_substring_dedup(spark, sf):
    left = substring.remove_repeats(table(spark, sf, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register
def op11_benchmark_decontamination(spark, sf):
    return decontam.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register
def op12_embedding_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


@register
def op13_conversation_repair(spark, sf):
    return repair.damage_report(table(spark, sf, "conversations"))


SQL = {
    "op11_benchmark_decontamination": r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS run
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM runs),
starts AS (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM docs, lengths),
found AS (
  SELECT r, i, s.n, item FROM (SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS run FROM starts) s JOIN runs USING (n, run)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS told FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(told, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
""",
    "op5_chat_formatting": """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
logs AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(md5(role || chr(31) || text), '' ORDER BY turn NULLS FIRST, role, text) AS told
  FROM turns GROUP BY conv_id),
one AS (SELECT min(conv_id) AS conv_id, n_turns, told, count(*) AS copies FROM logs GROUP BY n_turns, told),
begun AS (
  SELECT DISTINCT substr(told, 1, 32 * k::BIGINT) AS told
  FROM (SELECT told, unnest(range(1, n_turns)) AS k FROM one)),
stay AS (SELECT * FROM one WHERE told NOT IN (SELECT told FROM begun))
SELECT t.conv_id, coalesce(floor(t.turn / 4096), -1)::BIGINT AS part, any_value(s.n_turns) AS n_turns, any_value(s.copies) AS copies,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text
FROM turns t JOIN stay s USING (conv_id) GROUP BY ALL
""",
    "op10_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS i FROM words),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS run FROM starts),
later AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS p FROM later),
each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM words),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.p) AS text
  FROM each_word e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op9_mixing_sources": r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM docs GROUP BY source),
weighted AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER poorer, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER poorer, 0)) AS level
  FROM weighted
  WINDOW poorer AS (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM levels),
placed AS (
  SELECT d.*, p.source_size, p.target, floor(p.target + 0.5)::BIGINT AS budget,
    (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  ((CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * size
    + greatest(0, least(size, (CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END) - before)))::BIGINT AS taken
FROM placed
""",
}
