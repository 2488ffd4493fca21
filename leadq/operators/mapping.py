"""Mapping of unknown columns to the canonical schema.

Raw records are `(source, ord, raw MAP<STRING,STRING>)`. Everything here that is not
`profile_fields` or `apply_mapping` works on headers: a row per source and column name.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from leadq import schema as S
from leadq.functions.similarity import best_possible_ratio, cosine, indel_ratio, normalized_header, sorted_tokens
from leadq.functions.strings import lookup
from leadq.operators.logs import latest
from leadq.operators.skew import join_groups
from leadq.session import staged

MEMORY = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("field_name", T.StringType()),
        T.StructField("canonical_field", T.StringType()),
        T.StructField("sample_value", T.StringType()),
        T.StructField("decided_at", T.TimestampType()),
    ]
)

# Question-style headers of the usual form export, which no spelling rule can place.
FORM_HEADERS = {
    "Timestamp": "created_at",
    "What's your name?": "full_name",
    "Your email address": "email",
    "Best number to reach you": "phone_e164",
    "Do you agree to be contacted?": "consent",
    "How did you hear about us?": "campaign_id",
}

#: Groups of the cells of a column, by a hash of their position, whose lowest positions bound those of its first values.
GROUPS = 32
#: Columns whose bounds are broadcast, at most.
MOST_BROADCAST = 500_000
# Up to this many mapped columns are written into the projection; more are joined.
INLINE_LIMIT = 500


def _normalized(name: str) -> str:
    return name.strip().lower().replace("_", " ").replace("-", " ")


SYNONYMS = {_normalized(k): v for k, v in S.FIELD_SYNONYMS.items()}


def starter_memory(spark: SparkSession) -> DataFrame:
    rows = [("google_form", h, c, "", None) for h, c in FORM_HEADERS.items()]
    return spark.createDataFrame(rows, MEMORY)


def _cells(records: DataFrame) -> DataFrame:
    """The non-empty cells of all columns that aren't internal."""
    cells = records.select("source", "ord", F.explode("raw").alias("field_name", "value"))
    return cells.filter(~F.col("field_name").startswith("_") & (F.col("value") != ""))


def profile_fields(records: DataFrame, samples: int = 5) -> DataFrame:
    """`(source, field_name, samples)`: the first non-empty values of every column in record
    order. Internal columns ('_...') and columns without a value get no row.

    The rank limit is applied within each task before the shuffle, so a column that every
    record has moves at most `samples` values per task. Only the rows up to a bound are ranked: cells are counted
    off by the hash of their position, and the lowest positions of `samples` such groups are as many of the column's cells, so none of its
    first ones lies beyond the last of them. A column with fewer groups is bounded by its last cell.
    """
    values = _cells(records)
    group = F.pmod(F.xxhash64("ord"), F.lit(GROUPS)).alias("_group")
    ends = values.groupBy("source", "field_name", group).agg(F.min("ord").alias("_low"), F.max("ord").alias("_high"))
    nth = F.get(F.array_sort(F.collect_list("_low")), F.lit(samples - 1))
    bounds = staged(ends.groupBy("source", "field_name").agg(F.coalesce(nth, F.max("_high")).alias("_bound")), "bounds")
    columns, last = bounds.agg(F.count("*"), F.max("_bound")).first()
    if last is not None:
        values = _cells(records.filter(F.col("ord").isNull() | (F.col("ord") <= last)))
    if columns <= MOST_BROADCAST:
        bounds = bounds.select(F.col("source").alias("_source"), F.col("field_name").alias("_name"), "_bound")
        same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("field_name") == F.col("_name"))
        near = values.join(F.broadcast(bounds), same)
        values = near.filter(F.col("ord").isNull() | (F.col("ord") <= F.col("_bound"))).drop("_source", "_name", "_bound")
    order = Window.partitionBy("source", "field_name").orderBy("ord")
    first = values.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= samples)
    in_order = F.array_sort(F.collect_list(F.struct("n", "value")))
    return first.groupBy("source", "field_name").agg(F.transform(in_order, lambda s: s["value"]).alias("samples"))


def synonym_target(field_name: Column) -> Column:
    return lookup(SYNONYMS, normalized_header(field_name))


def with_fuzzy_target(df: DataFrame, wanted: Column, threshold: float = S.FUZZY_THRESHOLD) -> DataFrame:
    """Add `fuzzy_score` and `fuzzy_target`: the closest known spelling of `field_name`, the
    first of equals, where `wanted` holds and the threshold is met.

    Spellings whose length alone rules them out are not compared.
    """
    spellings = list(SYNONYMS.items()) + [(t, t) for t in S.MAPPING_TARGETS]
    candidates = F.array(
        *[
            F.struct(
                F.lit(" ".join(sorted(text.split()))).alias("text"), F.lit(target).alias("target"), F.lit(-i).alias("rank")
            )
            for i, (text, target) in enumerate(spellings)
        ]
    )
    df = df.withColumn("_tokens", F.when(wanted, sorted_tokens(normalized_header(F.col("field_name")))))
    tokens = F.col("_tokens")
    near = F.filter(candidates, lambda s: best_possible_ratio(tokens, s["text"]) >= threshold)
    scored = F.transform(
        near, lambda s: F.struct(indel_ratio(tokens, s["text"]).alias("score"), s["rank"].alias("rank"), s["target"].alias("target"))
    )
    df = df.withColumn("_best", F.when(tokens.isNotNull(), F.array_max(scored)))
    accepted = F.col("_best.score") >= threshold
    return df.withColumns(
        {"fuzzy_score": F.when(accepted, F.col("_best.score")), "fuzzy_target": F.when(accepted, F.col("_best.target"))}
    ).drop("_tokens", "_best")


def known_mapping(headers: DataFrame, memory: DataFrame) -> DataFrame:
    """Headers with what memory says about them. `known` tells a remembered "no target" from an
    unknown header."""
    found = memory.select("source", "field_name", F.col("canonical_field").alias("_found"))
    joined = headers.join(found, ["source", "field_name"], "left")
    return joined.withColumns(
        {"known": F.col("_found").isNotNull(), "remembered": F.expr(f"nullif(_found, '{S.NO_TARGET}')")}
    ).drop("_found")


def resolve_mapping(headers: DataFrame, memory: DataFrame, resolver: DataFrame | None = None) -> DataFrame:
    """Decide every header: memory, then the optional `resolver` table `(source, field_name,
    canonical_field)`, then spelling. A resolver answer outside the target list counts as none.

    Result: headers plus `canonical_field`, `decided_by`, and `confirmed` (worth remembering).
    """
    df = known_mapping(headers, memory)
    if resolver is None:
        df = df.withColumns({"_proposed": F.lit(None).cast("string"), "_answered": F.lit(False)})
    else:
        answer = resolver.select("source", "field_name", F.col("canonical_field").alias("_proposed"), F.lit(True).alias("_answered"))
        df = df.join(answer, ["source", "field_name"], "left")
        df = df.withColumn("_proposed", F.when(F.col("_proposed").isin(S.MAPPING_TARGETS), F.col("_proposed")))
    open_ = ~F.col("known") & F.col("_proposed").isNull()
    df = df.withColumn("_synonym", F.when(open_, synonym_target(F.col("field_name"))))
    df = with_fuzzy_target(df, open_ & F.col("_synonym").isNull())
    decided = (
        F.when(F.col("known"), "memory")
        .when(F.col("_proposed").isNotNull(), "resolver")
        .when(F.col("_synonym").isNotNull(), "synonym")
        .when(F.col("fuzzy_target").isNotNull(), "fuzzy")
        .otherwise("none")
    )
    target = F.when(F.col("known"), F.col("remembered")).otherwise(F.coalesce("_proposed", "_synonym", "fuzzy_target"))
    return df.withColumns(
        {
            "canonical_field": target,
            "decided_by": decided,
            "confirmed": target.isNotNull() | F.coalesce("_answered", F.lit(False)) | F.col("known"),
        }
    ).drop("known", "remembered", "_proposed", "_answered", "_synonym", "fuzzy_score", "fuzzy_target")


def confirmed(resolved: DataFrame, decided_at: Column) -> DataFrame:
    """Memory rows of the decisions worth remembering. Headers nobody could decide are left open and tried again next time."""
    sample = F.get("samples", F.lit(0)) if "samples" in resolved.columns else F.lit("")
    return resolved.filter("confirmed").select(
        "source",
        "field_name",
        F.coalesce("canonical_field", F.lit(S.NO_TARGET)).alias("canonical_field"),
        F.coalesce(sample, F.lit("")).alias("sample_value"),
        decided_at.alias("decided_at"),
    )


def remember(memory: DataFrame, resolved: DataFrame, decided_at: Column) -> DataFrame:
    """Memory with the new decisions; a later decision on a header replaces an earlier one."""
    return upsert(memory.select(*MEMORY.fieldNames()).unionByName(confirmed(resolved, decided_at)))


def upsert(decisions: DataFrame) -> DataFrame:
    """Last decision per header. Of two decisions at one time the larger target name stays."""
    order = F.struct(F.col("decided_at"), F.col("canonical_field"))
    return latest(decisions, ["source", "field_name"], order, ["canonical_field", "sample_value", "decided_at"])


def mapping_report(resolved: DataFrame) -> DataFrame:
    """Columns that were mapped, and those that stay in the raw record only."""
    state = F.when(F.col("canonical_field").isNull(), "unmapped").otherwise("mapped")
    return resolved.select("source", "field_name", "canonical_field", state.alias("state"))


def apply_mapping(records: DataFrame, mapping: DataFrame, inline_limit: int = INLINE_LIMIT, keep_nulls: bool = False) -> DataFrame:
    """Canonical text columns from raw maps, the raw record beside them as JSON.

    Where several columns of a record map to one target, the last one with a value is taken
    (`keep_nulls`: the last one, even when it is NULL). `source` is never a target: the feed
    decides it. A mapping of ordinary size becomes part of the projection, with no join at
    all; a larger one is joined.
    """
    wanted = mapping.filter(F.col("canonical_field").isin(S.MAPPED_FIELDS)).select("source", "field_name", "canonical_field")
    rows = wanted.limit(inline_limit + 1).collect()  # headers, at most inline_limit + 1 of them
    if len(rows) > inline_limit:
        return _apply_joined(records, wanted, keep_nulls)
    fields: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    for r in rows:
        fields[r["canonical_field"]][r["source"]].append(r["field_name"])
    columns = {t: _target_value(fields.get(t, {}), keep_nulls) for t in S.MAPPED_FIELDS}
    texts = [
        F.when((F.col("source") == s) & F.arrays_overlap("not_text", F.array(*map(F.lit, names))), t)
        for t in ("first_name", "last_name", "campaign_id")
        for s, names in fields.get(t, {}).items()
    ]
    not_text = F.array_compact(F.array(*texts)) if texts and "not_text" in records.columns else F.array()
    return records.withColumns(
        {**columns, "raw_payload": F.to_json("raw"), "not_text": not_text.cast("array<string>")}
    ).drop("raw")


def _target_value(names_by_source: dict[str, list[str]], keep_nulls: bool) -> Column:
    value = None
    for source, names in names_by_source.items():
        if len(names) == 1:
            found = F.try_element_at("raw", F.lit(names[0]))
        else:
            entries = F.filter(
                F.map_entries("raw"),
                lambda e: e["key"].isin(names) & (F.lit(keep_nulls) | e["value"].isNotNull()),
            )
            found = F.try_element_at(entries, F.lit(-1))["value"]
        is_source = F.col("source") == source
        value = F.when(is_source, found) if value is None else value.when(is_source, found)
    return F.lit(None).cast("string") if value is None else value


def _apply_joined(records: DataFrame, mapping: DataFrame, keep_nulls: bool) -> DataFrame:
    """The same for a mapping of any size. A column that most records have is a heavy group."""
    header = F.struct(F.col("source").alias("source"), F.col("field_name").alias("field_name")).alias("header")
    carried = F.col("not_text") if "not_text" in records.columns else F.array().cast("array<string>")
    cells = records.select("source", "ord", carried.alias("not_text"), F.posexplode("raw").alias("pos", "field_name", "value"))
    cells = cells.select(header, "ord", "pos", "value", F.array_contains("not_text", F.col("field_name")).alias("odd"))
    sizes = cells.groupBy("header").agg(F.count("*").alias("size"))
    targets = mapping.select(header, "canonical_field").join(sizes, "header")
    hits = join_groups(cells, targets, "header", "size")
    if not keep_nulls:
        hits = hits.filter(F.col("value").isNotNull())
    of = {t: F.col("canonical_field") == t for t in S.MAPPED_FIELDS}
    wide = hits.groupBy("ord").agg(
        *[F.max_by("value", F.when(of[t], F.col("pos"))).alias(t) for t in S.MAPPED_FIELDS],
        F.collect_set(
            F.when(F.col("odd") & F.col("canonical_field").isin("first_name", "last_name", "campaign_id"), F.col("canonical_field"))
        ).alias("not_text"),
    )
    slim = records.drop("not_text").withColumn("raw_payload", F.to_json("raw")).drop("raw")
    joined = slim.join(wide, "ord", "left")
    return joined.withColumn("not_text", F.coalesce("not_text", F.array().cast("array<string>")))


# --- nearest descriptions ----------------------------------------------------------------

CORPUS_CHUNK = 1024


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 3, chunk: int = CORPUS_CHUNK) -> DataFrame:
    """The `k` corpus vectors closest to every query by cosine, as `(rank, corpus_id, similarity)`.

    `queries` has a `vector` column; `corpus` is `(corpus_id, vector)`, by design a short list of
    descriptions. It goes into the projection as one constant, so queries are neither joined
    nor shuffled. A corpus above `chunk` entries is gone through in several constants, each
    merged into the running best k.
    """
    chunks = -(-corpus.count() // chunk) or 1
    best = F.array().cast("array<struct<away:double,corpus_id:string>>")
    df = queries.withColumn("_best", best)
    part = F.pmod(F.xxhash64(F.col("corpus_id")), F.lit(chunks))
    for i in range(chunks):
        entries = corpus.filter(part == i).select(
            F.collect_list(F.struct(F.col("corpus_id").cast("string").alias("corpus_id"), F.col("vector")))
        ).scalar()
        df = df.withColumn("_corpus", entries)
        scored = F.transform(
            "_corpus",
            lambda e: F.struct(
                (-F.round(cosine(F.col("vector"), e["vector"]), 9)).alias("away"), e["corpus_id"].alias("corpus_id")
            ),
        )
        # the best k of this constant, then of these and the best so far, in the natural order of the struct
        df = df.withColumn("_best", F.slice(F.array_sort(F.concat("_best", F.slice(F.array_sort(scored), 1, k))), 1, k))
    keep = [c for c in queries.columns if c != "vector"]
    return df.select(*keep, F.posexplode("_best").alias("_pos", "_hit")).select(
        *keep, (F.col("_pos") + 1).alias("rank"), F.col("_hit.corpus_id").alias("corpus_id"), (-F.col("_hit.away")).alias("similarity")
    )


def nearest_descriptions(profiles: DataFrame, k: int = 3) -> DataFrame:
    """The canonical fields whose descriptions are closest to a header and its samples, by
    hashed TF-IDF: context for whoever resolves headers by hand or with a model."""
    spark = profiles.sparkSession
    descriptions = spark.createDataFrame(list(S.FIELD_DESCRIPTIONS.items()), "corpus_id string, text string")
    text = F.concat_ws(" ", F.translate("field_name", "_-", "  "), F.array_join(F.slice("samples", 1, 3), " "))
    headers = profiles.withColumn("text", text)
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern="[^a-z0-9]+")
    counts = HashingTF(inputCol="words", outputCol="counts", numFeatures=1024)
    idf = IDF(inputCol="counts", outputCol="weights").fit(counts.transform(words.transform(descriptions)))

    def vectors(df: DataFrame) -> DataFrame:
        out = idf.transform(counts.transform(words.transform(df)))
        return out.withColumn("vector", vector_to_array("weights")).drop("text", "words", "counts", "weights")

    return nearest(vectors(headers), vectors(descriptions), k).withColumnRenamed("corpus_id", "canonical_field")


def field_names(records: DataFrame) -> DataFrame:
    """Column names in use per source."""
    return records.select("source", F.explode(F.map_keys("raw")).alias("field_name")).distinct()

