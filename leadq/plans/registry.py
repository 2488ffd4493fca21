"""The registered queries: every operator over whole tables, by name."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadq import generate, model
from leadq import schema as S
from leadq.functions import cleaning as C
from leadq.functions import display, signals
from leadq.functions import scoring as R
from leadq.operators import analytics as A
from leadq.operators import clean, datasets, dedup, mapping, quarantine, ranking, score, store, validate
from leadq.plans import batch
from leadq.plans import fixture as X
from leadq.session import new_folder, staged
from leadq.sources import feeds, files, text
from leadq.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _shown_time(df: DataFrame, column: str = "created_at") -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))


# --- cleaning ----------------------------------------------------------------------------


@register
def split_full_name(spark, sf):
    words = X.submissions(spark, sf).select("ord", C.name_words(F.concat_ws(" ", "fname", "lname")).alias("words"))
    return words.select("ord", C.first_word(F.col("words")).alias("first_name"), C.rest_of_words(F.col("words")).alias("last_name"))


@register
def name_rescue(spark, sf):
    full = F.concat(F.lit("Pat "), F.coalesce("lname", F.lit("Doe Roe")))
    names = X.submissions(spark, sf).select("ord", full.alias("full_name"), F.col("fname").alias("first_name"), F.col("lname").alias("last_name"))
    return clean.rescue_names(names)


@register
def normalize_phone(spark, sf):
    s = X.submissions(spark, sf).select("ord", "phone", F.col("phone").alias("phone_e164"))
    return clean.clean_phone(s)


@register
def normalize_email(spark, sf):
    return clean.clean_email(X.submissions(spark, sf).select("ord", "email"))


@register
def email_typo_fix(spark, sf):
    s = X.submissions(spark, sf).select("ord", C.valid_email(C.email_text(F.col("email"))).alias("email"))
    return s.filter(F.col("email").isNotNull()).withColumn("fixed", C.fix_email_domain(F.col("email")))


@register
def parse_datetime(spark, sf):
    s = X.submissions(spark, sf).select("ord", "ts_raw", F.col("ts_raw").alias("created_at"))
    return _shown_time(clean.clean_timestamp(s))


@register
def normalize_consent(spark, sf):
    s = X.submissions(spark, sf)
    return s.select("ord", F.col("consent").alias("raw_consent"), C.normalize_consent(F.col("consent")).alias("consent"))


@register
def clean_leads(spark, sf):
    cleaned = clean.clean_leads(X.mapped(spark, sf))
    return _shown_time(cleaned).select(
        "ord", "source", "first_name", "last_name", "email", "phone_e164", "campaign_id", "consent", "created_at"
    )


@register
def contract_check(spark, sf):
    return clean.contract_report(clean.clean_leads(X.mapped(spark, sf)))


# --- validation --------------------------------------------------------------------------


@register
def name_letters(spark, sf):
    return X.submissions(spark, sf).select("ord", "fname", C.usable_name(F.col("fname")).alias("usable"))


def _validated(spark, sf):
    return validate.validate(clean.clean_leads(X.mapped(spark, sf)), X.batch_ts())


@register
def validate_split(spark, sf):
    shown = F.transform("errors", lambda e: F.concat_ws(": ", F.array_join(e["loc"], "."), e["type"]))
    return _validated(spark, sf).select("ord", "lead_id", (F.size("errors") == 0).alias("is_valid"), F.array_join(shown, "; ").alias("errors"))


@register
def valid_rate(spark, sf):
    return validate.valid_rate(_validated(spark, sf)).withColumn("valid_rate", F.round("valid_rate", 9))


# --- features, score, explanation ---------------------------------------------------------


@register
def build_features(spark, sf):
    return score.features(X.scored(spark, sf))


@register
def email_domain_class(spark, sf):
    return X.scored(spark, sf).select("ord", "email", signals.email_class(F.col("email")).alias("email_class"))


@register
def placeholder_email(spark, sf):
    return X.scored(spark, sf).select("ord", "email", signals.is_placeholder_email(F.col("email")).alias("is_placeholder"))


@register
def placeholder_name(spark, sf):
    of = signals.is_placeholder_name
    return X.submissions(spark, sf).select(
        "ord", of(F.col("fname")).alias("first_is_placeholder"), of(F.col("lname")).alias("last_is_placeholder")
    )


@register
def placeholder_phone(spark, sf):
    return X.scored(spark, sf).select("ord", "phone_e164", signals.is_placeholder_phone(F.col("phone_e164")).alias("is_placeholder"))


@register
def rule_score(spark, sf):
    return score.with_signals(X.scored(spark, sf)).select("ord", R.rule_score(F.col("_signals")).alias("score"))


@register
def score_batch(spark, sf):
    return X.scored(spark, sf).select("lead_id", "quality_score")


@register
def score_band(spark, sf):
    s = F.col("quality_score")
    return X.scored(spark, sf).select("ord", R.band(s).alias("band"), R.shown_score(s).alias("shown"))


@register
def explain_signals(spark, sf):
    e = score.explain(X.scored(spark, sf))
    return e.select("ord", *[F.array_join(c, " | ").alias(c) for c in ("positive_signals", "negative_signals")])


@register
def diagnose(spark, sf):
    return score.explain(X.scored(spark, sf)).select("ord", "diagnosis")


@register
def suggest_action(spark, sf):
    return score.explain(X.scored(spark, sf)).select("ord", "suggested_action")


@register
def flag_leads(spark, sf):
    return score.flag(X.scored(spark, sf)).select("ord", "status")


@register
def lead_explain(spark, sf):
    e = ranking.explained(X.leads(spark, sf))
    return e.withColumns({c: F.array_join(c, " | ") for c in ("positive_signals", "negative_signals")})


@register
def rescore(spark, sf):
    tables = X.leads(spark, sf).unionByName(X.duplicates(spark, sf))
    stale = tables.withColumns({"quality_score": F.lit(0.0), "diagnosis": F.lit("old"), "suggested_action": F.lit("old")})
    return score.rescore(stale).select("lead_id", "quality_score", "status", "diagnosis", "suggested_action")


@register
def training_set(spark, sf):
    return model.training_set(X.scored(spark, sf)).withColumn("label", F.round("label", 6))


@register
def train_scorer(spark, sf):
    rows = staged(model.training_set(X.scored(spark, sf)), "training")
    trees, error = model.train(rows)
    train_rows, test_rows = model.hold_out(rows)
    counts = train_rows.select(F.lit("train").alias("part")).unionByName(test_rows.select(F.lit("test").alias("part")))
    return counts.groupBy("part").agg(F.count("*").alias("rows")).withColumn("mae", F.lit(round(error, 3)))


# --- entity resolution --------------------------------------------------------------------


@register
def match_edges(spark, sf):
    return dedup.match_edges(X.scored(spark, sf))


@register
def connected_components(spark, sf):
    return dedup.components(staged(X.scored(spark, sf).select("ord", "email", "phone_e164", "dataset_id"), "keys"))


@register
def survivor(spark, sf):
    return dedup.survivors(staged(X.scored(spark, sf), "scored"))


def _resolved(r: dedup.Resolved) -> DataFrame:
    columns = ["ord", "lead_id", "dataset_id", "status", "duplicate_of_lead_id"]
    return r.kept.select(*columns).unionByName(r.duplicates.select(*columns))


@register
def deduplicate(spark, sf):
    return _resolved(dedup.resolve(X.scored(spark, sf))).drop("dataset_id")


def _halves(spark, sf):
    leads = X.scored(spark, sf)
    return leads.filter(F.col("order_day") > X.STORED_UNTIL), leads.filter(F.col("order_day") <= X.STORED_UNTIL)


def _indexed(spark, leads, datasets=None):
    """The key index of a store that holds these leads."""
    tables = store.Store(spark, new_folder(spark, "indexed"))
    tables.append("leads", leads, "b0", datasets=datasets)
    return tables.key_index()


@register
def existing_keys(spark, sf):
    incoming, stored = _halves(spark, sf)
    return dedup.existing_keys(staged(incoming, "incoming"), _indexed(spark, stored), dedup.GLOBAL)


@register
def cross_batch_dedup(spark, sf):
    incoming, stored = _halves(spark, sf)
    return _resolved(dedup.against_stored(staged(incoming, "incoming"), _indexed(spark, stored), dedup.GLOBAL)).drop("dataset_id")


@register
def dataset_scoped_dedup(spark, sf):
    rows, until = X.mapped(spark, sf), F.col("order_day") <= X.STORED_UNTIL
    first = batch.process(rows.filter(until), X.batch_ts())
    second = batch.process(rows.filter(~until), X.batch_ts(), stored=_indexed(spark, first.leads, first.datasets))
    return _resolved(dedup.Resolved(second.leads, second.duplicates)).drop("dataset_id")


# --- lists --------------------------------------------------------------------------------


@register
def top_leads(spark, sf):
    return _shown_time(ranking.top_leads(X.leads(spark, sf), 8))


@register
def ranked_page(spark, sf):
    return _shown_time(ranking.ranked_page(X.leads(spark, sf), 10, 20, min_score=40, max_score=69))


@register
def search_leads(spark, sf):
    return _shown_time(ranking.search(X.leads(spark, sf), q="Ada"))


def _accepted(spark, sf):
    return store.record_dispositions(X.disposition_requests(spark, sf), X.leads(spark, sf))


@register
def call_list(spark, sf):
    return _shown_time(ranking.call_list(X.leads(spark, sf), _accepted(spark, sf)[0]))


@register
def set_disposition(spark, sf):
    accepted, refused = _accepted(spark, sf)
    columns = ["seq", "lead_id", "disposition", "outcome"]
    return (
        accepted.withColumn("outcome", F.lit("accepted")).select(*columns)
        .unionByName(refused.withColumnRenamed("reason", "outcome").select(*columns))
    )


@register
def filter_leads(spark, sf):
    kept = ranking.filter_leads(X.leads(spark, sf), ["facebook", "csv_upload"], [S.CLEAN, S.FLAGGED], 40, 80)
    return kept.select("lead_id", "source", "status", "quality_score")


@register
def preset_filters(spark, sf):
    return ranking.preset_counts(X.leads(spark, sf))


@register
def recent_rows(spark, sf):
    return store.recent(X.duplicates(spark, sf), 25).select("ord", "lead_id", "duplicate_of_lead_id")


@register
def export_csv(spark, sf):
    path = new_folder(spark, "export")
    files.export_dataset(X.leads(spark, sf), "d1", path)
    return (
        spark.read.option("header", True).option("escape", '"').csv(path)
        .select("lead_id", "email", "phone_e164", F.col("quality_score").cast("double"), "status")
    )


@register
def export_filtered(spark, sf):
    path = new_folder(spark, "export")
    files.export_filtered(X.leads(spark, sf), path, sources=["facebook", "csv_upload"], statuses=[S.CLEAN, S.FLAGGED], low=40, high=80)
    return spark.read.option("header", True).option("escape", '"').csv(path).select("lead_id", "source", "status", F.col("quality_score").cast("double"))


@register
def preview_without_consent(spark, sf):
    return ranking.without_consent(X.leads(spark, sf))


@register
def preview_invalid(spark, sf):
    return store.recent(X.invalid(spark, sf), 25).select("ord", "source", "dataset_id")


@register
def raw_payload(spark, sf):
    """The raw record of an upload beside its canonical fields."""
    raw = X.raw_records(spark, sf).filter("source = 'csv_upload'")
    mapped = mapping.apply_mapping(raw, staged(_decisions(spark, sf), "mapping"))
    return mapped.select("ord", "email", F.get_json_object("raw_payload", "$['Work Email']").alias("work_email"), F.get_json_object("raw_payload", "$.Cell").alias("cell"))


# --- aggregates ---------------------------------------------------------------------------


def _tables(spark, sf):
    return X.leads(spark, sf), X.duplicates(spark, sf), X.invalid(spark, sf)


def _over_leads(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: fn(X.leads(spark, sf))


def _over_tables(name: str, fn: Callable[..., DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: fn(*_tables(spark, sf))


_over_leads("analytics_by_source", A.by_source)
_over_leads("score_buckets", A.score_buckets)
_over_leads("metrics_rollup", A.rollup_metrics)
_over_leads("kpis", A.kpis)
_over_leads("band_butterfly", lambda leads: A.status_by_band(leads, A.BUTTERFLY, "band"))
_over_leads("score_histogram5", lambda leads: A.status_by_band(leads, A.FIVE_BUCKETS, "bucket"))
_over_leads("score_histogram20", A.histogram)
_over_leads("avg_by_source", A.average_by_source)
_over_leads("quality_funnel", A.quality_funnel)
_over_leads("signal_completeness", A.signal_completeness)
_over_leads("scored_completeness", A.scored_completeness)
_over_leads("compliance_gaps", A.compliance_gaps)
_over_leads("band_counts", A.band_counts)
_over_tables("source_performance", A.source_performance)
_over_tables("best_worst_source", lambda *t: A.best_worst_source(A.source_performance(*t)))
_over_tables("outcome_split", A.outcome_split)
_over_tables("overview_totals", A.overview_totals)
_over_tables("batch_summary", A.batch_summary)
_over_tables("dataset_summary", datasets.dataset_counts)


@register
def invalid_by_source(spark, sf):
    return A.count_by_source(X.invalid(spark, sf))


@register
def duplicate_by_source(spark, sf):
    return A.count_by_source(X.duplicates(spark, sf))


@register
def stats(spark, sf):
    return A.stats(*_tables(spark, sf), X.healing_events(spark, sf), X.stored(spark, sf).read("quarantine"))


@register
def top_failures(spark, sf):
    return A.top_failures(X.invalid(spark, sf))


@register
def filtered_kpis(spark, sf):
    leads = ranking.filter_leads(X.leads(spark, sf), ["facebook", "instagram", "landing_page"], [S.CLEAN, S.FLAGGED])
    return A.filtered_kpis(leads)


@register
def failure_types(spark, sf):
    return A.failure_types(X.healing_events(spark, sf))


# --- datasets and runs --------------------------------------------------------------------

_NOW = "2024-03-01 00:00:00"


@register
def dataset_scope(spark, sf):
    return A.by_source(store.scoped(X.leads(spark, sf), "d2"))


@register
def backfill_datasets(spark, sf):
    untagged = [t.withColumn("dataset_id", F.lit(None).cast("string")) for t in _tables(spark, sf)]
    return datasets.backfill_datasets(*untagged)


@register
def list_datasets(spark, sf):
    listed = _shown_time(datasets.list_datasets(X.dataset_log(spark, sf)))
    return listed.select("dataset_id", "name", "file_name", "source_kind", "status", "notes", "tags", "created_at")


@register
def update_dataset(spark, sf):
    log = X.dataset_log(spark, sf)
    changes = log.select("dataset_id").distinct().select(
        "dataset_id", F.lit(" ").alias("name"), F.concat(F.lit("seen "), "dataset_id").alias("notes"), F.lit(None).cast("string").alias("tags")
    )
    after = log.unionByName(datasets.update_rows(log, changes, batch.timestamp(_NOW)))
    return datasets.current_datasets(after).select("dataset_id", "name", "file_name", "status", "notes", "tags")


@register
def delete_dataset(spark, sf):
    log = X.dataset_log(spark, sf)
    rows = X.table(spark, sf, "events").select(F.concat(F.lit("ds-"), F.col("user_id").cast("string")).alias("dataset_id"), "event_id")
    return store.active(rows, log)


@register
def run_history(spark, sf):
    runs = datasets.recent_runs(X.run_log(spark, sf))
    return runs.select("run_id", "source", "status", "total_records", "processed", "failed", "time_taken_ms")


@register
def pretty_source(spark, sf):
    source, nothing = F.col("source"), F.lit(None).cast("string")
    return X.submissions(spark, sf).select("source").distinct().select(
        "source", display.pretty_source(source).alias("shown"), display.import_name(nothing, nothing, source).alias("import_name")
    )


@register
def lead_name(spark, sf):
    return X.submissions(spark, sf).select("ord", display.lead_name(F.col("fname"), F.col("lname")).alias("name"))


# --- batches over a store -----------------------------------------------------------------

_books: dict[tuple[str, str], store.Store] = {}


_ticks = itertools.count()


def _clock() -> batch.datetime:
    """A clock that moves on by a second whenever it is read."""
    return batch.datetime.fromisoformat(_NOW) + timedelta(seconds=next(_ticks))


def _run(rows: DataFrame, tables: store.Store, dataset_id: str, batch_id: str, bad: DataFrame | None = None) -> None:
    bad = quarantine.empty(rows.sparkSession) if bad is None else bad
    batch.run_mapped(rows, bad, tables, dataset_id, batch_id, batch.datetime.fromisoformat(X.BATCH_TS), source_kind="csv_upload", clock=_clock)


def _kept_books(spark, sf) -> store.Store:
    """Three batches into three new datasets; nothing lands in the third."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _books:
        tables, rows = store.Store(spark, new_folder(spark, "books")), X.mapped(spark, sf)
        for d in ("d1", "d2", "d3"):
            _run(rows.filter(F.col("dataset_id") == d), tables, d, f"run-{d}")
        _books[key] = tables
    return _books[key]


@register
def dataset_lifecycle(spark, sf):
    state = datasets.current_datasets(_kept_books(spark, sf).read("datasets"))
    return state.select("dataset_id", "name", "status", "total_leads", "clean", "flagged", "invalid", "duplicates", "avg_score")


@register
def run_lifecycle(spark, sf):
    return datasets.current_runs(_kept_books(spark, sf).read("pipeline_runs")).select("run_id", "source", "status", "total_records", "processed", "failed", "duplicates")


@register
def log_snapshots(spark, sf):
    """What `dataset_lifecycle` shows, where logs are compacted before every batch: states come from snapshots and what was appended since."""
    tables, rows = store.Store(spark, new_folder(spark, "compacted")), X.mapped(spark, sf)
    for d in ("d1", "d2", "d3"):
        tables.compact_logs(after=1)
        _run(rows.filter(F.col("dataset_id") == d), tables, d, f"run-{d}")
    state = datasets.current_datasets(tables.read("datasets"))
    return state.select("dataset_id", "name", "status", "total_leads", "clean", "flagged", "invalid", "duplicates", "avg_score")


@register
def get_dataset(spark, sf):
    return datasets.get_dataset(X.dataset_log(spark, sf), "ds-7").select("dataset_id", "name", "file_name", "status", "notes", "tags")


@register
def run_summary(spark, sf):
    return batch.summary(_kept_books(spark, sf), "run-d2")


@register
def two_batches_one_dataset(spark, sf):
    """Two batches whose records have the same positions, into one dataset."""
    tables, rows = store.Store(spark, new_folder(spark, "two")), X.mapped(spark, sf)
    for part in (0, 1):
        _run(rows.filter(F.col("ord") % 2 == part).withColumn("ord", F.floor(F.col("ord") / 2)), tables, "d", f"b{part}")
    valid = tables.read("leads").select("lead_id", "ord").unionByName(tables.read("duplicate_leads").select("lead_id", "ord"))
    return valid.agg(F.count("*").alias("valid"), F.count_distinct("lead_id").alias("lead_ids"), F.count_distinct("ord").alias("positions"))


@register
def failure_log(spark, sf):
    """A batch that fails to be read, then fails to be processed, then succeeds: the events of both attempts and what landed."""
    tables, rows = store.Store(spark, new_folder(spark, "failing")), X.mapped(spark, sf).filter("dataset_id = 'd1'")
    now, none = batch.datetime.fromisoformat(X.BATCH_TS), quarantine.empty(spark)
    for go in (
        lambda: batch.run(lambda: feeds.ingest(spark, {"fax": sf}), tables, mapping.starter_memory(spark), "d1", "b", now, source_kind="csv_upload", clock=_clock),
        lambda: batch.run_mapped(rows.drop("ord"), none, tables, "d1", "b", now, source_kind="csv_upload", clock=_clock),
        lambda: _run(rows, tables, "d1", "b"),
    ):
        try:
            go()
        except Exception as error:  # the batch has logged it
            failed = type(error).__name__
            assert tables.read("healing_events").filter(F.col("exception_type") == failed).count() == 1
    events = tables.read("healing_events").select("batch_id", F.concat(F.lit("attempt "), F.col("attempt").cast("string")).alias("figure"), F.count("*").over(W.partitionBy("attempt")).alias("n"))
    runs = datasets.current_runs(tables.read("pipeline_runs")).select(F.col("run_id").alias("batch_id"), F.concat(F.lit("run "), "status").alias("figure"), F.col("total_records").alias("n"))
    state = datasets.current_datasets(tables.read("datasets")).select(F.lit("b").alias("batch_id"), F.concat(F.lit("dataset "), "status").alias("figure"), F.col("total_leads").alias("n"))
    return events.unionByName(runs).unionByName(state)


@register
def dense_positions(spark, sf):
    """Two uploads, the first of them run twice: each takes as many positions as it has records, and a retry gives the same lead ids."""
    tables, raw = store.Store(spark, new_folder(spark, "dense")), X.raw_records(spark, sf)
    ids = []
    for batch_id in ("d1", "d2", "d1"):
        own = raw.filter(F.col("dataset_id") == batch_id)
        parts = max(7, -(-own.count() // _FILE_ROWS))  # one task sorts and numbers a part
        own = own.repartition(parts, "ord").sortWithinPartitions("ord")
        feed = feeds.Feed(own.select("source", "raw", F.array().cast("array<string>").alias("not_text")), quarantine.empty(spark))
        batch.run(feed, tables, mapping.starter_memory(spark), "d", batch_id, batch.datetime.fromisoformat(X.BATCH_TS), clock=_clock)
        ids.append(staged(tables.read("leads").filter(F.col("batch_id") == "d1").select("lead_id"), "ids", keep=True))
    placed = store.union_by_name([t.select("batch_id", "ord") for t in map(tables.read, ("leads", "duplicate_leads", "invalid_leads"))])
    figures = placed.groupBy("batch_id").agg(
        F.count("*").alias("records"), F.count_distinct("ord").alias("positions"), (F.max("ord") - F.min("ord") + 1).alias("span")
    )
    taken = tables.read("batches").select("batch_id", F.lit("taken").alias("figure"), (F.col("next_ord") - F.col("first_ord")).alias("n"))
    changed = ids[0].exceptAll(ids[2]).unionByName(ids[2].exceptAll(ids[0])).agg(F.lit("d1").alias("batch_id"), F.lit("changed lead ids").alias("figure"), F.count("*").alias("n"))
    return figures.unpivot("batch_id", ["records", "positions", "span"], "figure", "n").unionByName(taken).unionByName(changed)


@register
def batch_retry(spark, sf):
    """A batch that is run again with fewer rows leaves the tables as if only the second run had been."""
    tables, rows = store.Store(spark, new_folder(spark, "retry")), X.mapped(spark, sf)
    for part in (rows, rows.filter("dataset_id = 'd1'")):
        bad = quarantine.entries(part, "csv_upload", F.col("ord").cast("string"), F.lit("unreadable row"), F.lit("test"))
        _run(part, tables, "d1", "b", bad)
    counts = [tables.read(t).agg(F.lit(t).alias("table"), F.count("*").alias("rows")) for t in ("leads", "duplicate_leads", "invalid_leads", "quarantine")]
    return store.union_by_name(counts)


@register
def mapping_persisted(spark, sf):
    """What the store remembers of the columns of an upload."""
    tables, raw = store.Store(spark, new_folder(spark, "memory")), X.raw_records(spark, sf)
    feed = feeds.Feed(raw.select("source", "raw", F.array().cast("array<string>").alias("not_text")), quarantine.empty(spark))
    batch.run(feed, tables, mapping.starter_memory(spark), "d", "b0", batch.datetime.fromisoformat(X.BATCH_TS), clock=_clock)
    return mapping.upsert(tables.read("mapping_memory")).select("source", "field_name", "canonical_field")


@register
def get_lead(spark, sf):
    leads = X.leads(spark, sf)
    wanted = leads.agg(F.max("lead_id")).first()[0]
    return _shown_time(ranking.lead_by_id(leads, wanted)).select("lead_id", "email", "phone_e164", "quality_score", "status", "created_at")


# --- sources ------------------------------------------------------------------------------


@register
def na_tokens(spark, sf):
    s = X.submissions(spark, sf)
    return s.select("ord", feeds.na_to_null(F.col("phone")).alias("phone"), feeds.na_to_null(F.col("email")).alias("email"))


@register
def decode_bom(spark, sf):
    raw = X.table(spark, sf, "documents").select("doc_id", F.encode(F.concat(F.lit("﻿"), F.col("text")), "utf-8").alias("content"))
    decoded = raw.select("doc_id", text.decode_text(F.col("content")).alias("text"))
    return decoded.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


def _written(spark, name: str, lines: DataFrame) -> str:
    path = new_folder(spark, name)
    files.write_json_lines(lines, path)
    return path


def _facebook_lines(s: DataFrame) -> DataFrame:
    full = F.when(F.col("fname").isNotNull() | F.col("lname").isNotNull(), F.concat_ws(" ", "fname", "lname"))
    fields = {"full_name": full, "email": F.col("email"), "phone_number": F.col("phone"), "consent": F.col("consent")}
    return files.webhook_json(
        s.filter("source = 'facebook'").select(
            F.col("ord").cast("string").alias("leadgen_id"), F.col("campaign").alias("form_id"), F.lit("1").alias("page_id"),
            F.col("ts_raw").alias("created_time"),
            F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in fields.items()]).alias("fields"),
        )
    )


def _landing_lines(s: DataFrame) -> DataFrame:
    def maybe_number(flag: str, column: str):
        as_text = F.to_json(F.struct(F.col(column).alias("v")))
        quoted = F.regexp_extract(as_text, r'^\{"v":(.*)\}$', 1)
        return F.when(F.col(flag) == 1, F.col("ord").cast("string")).otherwise(F.when(quoted != "", quoted).otherwise("null"))

    rest = F.to_json(
        F.struct(
            F.col("lname"), F.col("email").alias("email_addr"), F.col("phone").alias("mobile"), F.col("consent").alias("opt_in"),
            F.lit("landing_page").alias("utm_source"), F.col("ts_raw").alias("ts"),
        )
    )
    line = F.concat(
        F.lit('{"fname":'), maybe_number("fname_is_number", "fname"), F.lit(',"utm_campaign":'),
        maybe_number("campaign_is_number", "campaign"), F.lit(","), F.substring(rest, F.lit(2), F.length(rest)),
    )
    return s.filter("source = 'landing_page'").select(line.alias("value"))


def _field(name: str):
    return F.try_element_at("raw", F.lit(name))


@register
def scan_facebook(spark, sf):
    feed = feeds.read_facebook(spark, _written(spark, "facebook", _facebook_lines(X.submissions(spark, sf))))
    names = ["leadgen_id", "form_id", "full_name", "email", "phone_number", "consent", "created_time"]
    return feed.records.select(*[_field(n).alias(n) for n in names])


@register
def scan_landing_page(spark, sf):
    feed = feeds.read_landing_page(spark, _written(spark, "landing", _landing_lines(X.submissions(spark, sf))))
    names = ["fname", "lname", "email_addr", "mobile", "opt_in", "utm_campaign", "ts"]
    return feed.records.select(*[_field(n).alias(n) for n in names], F.array_join(F.array_sort("not_text"), ",").alias("not_text"))


@register
def scan_json_shapes(spark, sf):
    """Submissions as single objects and as arrays with things in them that are no objects."""
    s = X.submissions(spark, sf)
    obj = F.to_json(F.struct(F.col("ord").cast("string").alias("ord_text"), "email"))
    line = F.when(F.length("order_day") + F.length(obj) % 2 == 10, obj).otherwise(F.concat(F.lit("[17, "), obj, F.lit(', "x"]')))
    feed = feeds.read_landing_page(spark, _written(spark, "shapes", s.select(line.alias("value"))))
    return feed.records.select(_field("ord_text").alias("ord_text"), _field("email").alias("email"))


_FORM = {"name": "What's your name?", "email": "Your email address", "phone": "Best number to reach you", "consent": "Do you agree to be contacted?", "ts": "Timestamp"}
_EXPORT = {"name": "Full Name", "email": "E-mail", "phone": "Phone #", "consent": "Opted In", "ts": "Date"}
_UPLOAD = {"ts": "Submitted At", "phone": "Cell", "name": "Lead", "email": "Work Email", "consent": "OK to call"}
_CSV_FEEDS = {"instagram": _EXPORT, "google_form": _FORM, "csv_upload": _UPLOAD}


def _write_csv_feeds(spark, s: DataFrame) -> dict[str, str]:
    full = F.when(F.col("fname").isNotNull() | F.col("lname").isNotNull(), F.concat_ws(" ", "fname", "lname"))
    values = {"name": full, "email": F.col("email"), "phone": F.col("phone"), "consent": F.col("consent"), "ts": F.col("ts_raw")}
    paths = {}
    for source, headers in _CSV_FEEDS.items():
        paths[source] = new_folder(spark, source)
        files.write_csv(s.filter(F.col("source") == source).select(*[values[k].alias(h) for k, h in headers.items()]), paths[source])
    return paths


@register
def scan_csv(spark, sf):
    paths = _write_csv_feeds(spark, X.submissions(spark, sf))
    out = []
    for source, headers in _CSV_FEEDS.items():
        records = feeds.READERS[source](spark, paths[source]).records
        out.append(records.select("source", *[_field(h).alias(k) for k, h in headers.items()]))
    return store.union_by_name(out)


@register
def scan_csv_folder(spark, sf):
    """The CSV feeds of three headers, read as one folder of uploads."""
    paths = _write_csv_feeds(spark, X.submissions(spark, sf))
    records = feeds.read_csv_upload(spark, list(paths.values())).records
    return records.select(*[F.coalesce(*[_field(h[k]) for h in _CSV_FEEDS.values()]).alias(k) for k in _FORM])


#: Rows of a CSV file that `scan_csv_quotes` writes, about, and of a part of the uploads of `dense_positions`.
_FILE_ROWS = 250_000


@register
def scan_csv_quotes(spark, sf):
    """Submissions as CSV files whose values hold line breaks, quotes and commas, read in splits."""
    s = X.submissions(spark, sf)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    note = F.concat(F.lit("said "), F.lit('"'), "order_day", F.lit('",\nthen "'), F.coalesce("email", F.lit("")), F.lit("\n\nend"))
    cells = [F.col("ord").cast("string"), F.when(F.col("ord") % 3 == 0, quoted(note)).otherwise(F.concat("order_day", F.lit('"'))), quoted(F.coalesce("email", F.lit("?")))]
    path = new_folder(spark, "quotes")
    parts = max(4, -(-s.count() // _FILE_ROWS))  # one task sorts and writes a file
    rows = s.repartition(parts, "ord").sortWithinPartitions("ord").select(F.concat_ws(",", *cells).alias("value"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    headers = rows.select("part").distinct().select(F.lit("Ref,Note,Mail").alias("value"), "part", F.lit(-1).cast("long").alias("at"))
    rows.unionByName(headers).repartition(parts, "part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(path)
    records = feeds.read_csv_upload(spark, path).records
    return records.select(*[_field(h).alias(h.lower()) for h in ("Ref", "Note", "Mail")])


@register
def scan_bad_first_line(spark, sf):
    """Submissions as JSON lines in files whose first line is cut off."""
    s = X.submissions(spark, sf).select("ord", "email", F.pmod("ord", F.lit(4)).alias("file"))
    lines = s.select("file", "ord", F.to_json(F.struct(F.col("ord").cast("string").alias("ord_text"), "email")).alias("value"))
    bad = s.select("file").distinct().select("file", F.lit(-1).cast("long").alias("ord"), F.lit('{"ord_text": "').alias("value"))
    path = new_folder(spark, "cut")
    lines.unionByName(bad).repartition(4, "file").sortWithinPartitions("file", "ord").select("file", "value").write.partitionBy("file").text(path)
    feed = feeds.read_landing_page(spark, path)
    rows = feed.records.select(_field("ord_text").alias("ord_text"), _field("email").alias("email"))
    return rows.unionByName(feed.quarantine.select(F.col("raw_data").alias("ord_text"), F.col("error_message").alias("email")))


@register
def scan_json_array(spark, sf):
    """Submissions as eight files of one pretty-printed array each."""
    s = X.submissions(spark, sf).select("ord", "email", F.pmod("ord", F.lit(8)).alias("file"))
    record = F.concat(F.lit('{\n  "ord_text": "'), F.col("ord").cast("string"), F.lit('",\n  "email": '), F.coalesce(F.concat(F.lit('"'), "email", F.lit('"')), F.lit("null")), F.lit("\n}"))
    ends = s.groupBy("file").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    line = F.concat(F.when(F.col("ord") == F.col("first"), "[").otherwise(","), record, F.when(F.col("ord") == F.col("last"), "\n]").otherwise(""))
    path = new_folder(spark, "arrays")
    lines = s.join(ends, "file").select("file", "ord", line.alias("value")).repartition(8, "file").sortWithinPartitions("file", "ord")
    lines.select("file", "value").write.partitionBy("file").text(path)
    feed = feeds.read_landing_page(spark, path)
    return feed.records.select(_field("ord_text").alias("ord_text"), _field("email").alias("email"))


@register
def ingest_union(spark, sf):
    s = X.submissions(spark, sf)
    paths = {
        "facebook": _written(spark, "facebook", _facebook_lines(s)),
        "landing_page": _written(spark, "landing", _landing_lines(s)),
        **_write_csv_feeds(spark, s),
    }
    records = feeds.ingest(spark, paths).records
    email = F.coalesce(*[_field(n) for n in ("email", "email_addr", "E-mail", "Your email address", "Work Email")])
    phone = F.coalesce(*[_field(n) for n in ("phone_number", "mobile", "Phone #", "Best number to reach you", "Cell")])
    return records.select("source", _field("_source").alias("tag"), email.alias("email"), phone.alias("phone"))


@register
def quarantine_rows(spark, sf):
    s = X.submissions(spark, sf)
    broken = F.concat(F.lit('{"ord": '), F.col("ord").cast("string"))
    both = s.select(F.explode(F.array(broken, F.concat(broken, F.lit("}")))).alias("value"))
    feed = feeds.read_landing_page(spark, _written(spark, "broken", both))
    tables = store.Store(spark, new_folder(spark, "quarantine"))
    tables.append("quarantine", feed.quarantine, "b0")
    return tables.read("quarantine").drop("batch_id")


def _datasets(rows: DataFrame) -> int:
    """How many datasets stored rows belong to, from the names of their folders."""
    return rows.select("dataset_id").distinct().count()


@register
def schema_evolution(spark, sf):
    """A lead table whose second batch brought a column that the first one lacked."""
    tables, leads = store.Store(spark, new_folder(spark, "evolving")), X.leads(spark, sf).drop("batch_id")
    tables.append("leads", store.scoped(leads, "d1"), "b1", datasets=1)
    tables.append("leads", store.scoped(leads, "d2").withColumn("channel", F.col("source")), "b2", datasets=1)
    return tables.read_as_written("leads").select("ord", "channel")


@register
def clear_tables(spark, sf):
    tables, leads = store.Store(spark, new_folder(spark, "cleared")), X.leads(spark, sf).drop("batch_id")
    tables.append("leads", leads, "b1", datasets=_datasets(leads))
    outcome = tables.clear()
    counts = [
        tables.read(t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), F.lit(outcome[t]).alias("outcome"), "rows")
        for t in S.RESET_TABLES
    ]
    return store.union_by_name(counts)


# --- mapping ------------------------------------------------------------------------------


@register
def profile_fields(spark, sf):
    profiles = mapping.profile_fields(X.raw_records(spark, sf))
    return profiles.withColumn("samples", F.array_join("samples", " | "))


def _headers(spark, sf):
    return mapping.field_names(X.raw_records(spark, sf))


@register
def mapping_memory(spark, sf):
    return mapping.known_mapping(_headers(spark, sf), mapping.starter_memory(spark)).select("source", "field_name", "remembered", "known")


@register
def mapping_synonym(spark, sf):
    return _headers(spark, sf).withColumn("target", mapping.synonym_target(F.col("field_name")))


@register
def mapping_fuzzy(spark, sf):
    return mapping.with_fuzzy_target(_headers(spark, sf), F.lit(True)).withColumn("fuzzy_score", F.round("fuzzy_score", 6))


def _decisions(spark, sf):
    return mapping.resolve_mapping(_headers(spark, sf), mapping.starter_memory(spark))


@register
def resolve_mapping(spark, sf):
    return _decisions(spark, sf).select("source", "field_name", "canonical_field")


@register
def mapping_report(spark, sf):
    return mapping.mapping_report(_decisions(spark, sf))


@register
def apply_mapping(spark, sf):
    mapped = mapping.apply_mapping(X.raw_records(spark, sf), staged(_decisions(spark, sf), "mapping"))
    return mapped.select("ord", "source", *S.MAPPED_FIELDS)


@register
def mapping_upsert(spark, sf):
    target = F.when(F.col("value") < 10, S.NO_TARGET).when(F.col("value") < 30, "email").otherwise("phone_e164")
    decisions = X.table(spark, sf, "events").select(
        F.col("event_type").alias("source"),
        F.concat(F.lit("column "), F.col("user_id").cast("string")).alias("field_name"),
        target.alias("canonical_field"), F.col("props").alias("sample_value"), F.col("ts").alias("decided_at"),
    )
    return mapping.upsert(decisions).select("source", "field_name", "canonical_field", "sample_value")


@register
def nearest_topk(spark, sf):
    """Every embedding against the mean vectors of the labels."""
    e = X.table(spark, sf, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("vector"))
    corpus = centres.select(F.col("label").cast("string").alias("corpus_id"), "vector")
    hits = mapping.nearest(e.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")), staged(corpus, "centres"))
    return hits.withColumn("similarity", F.round("similarity", 6))


@register
def nearest_descriptions(spark, sf):
    hits = mapping.nearest_descriptions(mapping.profile_fields(X.raw_records(spark, sf)))
    return hits.select("source", "field_name", "rank", "canonical_field", F.round("similarity", 6).alias("similarity"))


# --- generated feeds and streams ----------------------------------------------------------


@register
def generate_leads(spark, sf):
    people = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"))
    return generate.submissions(people, batch.datetime.fromisoformat(X.BATCH_TS))


@register
def feed_to_leads(spark, sf):
    """Generated feeds written as files, read back, mapped, and processed into lead tables."""
    folder, tables = new_folder(spark, "feeds"), store.Store(spark, new_folder(spark, "store"))
    paths = generate.write_feeds(generate_leads(spark, sf), folder)
    now = batch.datetime.fromisoformat(X.BATCH_TS)
    batch.run(feeds.ingest(spark, paths), tables, mapping.starter_memory(spark), "generated", "b0", now)
    return A.batch_summary(tables.read("leads"), tables.read("duplicate_leads"), tables.read("invalid_leads"))


@register
def stream_ingest(spark, sf):
    """Two arrivals of submissions through the stream; the tables they leave."""
    arrivals, rows = new_folder(spark, "arrivals"), X.mapped(spark, sf)
    early = F.col("order_day") <= X.STORED_UNTIL
    tables, checkpoint = store.Store(spark, new_folder(spark, "store")), new_folder(spark, "stream")
    for part in (rows.filter(early), rows.filter(~early)):
        part.write.mode("append").parquet(arrivals)
        arriving = spark.readStream.schema(rows.schema).parquet(arrivals)
        stream = jobs.ingest_stream(arriving, tables, checkpoint, batch.datetime.fromisoformat(X.BATCH_TS))
        stream.trigger(availableNow=True).start().awaitTermination()
    return _resolved(dedup.Resolved(tables.read("leads"), tables.read("duplicate_leads")))


@register
def stream_feeds(spark, sf):
    """The landing page and upload feeds as streams of files, and what a batch over the same files leaves."""
    s = X.submissions(spark, sf)
    paths = {"landing_page": _written(spark, "landing", _landing_lines(s)), "csv_upload": _write_csv_feeds(spark, s)["csv_upload"]}
    now, left = batch.datetime.fromisoformat(X.BATCH_TS), []
    for name in ("stream", "batch"):
        tables, memory = store.Store(spark, new_folder(spark, name)), mapping.starter_memory(spark)
        for source, path in paths.items():
            if name == "batch":
                batch.run(feeds.ingest(spark, {source: path}), tables, memory, source, source, now, clock=_clock)
            else:
                headers = list(_UPLOAD.values()) if source == "csv_upload" else None
                job = jobs.ingest_feed(tables, source, path, memory, source, new_folder(spark, "at"), now, headers, clock=_clock)
                job.trigger(availableNow=True).start().awaitTermination()
        counts = [tables.read(t).groupBy("dataset_id").agg(F.count("*").alias(name)).withColumn("table", F.lit(t)) for t in ("leads", "duplicate_leads", "invalid_leads")]
        left.append(store.union_by_name(counts))
    return left[0].join(left[1], ["dataset_id", "table"], "full")


@register
def stream_kpis(spark, sf):
    leads = X.stored(spark, sf)
    arriving = spark.readStream.schema(store.SCHEMAS["leads"]).parquet(leads.path("leads"))
    path = new_folder(spark, "live")

    def replace(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    stream = jobs.live_counts(arriving).writeStream.outputMode("complete").foreachBatch(replace)
    stream.option("checkpointLocation", new_folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).withColumn("avg_score", F.round("avg_score", 6))
