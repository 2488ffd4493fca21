import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadq.operators import analytics as A
from leadq.operators import datasets as D
from leadq.operators import ranking, store
from leadq.plans import batch

COLUMNS = "lead_id string, ord long, first_name string, last_name string, email string, source string, consent boolean, quality_score double, status string, dataset_id string"


def leads(spark, rows):
    base = {"lead_id": None, "ord": 0, "first_name": None, "last_name": None, "email": None, "source": "facebook", "consent": True,
            "quality_score": 50.0, "status": "clean", "dataset_id": "d1"}
    data = [tuple({**base, "lead_id": f"L{i}", "ord": i, **r}.values()) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, COLUMNS)
    return store.union_by_name([spark.createDataFrame([], store.SCHEMAS["leads"]), df])


def ids(df):
    return [r.lead_id for r in df.collect()]


def test_sources_and_buckets(spark):
    df = leads(spark, [{"quality_score": 80.0}, {"quality_score": 60.0}, {"quality_score": 40.0, "status": "flagged", "consent": False}, {"quality_score": 90.0, "source": "instagram"}])
    got = {r.source: r for r in A.by_source(df).collect()}
    fb = got["facebook"]
    assert (fb.total, fb.clean, fb.flagged, fb.sum_score, fb.consent, got["instagram"].total) == (3, 2, 1, 180.0, 2, 1)
    scores = leads(spark, [{"quality_score": s} for s in (5.0, 45.0, 85.0, 100.0)])
    assert sorted(r.bucket for r in A.score_buckets(scores).collect()) == [0, 4, 8, 10]


def test_pages(spark):
    df = leads(spark, [{"quality_score": float(s)} for s in range(90, 65, -1)])
    page = ranking.ranked_page(df, 10, 10).collect()
    assert page[0].quality_score == 80.0 and page[0].total == 25 and len(page) == 10
    assert len(ranking.ranked_page(df, 10, 20).collect()) == 5
    assert ranking.ranked_page(df, 10, min_score=85).collect()[0].total == 6
    after = ranking.ranked_page(df, 10, after=(81.0, 9)).collect()
    assert [r.lead_id for r in after] == [r.lead_id for r in page]


def test_search(spark):
    df = leads(spark, [{"first_name": "Grace"}, {"first_name": "Ada"}, {"email": "adam@x.com", "status": "flagged"}, {"last_name": "100%"}])
    assert ids(ranking.search(df, q=" ADA ")) == ["L2", "L1"]
    assert ids(ranking.search(df, q="ada", flagged=True)) == ["L2"]
    assert len(ids(ranking.search(df, q="%"))) == 4 and ids(ranking.search(df, q="%", literal=True)) == ["L3"]


def test_call_queue(spark):
    df = leads(spark, [{"quality_score": 90.0}, {"quality_score": 50.0}, {"quality_score": 70.0}])
    asked = spark.createDataFrame(
        [("L0", "follow_up", datetime(2024, 1, 1), 1), ("L0", "contacted", datetime(2024, 1, 2), 2), ("L1", "high_priority", datetime(2024, 1, 1), 3),
         ("L9", "contacted", datetime(2024, 1, 1), 4), ("L2", "lost", datetime(2024, 1, 1), 5)], store.DISPOSITION)
    empty = asked.filter("false")
    assert ids(ranking.call_list(df, empty)) == ["L0", "L2", "L1"]
    accepted, refused = store.record_dispositions(asked, df)
    assert ids(ranking.call_list(df, accepted)) == ["L1", "L2"]
    assert {(r.lead_id, r.reason) for r in refused.collect()} == {("L9", "unknown lead"), ("L2", "unknown status")}


def test_scorecard(spark):
    kept = leads(spark, [{"quality_score": 80.0}, {"quality_score": 60.0}])
    card = A.source_performance(kept, kept.limit(1), kept.limit(1)).collect()[0]
    assert (card.avg_score, card.junk_percentage, card.duplicates) == (70.0, 25.0, 1)


def test_stats_show_zero_average_as_null(spark):
    df = leads(spark, [{"quality_score": 0.0}])
    none = df.filter("false")
    row = A.stats(df, none, none, none, none).collect()[0]
    assert row.avg_quality_score is None and row.total_clean == 1


def test_failures(spark):
    invalid = spark.createDataFrame([('[{"loc":["a","b"],"msg":"m"},{"msg":"n"}]',), ('[{"loc":["a","b"],"msg":"m"}]',), ("broken",), (None,)], "errors string")
    assert [tuple(r) for r in A.top_failures(invalid).collect()] == [("a.b: m", 2), ("unknown field: n", 1)]


def test_store_replaces_a_repeated_batch(spark, tmp_path):
    tables = store.Store(spark, f"file:{tmp_path}/s")
    df = leads(spark, [{}, {"dataset_id": "d2"}]).drop("batch_id")
    assert tables.read("leads").count() == 0
    for name in ("b1", "b1", "b2"):
        tables.append("leads", df, name)
    assert tables.read("leads").count() == 4
    assert store.scoped(tables.read("leads"), "d2").count() == 2
    tables.drop_partitions("d2")
    assert {r.dataset_id for r in tables.read("leads").collect()} == {"d1"}
    assert tables.clear()["leads"] == "cleared" and tables.clear()["datasets"] == "absent" and tables.read("leads").count() == 0


def test_dataset_life(spark):
    def at(day):
        return F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")

    new = spark.createDataFrame([("d1", "one", "f.csv", "csv_upload"), ("d2", "two", None, "facebook")], "dataset_id string, name string, file_name string, source_kind string")
    log = D.open_rows(new, at(1))
    kept = leads(spark, [{"quality_score": 80.0}, {"quality_score": 61.0, "status": "flagged"}])
    log = log.unionByName(D.finish_rows(log, D.dataset_counts(kept, kept.filter("false"), kept.limit(1)), at(2)))
    state = {r.dataset_id: r for r in D.current_datasets(log).collect()}
    assert (state["d1"].status, state["d1"].total_leads, state["d1"].avg_score, state["d1"].invalid) == ("completed", 2, 70.5, 1)
    assert state["d1"].time_taken_ms == 86_400_000 and state["d2"].status == "processing"
    changes = spark.createDataFrame([("d1", " ", "hi", None), ("zz", "x", None, None)], "dataset_id string, name string, notes string, tags string")
    log = log.unionByName(D.update_rows(log, changes, at(3)))
    log = log.unionByName(D.delete_rows(log, spark.createDataFrame([("d2",), ("zz",)], "dataset_id string"), at(4)))
    state = {r.dataset_id: r for r in D.list_datasets(log).collect()}
    assert set(state) == {"d1"} and state["d1"].name == "Untitled dataset" and state["d1"].notes == "hi" and state["d1"].file_name == "f.csv"
    assert store.active(leads(spark, [{}, {"dataset_id": "d2"}]), log).count() == 1


def test_backfill(spark):
    old = leads(spark, [{"dataset_id": None}, {"dataset_id": None, "source": "google_form"}, {}])
    none = old.filter("false")
    made = {r.dataset_id: (r.name, r.total_leads) for r in D.backfill_datasets(old, none, none).collect()}
    assert made == {"backfill-facebook": ("Facebook feed (imported)", 1), "backfill-google_form": ("Google Form feed (imported)", 1)}
    assert D.backfilled(D.backfilled(old)).filter("dataset_id IS NULL").count() == 0


def test_batch_decisions():
    assert not D.keep_dataset(True, 0, False) and D.keep_dataset(True, 0, True) and D.keep_dataset(False, 0, False)
    assert [D.final_status(s) for s in ("ok", "error", "human_review")] == ["completed", "failed", "failed"]


def test_result_does_not_depend_on_partitioning(spark):
    from leadq.plans import fixture as X

    rows = X.mapped(spark, "/root/testdata/sf0.001")
    seen = set()
    for df in (rows, rows.repartition(7, "phone_e164")):
        out = batch.process(df, X.batch_ts())
        seen.add(tuple(sorted((r.lead_id, r.status) for r in out.leads.unionByName(out.duplicates).collect())))
    assert len(seen) == 1


def _log_rows(spark, r, times):
    """Rows of the log of datasets that set some columns and leave the others open, a time each."""
    rows = []
    for t in times:
        row = {f: None for f in store.DATASET.fieldNames()}
        row |= {"dataset_id": f"d{r.randrange(4)}", "logged_at": datetime(2024, 1, 1) + timedelta(seconds=t)}
        row |= {"name": r.choice([None, f"n{t}"]), "notes": r.choice([None, None, f"o{t}"]), "total_leads": r.choice([None, t])}
        rows.append(tuple((row | {"deleted": r.choice([None, None, t % 9 == 0])}).values()))
    return spark.createDataFrame(rows, store.DATASET)


@pytest.mark.parametrize("dies", [False, True])
def test_compacted_logs_keep_their_state(spark, tmp_path, monkeypatch, dies):
    r = random.Random(3)
    plain, compacted = (store.Store(spark, str(tmp_path / n)) for n in "ab")
    times = r.sample(range(36), 36)  # late rows arrive after a snapshot
    kept = compacted._fs
    for i in range(0, 36, 12):
        for half in (times[i : i + 6], times[i + 6 : i + 12]):
            rows = _log_rows(spark, r, half).coalesce(1)
            for s in (plain, compacted):
                s.append("datasets", rows)
        states = [sorted(map(str, D.current_datasets(s.read("datasets")).collect())) for s in (plain, compacted)]
        assert states[0] == states[1]
        if dies:  # after the snapshot, before anything is deleted
            real = compacted._fs
            monkeypatch.setattr(compacted, "_fs", lambda p: _undeletable(*real(p)))
            with pytest.raises(OSError):
                compacted.compact("datasets")
            monkeypatch.setattr(compacted, "_fs", kept)
        else:
            assert compacted.compact_logs(after=3) == [] and compacted.compact_logs(after=2) == ["datasets"]
            assert compacted._tail("datasets") == [] and len(compacted._snapshots("datasets")) == 1
        states = [sorted(map(str, D.current_datasets(s.read("datasets")).collect())) for s in (plain, compacted)]
        assert states[0] == states[1]
    if dies:
        compacted.compact("datasets")
        assert len(compacted._snapshots("datasets")) == 1 and compacted._tail("datasets") == []
    assert compacted.read("datasets").count() <= 4 * 5 < plain.read("datasets").count()
    compacted.clear(["datasets"])
    assert compacted.read("datasets").isEmpty()


class _undeletable:
    """A file system that lists and does not delete."""

    def __new__(cls, fs, path):
        self = super().__new__(cls)
        self.globStatus, self.exists = fs.globStatus, fs.exists
        return self, path

    def delete(self, path, recursive):
        raise OSError("lost")


def test_deciding_rows_of_whole_row_logs(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    s.append("dispositions", spark.createDataFrame([("L0", "contacted", t[0], 1), ("L0", "lost", t[1], 2), ("L1", "contacted", t[2], 3), ("L0", "contacted", t[1], 1)], store.DISPOSITION))
    s.append("mapping_memory", spark.createDataFrame([("a", "h", "email", "x", None), ("a", "h", "phone_e164", "x", t[0]), (None, "h", "email", "x", None), ("a", "h", "email", "y", t[0])], store.MEMORY))
    s.append("batches", spark.createDataFrame([("b", 0, 5, t[2]), ("b", 5, 12, t[0]), ("b", 0, 5, t[1])], store.BATCHES))
    assert set(s.compact_logs(after=1)) == {"dispositions", "mapping_memory", "batches"}
    assert {r.lead_id: r.disposition for r in store.current_dispositions(s.read("dispositions")).collect()} == {"L0": "lost", "L1": "contacted"}
    assert {(r.source, r.canonical_field) for r in s.read("mapping_memory").collect()} == {("a", "phone_e164"), (None, "email")}
    assert {(r.first_ord, r.next_ord, r.logged_at) for r in s.read("batches").collect()} == {(0, 5, t[2]), (5, 12, t[0])}
    assert s.read("dispositions").count() == 2


def test_rows_of_few_datasets_are_written_where_they_are(spark, tmp_path):
    rows = leads(spark, [{"dataset_id": f"d{i % 2}"} for i in range(40)]).repartition(5)
    for name, known, files in (("few", 2, 10), ("many", store.FEW_FOLDERS + 1, 2), ("unknown", None, 2)):
        tables = store.Store(spark, f"file:{tmp_path}/{name}")
        tables.append("leads", rows, "b", datasets=known)
        tables.append("leads", rows, "b", datasets=known)  # again: replaced
        assert sorted(ids(tables.read("leads"))) == sorted(ids(rows))
        assert len(list((tmp_path / name / "leads").glob("dataset_id=*/batch_id=b/part-*.parquet"))) == files
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_quarantined_rows_are_not_gathered_in_one_task(spark, tmp_path):
    bad = spark.range(0, 400, 1, 4).select(F.lit("facebook").alias("source"), F.col("id").cast("string").alias("raw_data"), F.lit("r").alias("reason"), F.lit("m").alias("error_message"), F.lit(0).alias("retries_used"))
    tables = store.Store(spark, f"file:{tmp_path}/bad")
    tables.append("quarantine", bad, "b")
    assert len(list((tmp_path / "bad" / "quarantine").glob("batch_id=b/part-*.parquet"))) == 4
    assert tables.read("quarantine").select(F.col("raw_data").cast("int").alias("x")).agg(F.sum("x")).first()[0] == 400 * 399 // 2
