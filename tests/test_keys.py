import re

import pytest
from pyspark.sql import functions as F

from leadq.operators import dedup, keys
from leadq.operators.positions import dense
from leadq.operators.store import Store
from leadq.plans import batch
from leadq.plans import fixture as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def halves(spark):
    leads = X.scored(spark, SF)
    split = F.col("order_day") > X.STORED_UNTIL
    done = batch.process(X.mapped(spark, SF).filter(~split), X.batch_ts())
    return leads.filter(split), done.leads


def filled(spark, tmp_path, leads, buckets=keys.BUCKETS):
    store = Store(spark, f"file:{tmp_path}/s{buckets}", buckets)
    store.append("leads", leads, "b0")
    return store


@pytest.mark.parametrize("scope", [dedup.DATASET, dedup.GLOBAL])
def test_index_answers_as_the_leads_do(spark, tmp_path, halves, scope):
    incoming, stored = halves
    want = sorted(map(tuple, dedup.stored_matches(incoming, stored, scope).collect()))
    assert want
    for buckets in (1, 16, 64):
        store = filled(spark, tmp_path / scope, stored, buckets)
        assert sorted(map(tuple, dedup.stored_matches(incoming, store.key_index(), scope).collect())) == want
    store.rebuild_key_index()
    assert sorted(map(tuple, dedup.stored_matches(incoming, store.key_index(), scope).collect())) == want


def test_lookup_opens_only_the_buckets_of_the_batch_and_no_leads(spark, tmp_path, halves):
    incoming, stored = halves
    index = filled(spark, tmp_path, stored).key_index("later", "d2")
    few = incoming.filter("email is not null and phone_e164 is null").limit(1)
    wanted = dedup.match_keys(few).select("key").distinct()
    known = keys.known_keys(few, wanted, index, dedup.DATASET)
    own = [f for f in known.inputFiles() if f"{tmp_path}/" in f]
    assert own and all("/lead_keys/" in f for f in own)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = known._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = next(f for f in re.findall(r"PartitionFilters: ([^\n]*?), PushedFilters", plan) if "bucket" in f)
    assert re.search(r"bucket#\d+ = \d+", filters) and "d2" in filters


def test_index_follows_its_batch(spark, tmp_path, halves):
    _, stored = halves
    store = filled(spark, tmp_path, stored)
    all_rows = lambda: sorted((r.kind, r.value, r.lead_id) for r in store.read("lead_keys").collect())
    assert all_rows() == sorted((r.kind, r.value, r.lead_id) for r in keys.index_rows(stored).collect())
    store.append("leads", stored.limit(3), "b1")
    store.append("leads", stored.filter("dataset_id = 'd1'"), "b0")
    assert store.read("lead_keys").filter("batch_id = 'b0' and dataset_id = 'd2'").isEmpty()
    assert not store.key_index("b0").rows.filter("batch_id = 'b0'").count()
    store.drop_partitions("d1")
    assert store.read("lead_keys").filter("dataset_id = 'd1'").isEmpty()
    store.clear(["leads"])
    assert store.read("lead_keys").isEmpty()


def test_positions_are_dense_and_the_same_again(spark, tmp_path):
    path = f"file:{tmp_path}/rows"
    spark.range(1000, numPartitions=7).withColumn("text", F.concat(F.lit("t"), "id")).write.parquet(path)
    rows = spark.read.parquet(path).filter("id < 300 or id > 720")  # some tasks are empty
    one, two = (sorted(map(tuple, dense(rows).select("ord", "id").collect())) for _ in range(2))
    assert one == two and [o for o, _ in one] == list(range(len(one))) and len(one) == 579
    assert dense(rows.filter("id < 0")).count() == 0


def test_positions_of_many_tasks(spark, monkeypatch):
    from leadq.operators import positions

    monkeypatch.setattr(positions, "MOST_BROADCAST", 2)
    assert sorted(r.ord for r in dense(spark.range(100, numPartitions=9).select("id")).collect()) == list(range(100))


def test_identifiers_are_rows_without_lists(spark):
    rows = [(1, "A@x.com", "+1415"), (2, None, "+1415"), (3, "", None), (4, "b@x.com", "")]
    df = spark.createDataFrame(rows, "ord long, email string, phone_e164 string")
    found = keys.identifiers(df, "ord")
    assert sorted(map(tuple, found.collect())) == [(1, "email", "a@x.com"), (1, "phone", "+1415"), (2, "phone", "+1415"), (4, "email", "b@x.com")]
    assert "array" not in found._jdf.queryExecution().optimizedPlan().toString()
