from datetime import datetime

from pyspark.sql import functions as F

from leadq import generate, model
from leadq import schema as S
from leadq.operators import mapping
from leadq.operators.store import Store
from leadq.plans import batch
from leadq.plans import fixture as X
from leadq.sources import feeds

NOW = datetime(2024, 1, 1)


def test_generated_feeds_become_leads(spark, tmp_path):
    people = spark.range(300).select(F.col("id").alias("person_id"))
    rows = generate.submissions(people, NOW)
    again = generate.submissions(people.repartition(5), NOW)
    assert sorted(map(str, rows.collect())) == sorted(map(str, again.collect()))
    assert 350 < rows.count() < 400
    paths = generate.write_feeds(rows, f"file:{tmp_path}/feeds")
    tables = Store(spark, f"file:{tmp_path}/store")
    decisions = batch.run(feeds.ingest(spark, paths), tables, mapping.starter_memory(spark), "d", "b", NOW)
    found = {(r.source, r.field_name): r.canonical_field for r in decisions.collect()}
    assert found["instagram", "Phone #"] == "phone_e164" and found["google_form", "What's your name?"] == "full_name"
    landed = sum(tables.read(t).count() for t in ("leads", "duplicate_leads", "invalid_leads"))
    assert landed == rows.filter("NOT (is_empty AND source = 'facebook')").count()
    assert tables.read("duplicate_leads").count() > 20 and tables.read("quarantine").count() == 0
    assert tables.read("leads").filter("email IS NOT NULL").count() > 100
    # the same feed again under another batch: everything with an identifier is a repeat
    batch.run(feeds.ingest(spark, paths), tables, mapping.starter_memory(spark), "d", "b2", NOW)
    second = tables.read("leads").filter("batch_id = 'b2'")
    assert second.filter("email IS NOT NULL OR phone_e164 IS NOT NULL").count() == 0


def test_scorer_learns_the_rules(spark):
    leads = X.scored(spark, "/root/testdata/sf0.001").cache()
    trees, error = model.train(model.training_set(leads), rounds=8, step=0.2)
    assert error < 8
    predicted = model.predict(trees, leads)
    assert predicted.count() == leads.count() and "prediction" in predicted.columns


def test_trees_and_thresholds_come_from_all_rows(spark):
    """Three rows have a signal, and nothing else tells their label: a sample of the rows, or of the values of a feature, misses them."""
    rows, rare = spark.range(60_000).withColumnRenamed("id", "ord"), F.col("ord") % 15_000 == 5_003
    flat = {c: F.lit(0.0) for c in S.FEATURES} | {"created_hour": (F.col("ord") % 24).cast("double"), "phone_is_placeholder": rare.cast("double")}
    training = rows.select("ord", *[v.alias(c) for c, v in flat.items()], F.when(rare, 90.0).otherwise(10.0).alias("label"))
    trained, _ = model.hold_out(training)
    assert trained.count() > 40_000 and trained.filter(rare).count() == 3
    trees, _ = model.train(training, rounds=2, step=1.0)
    root = trees.trees[0]._call_java("rootNode").impurityStats()
    assert abs(root.count() - 0.8 * trained.count()) < 500  # of each round's rows, a fifth is left out
    assert trees.featureImportances[S.FEATURES.index("phone_is_placeholder")] > 0.9
