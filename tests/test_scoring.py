from pyspark.sql import functions as F

from leadq.functions import scoring as R
from leadq.operators import ranking, score

COLUMNS = "ord long, first_name string, last_name string, email string, phone_e164 string, source string, campaign_id string, consent boolean, created_at string"


def leads(spark, *rows):
    base = {"first_name": "Ada", "last_name": "Li", "email": "ada@corp.com", "phone_e164": "+14152340199", "source": "facebook",
            "campaign_id": "c1", "consent": True, "created_at": "2024-01-01 10:00:00"}
    data = [(i, *{**base, **r}.values()) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, COLUMNS).withColumn("created_at", F.col("created_at").cast("timestamp"))


def one(df, column):
    return [r[column] for r in df.orderBy("ord").collect()]


def test_worked_scores(spark):
    df = score.score(leads(spark, {}, {"email": "a@gmail.com"}, {"email": "a@gmail.com", "consent": False}, {"email": "a@mailinator.com"}))
    assert one(df, "quality_score") == [85.0, 77.0, 49.0, 30.0]


def test_placeholders(spark):
    emails = ["bartholomew@x.com", "nathaniel@x.com", "testimonials@x.com", "administrator@x.com", "test123@x.com", "admin007@x.com", "no-reply@x.com"]
    df = score.features(leads(spark, *[{"email": e} for e in emails]))
    assert one(df, "email_is_placeholder_like") == [0, 0, 0, 0, 1, 1, 1]
    phones = score.features(leads(spark, {"phone_e164": "+14155550199"}, {"phone_e164": "+14152340199"}, {"phone_e164": None}))
    assert one(phones, "phone_is_placeholder") == [1, 0, 0]


def test_flags(spark):
    df = score.flag(leads(spark, {"email": None, "phone_e164": None}, {"phone_e164": "+14155550199"}, {}, {"first_name": "asdf"}))
    assert one(df, "status") == ["flagged", "flagged", "clean", "flagged"]


def test_bands_round_half_even(spark):
    df = spark.createDataFrame([(69.88,), (69.5,), (68.5,), (39.4,), (None,)], "s double")
    got = [(r.b, r.n) for r in df.select(R.band_or_unscored(F.col("s")).alias("b"), R.shown_score(F.col("s")).alias("n")).collect()]
    assert got == [("High", 70), ("High", 70), ("Medium", 68), ("Low", 39), ("Unscored", None)]


def test_texts(spark):
    df = score.explain(score.score(leads(spark, {}, {"email": None, "phone_e164": None, "consent": False}, {"email": "test@x.com"})))
    good, unreachable, fake = df.orderBy("ord").collect()
    assert good.diagnosis == ("High-quality lead (score 85). Strengths: opted in to contact, non-personal email domain, "
                              "both email and phone captured, attributed to campaign 'c1'.")
    assert good.suggested_action.startswith("Contact within 24 hours")
    assert unreachable.suggested_action.startswith("Do not action yet")
    assert "no email or phone on file, no marketing consent captured" in unreachable.diagnosis
    assert fake.suggested_action.startswith("Verify before any outreach")


def test_stored_texts_come_with_their_signals_as_lists(spark):
    stored = score.finish(score.score(leads(spark, {}, {"email": None, "phone_e164": None, "consent": None, "campaign_id": ""}, {"first_name": None, "last_name": None})))
    stored = stored.withColumn("lead_id", F.concat(F.lit("L"), "ord"))
    good, bare, unnamed = ranking.explained(stored).orderBy("lead_id").collect()
    assert good.positive_signals == ["opted in to contact", "non-personal email domain", "both email and phone captured", "attributed to campaign 'c1'"]
    assert good.negative_signals == [] and bare.positive_signals == [] and unnamed.negative_signals == ["no name captured"]
    assert bare.negative_signals == ["no email or phone on file", "no marketing consent captured"]
    assert (good.quality_score, good.status, bare.status) == (85.0, "clean", "flagged")
    assert good.diagnosis == f"High-quality lead (score 85). Strengths: {', '.join(good.positive_signals)}."


def test_unscored(spark):
    df = score.explain(leads(spark, {"consent": False}).withColumn("quality_score", F.lit(None).cast("double")))
    row = df.collect()[0]
    assert row.diagnosis.startswith("Not yet scored.")
    assert row.suggested_action.endswith("email only with a lawful basis.")


def test_rescoring_keeps_duplicates(spark):
    old = leads(spark, {}, {}).withColumns({"quality_score": F.lit(1.0), "diagnosis": F.lit("x"), "suggested_action": F.lit("x")})
    old = old.withColumn("status", F.when(F.col("ord") == 0, "duplicate").otherwise("flagged"))
    new = score.rescore(old)
    assert one(new, "status") == ["duplicate", "clean"] and one(new, "quality_score") == [85.0, 85.0]


def test_model_goes_before_rules(spark):
    df = score.score(leads(spark, {}, {}), F.when(F.col("ord") == 0, 120.0))
    assert one(df, "quality_score") == [100.0, 85.0]


def test_kept_signals_give_the_same_texts_without_looking_at_the_fields_again(spark):
    rows = leads(spark, {}, {"email": None, "phone_e164": None, "consent": False}, {"email": "test@x.com"}, {"first_name": "asdf", "campaign_id": ""},
                 {"phone_e164": "+14155550199", "email": "a@mailinator.com"}, {"consent": None, "first_name": None, "last_name": None})
    kept, plain = score.finish(score.score(rows, keep=True)), score.finish(score.score(rows))
    assert kept.columns == plain.columns and kept.orderBy("ord").collect() == plain.orderBy("ord").collect()
    written = score.score(rows, keep=True).localCheckpoint()
    plan = score.finish(written)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "filter(" not in plan  # neither patterns nor lists
