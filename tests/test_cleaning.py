from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadq import schema as S
from leadq.functions import cleaning as C
from leadq.functions.strings import WHITESPACE, lookup, strip
from leadq.operators import clean, validate


def values(df, column):
    return [r[column] for r in df.orderBy("i").collect()]


def frame(spark, items, name="v"):
    return spark.createDataFrame(list(enumerate(items)), f"i int, {name} string")


PHONES = {
    "(415) 555-0123": "+14155550123", "not a phone number": None, None: None, "+1 (415) 555 0123": "+14155550123",
    "1-415-555-0123": "+14155550123", "12345": None, "N/A": None, "555.1234": "+15551234", "000-000-0000": None,
    "Tel: 415-555-0123 ext. 12": "+14155550123", "1-800-FLOWERS": "+18003569377", "+44 20 7946 0958": "+442079460958",
    "011 44 20 7946 0958": "+442079460958", "": None, "  ": None, "+1 12345": None, "99999999999999999999": None,
}


def test_phone(spark):
    df = clean.clean_phone(frame(spark, PHONES, "phone_e164"))
    assert values(df, "phone_e164") == list(PHONES.values())


def test_phone_expression_equals_the_steps(spark):
    df = frame(spark, PHONES).withColumn("out", C.normalize_phone(F.col("v")))
    assert values(df, "out") == list(PHONES.values())


EMAILS = {
    "Ada.Lovelace@EXAMPLE.com": "ada.lovelace@example.com", "person@gmial.com": "person@gmail.com", "garbage": None,
    "a@b": None, "x@foo.test": None, " p1@corp.com ": "p1@corp.com", "a..b@c.com": None, "a@-b.com": None,
    "test at x.com": None, "asdf@asdf": None, "": None, None: None, "x@yahoo.co": "x@yahoo.com",
    "a" * 65 + "@corp.com": None, "ünï@exämple.com": "ünï@exämple.com",
}


def test_email(spark):
    assert values(clean.clean_email(frame(spark, EMAILS, "email")), "email") == list(EMAILS.values())


CONSENT = {
    None: False, "": False, "maybe later": False, "12345": False, "[]": False, "{}": False, "yes": True, "true": True,
    "I agree to be contacted": True, "no": False, "false": False, "I do not agree": False, "please unsubscribe me": False,
    "TRUE": True, "opt in please": True, "don't agree": False, "Disagree": False,
}


def test_consent(spark):
    df = frame(spark, CONSENT).withColumn("out", C.normalize_consent(F.col("v")))
    assert values(df, "out") == list(CONSENT.values())


TIMES = {
    "2024-01-02T03:04:05Z": datetime(2024, 1, 2, 3, 4, 5), "2024-01-02": datetime(2024, 1, 2),
    "01/15/2024 09:30 AM": datetime(2024, 1, 15, 9, 30), "1/2/2024 12:05 pm": datetime(2024, 1, 2, 12, 5),
    "25/12/2023": datetime(2023, 12, 25), "05-Mar-2021": datetime(2021, 3, 5), "1700000000": datetime(2023, 11, 14, 22, 13, 20),
    "March 5, 2021": datetime(2021, 3, 5), "2024-01-02T03:04:05+05:30": datetime(2024, 1, 1, 21, 34, 5), "2025": None,
    "12": None, "garbage": None, "13/13/2020": None, "2024-02-30": None, None: None, "12 Sept 2020 12:30 am": datetime(2020, 9, 12, 0, 30),
}


def test_timestamps(spark):
    df = clean.clean_timestamp(frame(spark, TIMES, "created_at"))
    assert values(df, "created_at") == list(TIMES.values())


def test_epoch_text_can_be_turned_off(spark):
    df = clean.clean_timestamp(frame(spark, ["1700000000"], "created_at"), epoch_text=False)
    assert values(df, "created_at") == [None]


def test_names(spark):
    rows = [
        ("Ada Mae Lovelace", None, None, "Ada", "Mae Lovelace"), ("Prince", None, None, "Prince", None),
        (None, "Ada Mae Li", None, "Ada", "Mae Li"), ("X Y", "Ada", None, "Ada", "Y"), (None, None, None, None, None),
        ("  ", "Ada", "Li", "Ada", "Li"), (None, "Ada", "", "Ada", None),  # blank is missing
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, full_name string, first_name string, last_name string")
    got = [(r.first_name, r.last_name) for r in clean.rescue_names(df).orderBy("i").collect()]
    assert got == [r[3:] for r in rows]


def test_name_letters(spark):
    names = {"A" * 5000: "A" * 100, "😀🔥✨": None, "Anne-Marie": "Anne-Marie", "O'Brien": "O'Brien", "李小龙": "李小龙", "!!!?": None,
             "😀A": None, "a1": None, "": None, None: None}
    df = frame(spark, names).withColumn("out", C.usable_name(F.col("v")))
    assert values(df, "out") == list(names.values())


def test_empty_record_is_still_a_lead(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    df = spark.createDataFrame([(1, "d", "facebook")], "ord long, dataset_id string, source string")
    row = validate.split(validate.validate(clean.clean_leads(df), now)).valid.collect()[0]
    assert row.consent is False and row.created_at == datetime(2024, 1, 1) and row.email is None


def test_rejects_only_what_has_no_place(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    df = spark.createDataFrame(
        [(1, "d", "facebook", ["campaign_id"], None), (2, "d", "carrier_pigeon", [], None), (3, "d", "facebook", [], "+0123"), (4, "d", "facebook", [], "+14155550123")],
        "ord long, dataset_id string, source string, not_text array<string>, phone_e164 string",
    )
    for c in ("first_name", "last_name", "email", "campaign_id"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumns({"consent": F.lit(None).cast("boolean"), "created_at": F.lit(None).cast("timestamp")})
    checked = validate.validate(df, now)
    types = {r.ord: [e.type for e in r.errors] for r in checked.collect()}
    assert types == {1: ["string_type"], 2: ["enum"], 3: ["string_pattern_mismatch"], 4: []}
    parts = validate.split(checked)
    assert parts.valid.count() == 1 and parts.invalid.count() == 3
    assert validate.valid_rate(checked).collect()[0].valid_rate == 0.25
    assert validate.valid_rate(checked.filter("false")).collect()[0].valid_rate == 0.0


def test_contract(spark):
    with pytest.raises(ValueError, match="consent"):
        clean.check_contract(spark.createDataFrame([], "first_name string, consent string"))


def test_fields_that_do_not_read_each_other_share_a_projection(spark):
    columns = ["first_name", "last_name", "full_name", "email", "phone_e164", "campaign_id", "consent", "created_at"]
    df = spark.range(3).select(*[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in columns])
    plan = clean.clean_leads(df)._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if line.lstrip("+-: ").startswith("Project [")]) <= 6


def test_strip_of_odd_ends(spark):
    texts = ["", " ", "a", "a b", " a", "a\t", "\u00a0a", "a\u3000", "\u3000", "é", "é ", "aé", "~", "!", "\x7f", "\x00a", "😀", "a\x1f"]
    assert values(frame(spark, texts).withColumn("out", strip(F.col("v"))), "out") == [x.strip(WHITESPACE) for x in texts]
    domains = ["gmial.com", "gmail.com", None, ""]
    assert values(frame(spark, domains).withColumn("out", lookup(S.EMAIL_DOMAIN_TYPOS, F.col("v"))), "out") == ["gmail.com", None, None, None]


def test_errors_are_an_empty_list_where_there_are_none(spark):
    df = spark.createDataFrame([("facebook", []), ("fax", ["first_name"]), (None, None)], "source string, not_text array<string>")
    got = [r.e for r in df.select(validate.errors_column(F.col("not_text"), cleaned=True).alias("e")).collect()]
    assert [e and [x.type for x in e] for e in got] == [[], ["string_type", "enum"], ["enum"]]
    plan = df.select(validate.errors_column(F.col("not_text"), cleaned=True).alias("e"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan.split("filter(")[0]  # the list is made for records with errors only
