import json

from pyspark.sql import functions as F

from leadq.operators import mapping
from leadq.sources import feeds, files, text


def raws(feed):
    return sorted((dict(r.raw) for r in feed.records.collect()), key=lambda d: json.dumps(d, sort_keys=True))


def payload(**fields):
    value = {"leadgen_id": "1", "form_id": "f", "page_id": "p", "created_time": 17, "field_data": [{"name": k, "values": v} for k, v in fields.items()]}
    return {"entry": [{"id": "1", "changes": [{"field": "leadgen", "value": value}, {"field": "other", "value": {}}]}]}


def put(tmp_path, name, content):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "f").write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(folder)


def test_webhook_shapes(spark, tmp_path):
    a, b = payload(email=["a@x.com", "z"], form_id=["over"]), payload(email=[])
    want = [
        {"leadgen_id": "1", "form_id": "f", "page_id": "p", "created_time": "17", "email": None},
        {"leadgen_id": "1", "form_id": "over", "page_id": "p", "created_time": "17", "email": "a@x.com"},
    ]
    shapes = {
        "lines": json.dumps(a) + "\n{broken\n\n" + json.dumps(b) + "\n",
        "array": json.dumps([a, 5, b]),
        "pretty": json.dumps([a, b], indent=2),
    }
    for name, body in shapes.items():
        feed = feeds.read_facebook(spark, put(tmp_path, name, body))
        assert raws(feed) == sorted(want, key=lambda d: json.dumps(d, sort_keys=True)), name
        assert feed.quarantine.count() == {"lines": 1, "array": 1, "pretty": 0}[name]
    assert raws(feeds.read_facebook(spark, put(tmp_path, "one", json.dumps(a, indent=1)))) == want[1:]
    for name, body in {"scalar": "17", "blank": " \n", "empty": "", "text": '"x"'}.items():
        assert raws(feeds.read_facebook(spark, put(tmp_path, name, body))) == []


def test_landing_page(spark, tmp_path):
    body = '{"fname": "Ada", "opt_in": true, "ts": 1700000000, "utm_campaign": 17, "x": null}\n5\n{"fname": "Bo"}\nnope\n'
    feed = feeds.read_landing_page(spark, put(tmp_path, "lp", body))
    first = next(r for r in feed.records.collect() if r.raw["fname"] == "Ada")
    assert dict(first.raw) == {"fname": "Ada", "opt_in": "true", "ts": "1700000000", "utm_campaign": "17", "x": None}
    assert sorted(first.not_text) == ["opt_in", "ts", "utm_campaign"]
    assert sorted((r.raw_data, r.error_message) for r in feed.quarantine.collect()) == [("5", "not an object"), ("nope", "malformed JSON")]


def test_csv(spark, tmp_path):
    body = 'Full Name,Work Email,Cell\n"Li, Ada",a@x.com,4155550100\nNone,N/A,"two\nlines"\nshort\na,b,c,d\n'
    feed = feeds.read_csv_upload(spark, put(tmp_path, "csv", body))
    got = sorted([tuple(r.raw.get(k) for k in ("Full Name", "Work Email", "Cell")) for r in feed.records.collect()], key=str)
    assert got == sorted([("Li, Ada", "a@x.com", "4155550100"), (None, None, "two\nlines"), ("short", None, None)], key=str)
    assert [r.error_message for r in feed.quarantine.collect()] == ["too many values"]
    assert feeds.read_csv_upload(spark, put(tmp_path, "none", "")).records.count() == 0


def test_decoding(spark, tmp_path):
    path = put(tmp_path, "bytes", b"\xef\xbb\xbfcaf\xe9")
    assert [r.text for r in text.read_files(spark, path).collect()] == ["caf�"]


def test_ingest_tags_records(spark, tmp_path):
    paths = {"landing_page": put(tmp_path, "a", '{"_source": "mine"}\n{"x": "1"}'), "csv_upload": put(tmp_path, "b", "h\nv\n")}
    got = sorted((r.source, r.raw["_source"]) for r in feeds.ingest(spark, paths).records.collect())
    assert got == [("csv_upload", "csv_upload"), ("landing_page", "landing_page"), ("landing_page", "mine")]


def test_file_names():
    assert files.safe_file_name("Q1 / leads: <new>") == "Q1  leads new.csv" and files.safe_file_name("///") == "dataset.csv"


HEADERS = {
    "form_id": "campaign_id", "created_time": "created_at", "full_name": "full_name", "phone_number": "phone_e164", "Full Name": "full_name",
    "E-mail": "email", "Date": "created_at", "ts": "created_at", "Ad ID": "campaign_id", "Opted In": "consent", "fname": "first_name",
    "mobile": "phone_e164", "email": "email", "consent": "consent", "Phone #": "phone_e164", "Your email address": "email",
    "email_addr": "email", "Work E-mail Address": "email", "Do you agree to be contacted?": "consent", "utm_source": "source",
    "leadgen_id": None, "page_id": None, "What's your name?": None, "Best number to reach you": None, "How did you hear about us?": None,
    "Contact Person": None, "Best Phone": None, "Company": None, "Opted In For Marketing?": None, "Work Email": None, "Cell": None,
}


def test_spelling_rules(spark):
    headers = spark.createDataFrame([("csv_upload", h) for h in HEADERS], "source string, field_name string")
    resolved = mapping.resolve_mapping(headers, spark.createDataFrame([], mapping.MEMORY))
    assert {r.field_name: r.canonical_field for r in resolved.collect()} == HEADERS


def test_memory_and_resolver(spark):
    headers = spark.createDataFrame([("s", h) for h in ("Company", "Cell", "Odd", "Weird")], "source string, field_name string")
    resolver = spark.createDataFrame([("s", "Company", None), ("s", "Cell", "phone_e164"), ("s", "Odd", "shoe_size")], "source string, field_name string, canonical_field string")
    now = F.lit("2024-01-01").cast("timestamp")
    first = mapping.resolve_mapping(headers, spark.createDataFrame([], mapping.MEMORY), resolver)
    memory = mapping.remember(spark.createDataFrame([], mapping.MEMORY), first, now)
    assert {r.field_name: r.canonical_field for r in memory.collect()} == {"Company": "__unknown__", "Cell": "phone_e164", "Odd": "__unknown__"}
    again = {r.field_name: (r.canonical_field, r.decided_by) for r in mapping.resolve_mapping(headers, memory).collect()}
    assert again == {"Company": (None, "memory"), "Cell": ("phone_e164", "memory"), "Odd": (None, "memory"), "Weird": (None, "none")}


def test_mapping_inline_and_joined_agree(spark):
    records = spark.createDataFrame(
        [("s", i, {"E1": f"a{i}", "E2": None if i % 2 else f"b{i}", "N": "x", "_in": "1"}, ["N"] if i == 3 else []) for i in range(8)],
        "source string, ord long, raw map<string,string>, not_text array<string>",
    )
    mapped = spark.createDataFrame([("s", "E1", "email"), ("s", "E2", "email"), ("s", "N", "first_name")], "source string, field_name string, canonical_field string")
    columns = ["ord", "email", "first_name", "consent", "raw_payload", "not_text"]
    for keep in (False, True):
        a = mapping.apply_mapping(records, mapped, keep_nulls=keep).select(*columns)
        b = mapping.apply_mapping(records, mapped, inline_limit=0, keep_nulls=keep).select(*columns)
        rows = sorted(a.collect())
        assert rows == sorted(b.collect())
        assert rows[1].email == (None if keep else "a1") and rows[2].email == "b2" and rows[3].not_text == ["first_name"]


def test_profiles(spark):
    records = spark.createDataFrame([("s", i, {"a": f"v{i}", "b": "" if i < 7 else "late", "_x": "1", "c": None}) for i in range(9)], "source string, ord long, raw map<string,string>")
    got = {r.field_name: r.samples for r in mapping.profile_fields(records).collect()}
    assert got == {"a": ["v0", "v1", "v2", "v3", "v4"], "b": ["late", "late"]}


def test_nearest_does_not_depend_on_chunks(spark):
    queries = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i % 5)]) for i in range(20)], "q int, vector array<double>")
    corpus = spark.createDataFrame([(f"c{i}", [float(i % 4), float(i % 7), 1.0]) for i in range(25)], "corpus_id string, vector array<double>")
    assert sorted(mapping.nearest(queries, corpus).collect()) == sorted(mapping.nearest(queries, corpus, chunk=4).collect())


def _files(tmp_path, **contents):
    for name, content in contents.items():
        (tmp_path / f"{name}.txt").write_text(content)
    return str(tmp_path)


def test_json_layout_goes_by_content_not_size(spark, tmp_path):
    import json

    def people(n):
        return [{"fname": f"n{i}", "email": f"p{i}@gmail.com", "pad": "x" * 250} for i in range(n)] + [17]

    for n in (30, 30_000):
        folder = tmp_path / str(n)
        folder.mkdir()
        (folder / "a.json").write_text(json.dumps(people(n), indent=1))
        feed = feeds.read_landing_page(spark, str(folder))
        assert feed.records.count() == n and feed.quarantine.count() == 1
    (tmp_path / "30" / "b.json").write_text('{"fname": "a"}\n\n{"fname": "b"}\n{"broken')
    (tmp_path / "30" / "c.json").write_text(' \n{"fname":\n"c"}')
    feed = feeds.read_landing_page(spark, str(tmp_path / "30"))
    assert feed.records.count() == 33 and feed.quarantine.count() == 2


def test_arrays_too_long_for_one_value(spark):
    from leadq.sources import text

    bodies = spark.createDataFrame([('[{"a": "1"}, 2, "x", {"b": [1, {"c": 2}]}]', True), ("[1]\n[2]", True), ('{"a": 1}', True)], "value string, whole boolean")
    items = text._long_arrays(bodies)
    assert sorted((r.value, r.problem) for r in items.collect()) == sorted([('{"a":"1"}', None), ("2", "not an object"), ("x", "not an object"), ('{"b":[1,{"c":2}]}', None)])


def test_csv_files_with_different_headers_in_one_folder(spark, tmp_path):
    folder = _files(
        tmp_path,
        a="Full Name,E-mail,Phone #\nAda Li,ada@x.com,201\n",
        b="Cell,Name,Mail\n202,Bo Ray,bo@x.com\n203,Cy Orr,cy@x.com,extra\n",
        c='Cell,Name,Mail\n204,"Di\nLow",di@x.com\n',
        d="﻿Cell,Name,Mail\n205,Ed Poe,ed@x.com\n",
    )
    feed = feeds.read_csv_upload(spark, folder)
    got = sorted((r.raw.get("Name") or r.raw.get("Full Name"), r.raw.get("Cell") or r.raw.get("Phone #")) for r in feed.records.collect())
    assert got == [("Ada Li", "201"), ("Bo Ray", "202"), ("Di\nLow", "204"), ("Ed Poe", "205")]
    assert feed.quarantine.count() == 1


def test_layout_of_json_files(spark, tmp_path):
    shapes = {
        '{"a": 1}\n{"a": 2}\n': True, '{"a": \n{"a": 1}\n{"a": 2}\n{"a": 3}\n': True, 'x\n{"a": 1}\n': True, '[\n{"a": 1}\n]\n': False,
        '[\n{"a": 1},\n{"a": 2}\n]': False, '{\n "a": 1\n}\n': False, '{"a":\n{"b": 1}\n}': False, "17\n": False, '\n\n[{"a": 1}]\n': True,
    }
    for i, (body, lines) in enumerate(shapes.items()):
        path = put(tmp_path, f"l{i}", body)
        assert [r.by_lines for r in text.by_lines(spark.read.text(path)).collect()] == [lines], body


def test_layout_is_told_from_the_leading_lines_alone(spark, tmp_path):
    good, bad = '{"a": 1}', '{"a": '
    files = {"first": [good] + [bad] * 300, "next": ["", " ", bad] + [good] * 5 + [bad] * 300, "late": [bad] * 9 + [good] * 300, "short": [bad, good], "blank": ["", " "]}
    for name, text_lines in files.items():
        (tmp_path / f"{name}.txt").write_text("\n".join(text_lines))
    lines = spark.read.text(str(tmp_path))
    name = lambda path: path.rsplit("/", 1)[1].removesuffix(".txt")
    assert {name(r["path"]): r["by_lines"] for r in text.by_lines(lines).collect()} == {"first": True, "next": True, "late": False, "short": True}
    assert {name(r["path"]): r["first"] for r in text.first_lines(lines).collect()} == {"first": good, "next": bad, "late": bad, "short": bad}
    assert text._leading(lines, 9).groupBy("path").count().agg({"count": "max"}).first()[0] < 30  # of 309 lines


def test_files_that_are_no_document_are_not_read_whole(spark, tmp_path):
    cut, good = '{"n": "}\\"{', '{"n": "]"}'
    files = {"cut": [cut, good] * 20, "document": ["[", good, ",", good, "]"], "nested": ["{", '"n": "[{\\"",', '"m": {', '"x": [1,', "2]}", "}"], "marked": [cut, "﻿" + good] * 20}
    for name, text_lines in files.items():
        (tmp_path / f"{name}.txt").write_text("\n".join(text_lines))
    bodies = text.read_bodies(spark, str(tmp_path)).collect()
    assert sum(not b["whole"] for b in bodies) == 40 and sum(b["whole"] for b in bodies) == 3
    auto, whole = feeds.read_landing_page(spark, str(tmp_path)), feeds.read_landing_page(spark, str(tmp_path), layout="document")
    for a, b in ((auto.records.select(F.to_json("raw")), whole.records.select(F.to_json("raw"))), (auto.quarantine, whole.quarantine)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []
