import random

import pytest
from pyspark.sql import functions as F

from leadq.operators import dedup
from leadq.operators.graph import connected_components
from leadq.operators.keys import KEYS
from leadq.operators.skew import join_groups
from leadq.operators.validate import lead_id
from leadq.session import balanced

COLUMNS = "ord long, dataset_id string, email string, phone_e164 string, quality_score double"


def leads(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS)
    nothing = {c: F.lit(None).cast("string") for c in ("first_name", "last_name", "campaign_id")}
    return df.withColumns({**nothing, "lead_id": F.concat(F.lit("L"), "ord"), "created_at": F.lit("2024-01-01").cast("timestamp")})


def brute_force(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in range(n)}


def random_graph(seed, n, m):
    r = random.Random(seed)
    return {(min(a, b), max(a, b)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b}


GRAPHS = {
    "chain": (60, {(i, i + 1) for i in range(59)}),
    "shuffled chain": (40, {(min(a, b), max(a, b)) for a, b in zip(*[random.Random(3).sample(range(40), 40)[i:] for i in (0, 1)])}),
    "hub": (120, {(7, i) if i > 7 else (i, 7) for i in range(120) if i != 7}),
    "random": (80, random_graph(1, 80, 60)),
    "two hubs": (100, {(0, i) for i in range(2, 50)} | {(1, i) for i in range(45, 100)}),
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("heavy_rows", [5, 1_000_000])
def test_components_equal_brute_force(spark, name, heavy_rows):
    n, edges = GRAPHS[name]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(sorted(edges), "a long, b long"), heavy_rows).collect()}
    want = brute_force(n, edges)
    touched = {x for e in edges for x in e}
    assert got == {x: want[x] for x in touched}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_heavy_groups_join_like_any_other(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), ("none", 2)], "k string, v int")
    groups = spark.createDataFrame([("hot", 50, "h"), ("cold", 1, "c")], "k string, size int, w string")
    for heavy in (1, 10, 1000):
        got = join_groups(rows, groups, "k", "size", heavy)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(groups, "k").collect()))


def outcome(resolved):
    kept = {r.ord for r in resolved.kept.collect()}
    return kept, {r.ord: r.duplicate_of_lead_id for r in resolved.duplicates.collect()}


def test_exact_keys_only(spark):
    rows = [("d", "a@x.com", "+1", 1.0), ("d", "A@X.com", "+2", 1.0), ("d", "b@x.com", "+3", 1.0), ("d", "c@x.com", "+3", 2.0),
            ("d", None, None, 1.0), ("d", None, None, 1.0), ("d", "", "", 1.0)]
    kept, dups = outcome(dedup.deduplicate(leads(spark, rows)))
    assert kept == {0, 3, 4, 5, 6} and dups == {1: "L0", 2: "L3"}


def test_best_score_survives_and_links_are_transitive(spark):
    rows = [("d", "a@x.com", "+1", 10.0), ("d", "b@x.com", "+1", 90.0), ("d", "b@x.com", "+2", 50.0), ("d", "z@x.com", "+9", 1.0)]
    kept, dups = outcome(dedup.deduplicate(leads(spark, rows)))
    assert kept == {1, 3} and dups == {0: "L1", 2: "L1"}


def test_datasets_are_worlds_of_their_own(spark):
    rows = [("d1", "a@x.com", None, 1.0), ("d1", "a@x.com", None, 1.0), ("d2", "a@x.com", None, 1.0)]
    assert outcome(dedup.deduplicate(leads(spark, rows))) == ({0, 2}, {1: "L0"})
    assert outcome(dedup.deduplicate(leads(spark, rows), dedup.GLOBAL)) == ({0}, {1: "L0", 2: "L0"})


@pytest.mark.parametrize("heavy_rows", [3, 1_000_000])
def test_clusters_equal_brute_force_with_a_hot_key(spark, heavy_rows):
    r = random.Random(5)
    rows = []
    for i in range(150):
        email = "hot@x.com" if i % 3 == 0 else r.choice([None, f"e{r.randrange(60)}@x.com"])
        rows.append(("d", email, r.choice([None, f"+{r.randrange(70)}"]), float(r.randrange(5))))
    edges, first = set(), {}
    for i, (_, e, p, _s) in enumerate(rows):
        for key in (e, p):
            if key:
                edges.add((first.setdefault(key, i), i))
    want = brute_force(150, {e for e in edges if e[0] != e[1]})
    shared = {x for e in edges if e[0] != e[1] for x in e}
    frame = leads(spark, rows)
    for df in (frame, frame.repartition(7, "email").orderBy(F.rand(3))):
        got = {x.ord: x.component for x in dedup.components(df, heavy_rows=heavy_rows).collect()}
        assert got == {x: want[x] for x in shared}
    best = {}
    for x in shared:
        best.setdefault(want[x], []).append((-rows[x][3], -sum(v is not None for v in rows[x][1:3]), x))
    survivors = {x.ord: x.best_ord for x in dedup.survivors(frame, heavy_rows=heavy_rows).collect()}
    assert survivors == {x: min(best[want[x]])[2] for x in shared}


def test_stored_leads_win_and_email_goes_before_phone(spark):
    stored = leads(spark, [("d", "a@x.com", "+1", 1.0), ("d", "b@x.com", "+2", 1.0)])
    incoming = leads(spark, [("d", "a@x.com", "+2", 99.0), ("d", "n@x.com", "+2", 99.0), ("d", "n2@x.com", "+7", 99.0), ("e", "a@x.com", None, 9.0)])
    assert outcome(dedup.against_stored(incoming, stored)) == ({2, 3}, {0: "L0", 1: "L1"})
    assert outcome(dedup.against_stored(incoming, stored, dedup.GLOBAL)) == ({2}, {0: "L0", 1: "L1", 3: "L0"})
    keys = {(r.key, r.stored_lead_id) for r in dedup.existing_keys(incoming, stored).collect()}
    assert keys == {("email:d:a@x.com", "L0"), ("phone:d:+2", "L1")}


def test_an_index_without_rows_of_the_dataset_is_not_looked_up(spark, monkeypatch):
    def never(*_):
        raise AssertionError("nothing is stored that could match")

    monkeypatch.setattr(dedup.KeyIndex, "rows_for", never)
    found = leads(spark, [("d", "a@x.com", None, 1.0), ("d", "a@x.com", None, 2.0), ("d", "b@x.com", None, 1.0)])
    other = spark.createDataFrame([("email", "b@x.com", 9, "L9", "other", 0, "b")], KEYS)
    index = dedup.KeyIndex(other, dataset_id="d")
    assert [tuple(r) for r in dedup.decided(found, index).collect()] == [(0, "L1")]


def test_a_full_index_is_looked_up_in_every_dataset_of_the_scope(spark):
    found = leads(spark, [("d", "a@x.com", None, 1.0), ("d", "a@x.com", None, 2.0), ("d", "b@x.com", "+1", 1.0)])
    rows = [("email", "b@x.com", 9, "L9", "other", 0, "b"), ("phone", "+1", 8, "L8", "d", 0, "b")]
    rows = spark.createDataFrame(rows, KEYS).withColumn("bucket", F.pmod(F.xxhash64("kind", "value"), F.lit(16)).cast("int"))
    near = dedup.decided(found, dedup.KeyIndex(rows, dataset_id="d"))
    far = dedup.decided(found, dedup.KeyIndex(rows), scope=dedup.GLOBAL)
    assert sorted(map(tuple, near.collect())) == [(0, "L1"), (2, "L8")]
    assert sorted(map(tuple, far.collect())) == [(0, "L1"), (2, "L9")]


def test_ids_of_the_best_are_made_where_leads_have_none(spark):
    r = random.Random(5)
    people = [(r.choice(["d1", "d2"]), f"p{r.randrange(9)}@x.com", None, float(r.randrange(4))) for _ in range(60)]
    bare = leads(spark, people).drop("lead_id").withColumn("source", F.when(F.col("ord") % 2 == 0, "facebook").otherwise("instagram"))
    named = bare.withColumn("lead_id", lead_id(F.col("dataset_id"), F.col("source"), F.col("ord")))
    expected = sorted(map(tuple, dedup.survivors(named).collect()))
    assert len(expected) > 20 and sorted(map(tuple, dedup.survivors(bare).collect())) == expected


def test_balanced_stages(spark):
    """Inside, joins of small sides don't sort and stages have several tasks a core; settings are as before afterwards, after an error too."""
    names = ["spark.sql.files.minPartitionNum", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.coalescePartitions.minPartitionNum"]
    before = [spark.conf.get(n, None) for n in names]
    rows = spark.range(2000).withColumn("x", F.col("id") * 2).repartition(4)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        with pytest.raises(KeyError), balanced(spark, spark):
            assert int(spark.conf.get(names[0])) >= 2 * spark.sparkContext.defaultParallelism
            joined = rows.join(spark.range(0, 2000, 3).repartition(3), "id", "left")
            assert joined.count() == 2000
            joined.collect()
            plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert "ShuffledHashJoin" in plan and "Sort " not in plan
            raise KeyError
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert [spark.conf.get(n, None) for n in names] == before
