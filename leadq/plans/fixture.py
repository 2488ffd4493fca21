"""Lead tables derived from the benchmark tables, for the registered queries, tests and bench.

One order is one raw submission. The SQL runs unchanged on Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadq.operators.store import Store
from leadq.plans import batch
from leadq.session import new_folder, staged

BATCH_TS = "2024-01-01 00:00:00"

SUBMISSIONS_SQL = """
SELECT o_orderkey AS ord,
  CASE (o_orderkey % 11) % 5 WHEN 0 THEN 'facebook' WHEN 1 THEN 'instagram' WHEN 2 THEN 'google_form' WHEN 3 THEN 'landing_page' ELSE 'csv_upload' END AS source,
  CASE WHEN o_orderkey % 4 = 0 THEN 'd1' ELSE 'd2' END AS dataset_id,
  CASE o_orderkey % 19 WHEN 0 THEN NULL WHEN 1 THEN 'test' WHEN 2 THEN '!!!?' WHEN 3 THEN 'Ada Mae Li' ELSE concat('Fn', substring('abcdefghij', CAST(pid % 10 AS INT) + 1, 1)) END AS fname,
  CASE o_orderkey % 23 WHEN 0 THEN NULL WHEN 3 THEN NULL ELSE concat('Ln', substring('klmnopqrst', CAST(pid % 10 AS INT) + 1, 1)) END AS lname,
  CASE o_orderkey % 13 WHEN 0 THEN upper(em) WHEN 1 THEN concat('p', CAST(pid AS STRING), '@gmial.com') WHEN 2 THEN replace(em, '@', ' at ')
    WHEN 3 THEN concat('p', CAST(pid AS STRING)) WHEN 4 THEN concat('test', CAST(pid AS STRING), '@test.com') WHEN 5 THEN 'asdf@asdf'
    WHEN 6 THEN '' WHEN 7 THEN NULL WHEN 8 THEN concat('p', CAST(pid AS STRING), '@mailinator.com') ELSE em END AS email,
  CASE o_orderkey % 17 WHEN 0 THEN concat('+1 (', a, ') ', x, '-', l) WHEN 1 THEN concat(a, '-', x, '-', l) WHEN 2 THEN concat('1-', a, '-', x, '-', l)
    WHEN 3 THEN concat('(', a, ') ', x, '-', l) WHEN 4 THEN '12345' WHEN 5 THEN 'N/A' WHEN 6 THEN NULL ELSE concat(a, x, l) END AS phone,
  CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE concat('camp_', CAST(o_custkey % 40 AS STRING)) END AS campaign,
  CASE o_orderkey % 12 WHEN 0 THEN 'Yes' WHEN 1 THEN 'yes' WHEN 2 THEN 'Y' WHEN 3 THEN 'TRUE' WHEN 4 THEN 'I agree' WHEN 5 THEN 'true' WHEN 6 THEN 'No'
    WHEN 7 THEN 'I do not agree' WHEN 8 THEN '' WHEN 9 THEN NULL WHEN 10 THEN 'maybe later' ELSE 'opt in please' END AS consent,
  CASE o_orderkey % 4 WHEN 0 THEN concat(d, 'T00:00:00Z') WHEN 1 THEN concat(substring(d,6,2), '/', substring(d,9,2), '/', substring(d,1,4), ' 09:30 AM')
    WHEN 2 THEN concat(substring(d,9,2), '-', substring('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * (CAST(substring(d,6,2) AS INT) - 1) + 1, 3), '-', substring(d,1,4)) ELSE NULL END AS ts_raw,
  CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS campaign_is_number,
  CASE WHEN o_orderkey % 87 = 0 THEN 1 ELSE 0 END AS fname_is_number,
  d AS order_day
FROM (SELECT o_orderkey, o_custkey, pid, d,
        CASE WHEN pid % 3 = 0 THEN concat('p', CAST(pid AS STRING), '@gmail.com') WHEN pid % 3 = 1 THEN concat('p', CAST(pid AS STRING), '@yahoo.com')
             ELSE concat('p', CAST(pid AS STRING), '@corp', CAST(pid % 9 AS STRING), '.com') END AS em,
        CAST(201 + pp % 700 AS STRING) AS a, CASE WHEN pp % 7 = 0 THEN '555' ELSE CAST(200 + pp % 355 AS STRING) END AS x,
        lpad(CAST(pp % 10000 AS STRING), 4, '0') AS l
      FROM (SELECT o_orderkey, o_custkey, substring(CAST(CAST(o_orderdate AS DATE) AS STRING),1,10) AS d,
              CASE WHEN o_orderkey % 5 = 4 THEN o_custkey ELSE 1000000 + o_orderkey END AS pid,
              CASE WHEN o_orderkey % 5 = 4 OR o_orderkey % 7 = 3 THEN o_custkey ELSE 1000000 + o_orderkey END AS pp
            FROM {orders}) b) p
"""

# Rows up to this day are stored leads in the cross-batch queries, later ones are incoming.
STORED_UNTIL = "1995-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_submissions: dict[tuple[str, str], DataFrame] = {}


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All submissions, written once a session as files of many splits, as an intake folder would hold them: the orders are one
    row group, which one task would read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _submissions:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        rows = spark.sql(SUBMISSIONS_SQL, orders=orders.repartition(2 * spark.sparkContext.defaultParallelism, "o_orderkey"))
        _submissions[key] = staged(rows, "submissions", keep=True)
    return _submissions[key]


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions under canonical column names. A campaign or first name that came as a JSON
    number is named in `not_text`."""
    not_text = F.array_compact(
        F.array(
            F.when(F.col("fname_is_number") == 1, "first_name"),
            F.when(F.col("campaign_is_number") == 1, "campaign_id"),
        )
    )
    return submissions(spark, sf_dir).select(
        "ord",
        "source",
        "dataset_id",
        F.col("fname").alias("first_name"),
        F.col("lname").alias("last_name"),
        "email",
        F.col("phone").alias("phone_e164"),
        F.col("campaign").alias("campaign_id"),
        "consent",
        F.col("ts_raw").alias("created_at"),
        not_text.alias("not_text"),
        "order_day",
    )


def batch_ts():
    return batch.timestamp(BATCH_TS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid leads, scored; duplicates not yet resolved."""
    return batch.validate.split(batch.prepare(mapped(spark, sf_dir), batch_ts())).valid


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions as raw maps under the header spellings of their feed."""
    s = submissions(spark, sf_dir)
    c = F.col
    full = F.when(c("fname").isNotNull() | c("lname").isNotNull(), F.concat_ws(" ", "fname", "lname"))
    values = [full, c("fname"), c("lname"), c("email"), c("email"), c("phone"), c("consent"), c("campaign"), F.lit("landing_page"), c("ts_raw")]
    headers = {  # under which header each value stands, if it does
        "facebook": ["full_name", None, None, "email", None, "phone_number", "consent", "form_id", None, "created_time"],
        "instagram": ["Full Name", None, None, "E-mail", None, "Phone #", "Opted In", "Ad ID", None, "Date"],
        "google_form": [
            "What's your name?", None, None, "Your email address", None, "Best number to reach you",
            "Do you agree to be contacted?", "How did you hear about us?", None, "Timestamp",
        ],
        "landing_page": [None, "fname", "lname", "email_addr", None, "mobile", "opt_in", "utm_campaign", "utm_source", "ts"],
        "csv_upload": ["Full Name", None, None, "Work Email", "Email Address", "Cell", None, "Company", None, None],
    }
    names = F.create_map(*[x for s_, hs in headers.items() for x in (F.lit(s_), F.array(*[F.lit(h) for h in hs]))])
    cells = F.zip_with(names[c("source")], F.array(*values), lambda n, v: F.struct(n.alias("n"), v.alias("v")))
    raw = F.map_from_entries(F.filter(cells, lambda cell: cell["n"].isNotNull()))
    return s.select("ord", "source", "dataset_id", raw.alias("raw"))


def healing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a failure log."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("ord"),
        F.lit("csv_upload").alias("source"),
        F.lit(1).alias("attempt"),
        F.concat(F.initcap("event_type"), F.lit("Error")).alias("exception_type"),
        F.col("props").alias("message"),
        F.when(F.col("user_id") < 75, "d1").otherwise("d2").alias("dataset_id"),
    )


# Dispositions, datasets and runs as logs over the event table.

DISPOSITIONS_SQL = """
SELECT sha256_of_ord AS lead_id, disposition, decided_at, seq FROM (
  SELECT {lead_id} AS sha256_of_ord,
    CASE event_type WHEN 'click' THEN 'contacted' WHEN 'view' THEN 'follow_up' WHEN 'error' THEN 'not_interested'
      WHEN 'signup' THEN 'high_priority' ELSE 'called_back' END AS disposition,
    ts AS decided_at, event_id AS seq
  FROM (SELECT event_id, ts, event_type, CAST(floor(event_id / 2) AS BIGINT) AS ord FROM {events}) e) d
"""

_ORD_SOURCE = (
    "CASE (ord % 11) % 5 WHEN 0 THEN 'facebook' WHEN 1 THEN 'instagram' WHEN 2 THEN 'google_form' "
    "WHEN 3 THEN 'landing_page' ELSE 'csv_upload' END"
)
_ORD_KEY = f"concat(CASE WHEN ord % 4 = 0 THEN 'd1' ELSE 'd2' END, ':', {_ORD_SOURCE}, ':', CAST(ord AS STRING))"
SPARK_LEAD_ID = f"sha2({_ORD_KEY}, 256)"
DUCKDB_LEAD_ID = f"sha256({_ORD_KEY})"

DATASET_LOG_SQL = """
SELECT concat('ds-', CAST(user_id AS STRING)) AS dataset_id,
  CASE event_type WHEN 'signup' THEN concat('upload ', CAST(event_id AS STRING)) WHEN 'click' THEN '  ' END AS name,
  CASE event_type WHEN 'signup' THEN concat('file', CAST(event_id AS STRING), '.csv') END AS file_name,
  CASE event_type WHEN 'signup' THEN 'csv_upload' END AS source_kind,
  CASE event_type WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'completed' END AS status,
  CASE event_type WHEN 'view' THEN props END AS notes,
  CASE event_type WHEN 'error' THEN 'late' END AS tags,
  CASE event_type WHEN 'signup' THEN ts END AS created_at,
  CASE WHEN event_type = 'error' AND value > 150 THEN TRUE END AS deleted,
  ts AS logged_at
FROM {events}
"""

RUN_LOG_SQL = """
SELECT concat('run-', CAST(user_id AS STRING)) AS run_id,
  CASE event_type WHEN 'signup' THEN 'csv_upload' WHEN 'view' THEN 'facebook' END AS source,
  CASE event_type WHEN 'signup' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status,
  CASE event_type WHEN 'purchase' THEN event_id END AS total_records,
  CASE event_type WHEN 'purchase' THEN event_id - event_id % 7 END AS processed,
  CASE event_type WHEN 'purchase' THEN event_id % 7 END AS failed,
  CASE event_type WHEN 'signup' THEN ts END AS started_at,
  CASE event_type WHEN 'purchase' THEN ts END AS finished_at,
  ts AS logged_at
FROM {events}
"""


def disposition_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = DISPOSITIONS_SQL.replace("{lead_id}", SPARK_LEAD_ID)
    return spark.sql(sql, events=table(spark, sf_dir, "events"))


def _typed(df: DataFrame, schema) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    )


def dataset_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadq.operators.store import DATASET

    return _typed(spark.sql(DATASET_LOG_SQL, events=table(spark, sf_dir, "events")), DATASET)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadq.operators.store import RUN

    return _typed(spark.sql(RUN_LOG_SQL, events=table(spark, sf_dir, "events")), RUN)


_stores: dict[tuple[str, str], Store] = {}


def load(spark: SparkSession, sf_dir: str, root: str) -> Store:
    """Process all submissions and write the lead tables."""
    store = Store(spark, root)
    batch.write(batch.process(mapped(spark, sf_dir), batch_ts()), store, "b0")
    return store


def stored(spark: SparkSession, sf_dir: str) -> Store:
    """Lead tables of all submissions: written by the first query of a session that reads them,
    as an upload would, and read by the others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        _stores[key] = load(spark, sf_dir, new_folder(spark, "store"))
    return _stores[key]


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).read("leads")


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).read("duplicate_leads")


def invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).read("invalid_leads")


