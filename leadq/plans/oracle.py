"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Each step is a common table expression and a query names the steps it needs. The SQL shares the fixed value lists
(`leadq.schema`) and the fixture with the package; the rules around them are written out anew.
"""

from __future__ import annotations

from leadq import schema as S
from leadq.operators.mapping import FORM_HEADERS, SYNONYMS
from leadq.plans import fixture as X


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _case(column: str, mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {default} END"


EMAIL_REGEX = r"^[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$"


def _email(c: str) -> str:
    text = f"lower(trim({c}))"
    domain = f"split_part({text}, '@', 2)"
    fixed = _case(domain, S.EMAIL_DOMAIN_TYPOS, domain)
    return f"CASE WHEN regexp_matches({text}, '{EMAIL_REGEX}') THEN concat(split_part({text}, '@', 1), '@', {fixed}) END"


def _phone(c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return (
        f"CASE WHEN regexp_matches({c}, '[A-Za-z]') THEN NULL WHEN length({d}) = 11 AND {d} LIKE '1%' THEN concat('+', {d}) "
        f"WHEN length({d}) = 10 THEN concat('+1', {d}) END"
    )


def _timestamp(c: str) -> str:
    return (
        f"coalesce(try_strptime({c}, '%Y-%m-%dT%H:%M:%SZ'), try_strptime({c}, '%m/%d/%Y %I:%M %p'), "
        f"try_strptime({c}, '%d-%b-%Y'))"
    )


def _consent(c: str) -> str:
    t = f"lower(trim(coalesce({c}, '')))"
    no = " OR ".join(f"contains({t}, '{p.replace(chr(39), chr(39) * 2)}')" for p in S.CONSENT_NO_PHRASES)
    yes = " OR ".join(f"contains({t}, '{p}')" for p in S.CONSENT_YES_PHRASES)
    return (
        f"CASE WHEN {t} IN ({_list(S.CONSENT_YES)}) THEN TRUE WHEN {t} IN ({_list(S.CONSENT_NO)}) THEN FALSE "
        f"WHEN {no} THEN FALSE WHEN {yes} THEN TRUE ELSE FALSE END"
    )


def _usable(c: str) -> str:
    return (
        f"CASE WHEN 2 * length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g')) > length(regexp_replace({c}, '\\s', '', 'g')) "
        f"THEN substring({c}, 1, 100) END"
    )


def _placeholder_email(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '^({'|'.join(S.PLACEHOLDER_EMAIL_LOCALS)})[0-9]*@'), FALSE)"


def _placeholder_name(c: str) -> str:
    return f"coalesce(lower(trim({c})) IN ({_list(S.PLACEHOLDER_NAMES)}), FALSE)"


def _placeholder_phone(c: str) -> str:
    return f"coalesce({c} LIKE '+1%' AND length({c}) = 12 AND substring({c}, 6, 3) = '555', FALSE)"


_BAND = "CASE WHEN round_even({s}, 0) >= 70 THEN 'High' WHEN round_even({s}, 0) >= 40 THEN 'Medium' ELSE 'Low' END"


def band(s: str) -> str:
    return _BAND.format(s=s)


_SIGNALS = f"""
  coalesce(first_name, '') <> '' AS has_first_name, coalesce(last_name, '') <> '' AS has_last_name,
  coalesce(email, '') <> '' AS has_email, coalesce(phone_e164, '') <> '' AS has_phone,
  coalesce(campaign_id, '') <> '' AS has_campaign_id,
  coalesce(split_part(email, '@', -1) IN ({_list(S.FREE_EMAIL_DOMAINS)}), FALSE) AS is_free,
  coalesce(split_part(email, '@', -1) IN ({_list(S.DISPOSABLE_EMAIL_DOMAINS)}), FALSE) AS is_disposable,
  {_placeholder_email('email')} AS ph_email,
  ({_placeholder_name('first_name')} OR {_placeholder_name('last_name')}) AS ph_name,
  {_placeholder_phone('phone_e164')} AS ph_phone"""

_W = S.SCORE_WEIGHTS
_SCORE = (
    "CAST(greatest(0, least(100, "
    + " + ".join(
        f"CASE WHEN {column} THEN {_W[name]} ELSE 0 END"
        for column, name in [
            ("has_first_name", "has_first_name"), ("has_last_name", "has_last_name"), ("has_email", "has_email"),
            ("has_phone", "has_phone"), ("has_campaign_id", "has_campaign_id"), ("consent", "consent"),
            ("is_free", "email_is_free_provider"), ("is_disposable", "email_is_disposable"),
            ("ph_email", "email_is_placeholder_like"), ("ph_name", "name_is_placeholder_like"),
            ("ph_phone", "phone_is_placeholder"),
        ]
    )
    + ")) AS DOUBLE)"
)

_STRENGTHS = """list_filter([
    CASE WHEN consent THEN 'opted in to contact' END,
    CASE WHEN has_email AND NOT is_free AND NOT is_disposable AND NOT ph_email THEN 'non-personal email domain' END,
    CASE WHEN has_email AND has_phone THEN 'both email and phone captured' END,
    CASE WHEN has_campaign_id THEN concat('attributed to campaign ''', campaign_id, '''') END], lambda x: x IS NOT NULL)"""
_CONCERNS = """list_filter([
    CASE WHEN NOT has_email AND NOT has_phone THEN 'no email or phone on file' END,
    CASE WHEN NOT consent THEN 'no marketing consent captured' END,
    CASE WHEN is_disposable THEN 'disposable/throwaway email domain' END,
    CASE WHEN ph_email THEN 'placeholder-looking email (e.g. test@)' END,
    CASE WHEN ph_name THEN 'placeholder or keyboard-mash name' END,
    CASE WHEN ph_phone THEN 'unverifiable 555 phone number' END,
    CASE WHEN is_free THEN 'personal (free) email, not a company domain' END,
    CASE WHEN NOT has_first_name AND NOT has_last_name THEN 'no name captured' END], lambda x: x IS NOT NULL)"""

_ACTION = f"""CASE WHEN NOT has_email AND NOT has_phone THEN
    'Do not action yet -- no email or phone captured. Check the source form for a broken or unmapped contact field.'
  WHEN is_disposable OR ph_email OR ph_name THEN
    'Verify before any outreach -- the email or name looks fake or test-generated. Confirm this is a real person before a rep spends time on it.'
  ELSE concat(CASE {band('quality_score')} WHEN 'High' THEN 'Contact within 24 hours -- high-quality, prioritize for a rep.'
    WHEN 'Medium' THEN 'Add to an email nurture sequence; escalate to a rep if they engage.'
    ELSE 'Deprioritize -- low quality, not worth rep time right now.' END,
    CASE WHEN consent THEN '' ELSE ' No consent on file: do not cold-call (TCPA), email only with a lawful basis.' END) END"""

_STEPS = {
    "sub": X.SUBMISSIONS_SQL.replace("{orders}", "orders"),
    "cleaned": f"""SELECT ord, source, dataset_id, order_day,
        CASE WHEN lname IS NULL AND contains(fname, ' ') THEN split_part(fname, ' ', 1) ELSE fname END AS first_name,
        CASE WHEN lname IS NULL AND contains(fname, ' ') THEN substring(fname, strpos(fname, ' ') + 1) ELSE lname END AS last_name,
        {_email('email')} AS email, {_phone('phone')} AS phone_e164, campaign AS campaign_id,
        {_consent('consent')} AS consent, {_timestamp('ts_raw')} AS created_at, campaign_is_number, fname_is_number
      FROM sub""",
    "validated": f"""SELECT ord, source, dataset_id, order_day, {X.DUCKDB_LEAD_ID} AS lead_id,
        {_usable('first_name')} AS first_name, {_usable('last_name')} AS last_name, email, phone_e164, campaign_id, consent,
        coalesce(created_at, TIMESTAMP '{X.BATCH_TS}') AS created_at, campaign_is_number, fname_is_number,
        campaign_is_number = 0 AND fname_is_number = 0 AS is_valid
      FROM cleaned""",
    "signals": f"SELECT *, {_SIGNALS} FROM validated",
    "scored": f"SELECT *, {_SCORE} AS quality_score FROM signals WHERE is_valid",
    "explained": f"""SELECT *, array_to_string(positive_signals, ', ') AS good, array_to_string(negative_signals, ', ') AS bad,
        concat_ws(' ', concat({band('quality_score')}, '-quality lead (score ', CAST(CAST(round_even(quality_score, 0) AS INT) AS STRING), ').'),
          CASE WHEN len(positive_signals) > 0 THEN concat('Strengths: ', array_to_string(positive_signals, ', '), '.') END,
          CASE WHEN len(negative_signals) > 0 THEN concat('Concerns: ', array_to_string(negative_signals, ', '), '.') END,
          CASE WHEN len(positive_signals) = 0 AND len(negative_signals) = 0
            THEN 'No standout signals either way -- an ordinary, complete lead.' END) AS diagnosis,
        {_ACTION} AS suggested_action,
        CASE WHEN is_disposable OR ph_email OR ph_name OR ph_phone OR (NOT has_email AND NOT has_phone) THEN 'flagged' ELSE 'clean' END AS flag_status
      FROM (SELECT *, {_STRENGTHS} AS positive_signals, {_CONCERNS} AS negative_signals FROM scored) s""",
    # identifiers, scoped to the dataset
    "keyed": """SELECT ord, concat('email:', dataset_id, ':', email) AS key FROM explained WHERE email IS NOT NULL
      UNION ALL SELECT ord, concat('phone:', dataset_id, ':', phone_e164) FROM explained WHERE phone_e164 IS NOT NULL""",
    "edges": """SELECT ord, first_ord FROM (SELECT ord, min(ord) OVER (PARTITION BY key) AS first_ord, count(*) OVER (PARTITION BY key) AS n
      FROM keyed) k WHERE n > 1""",
    "links": "SELECT ord AS a, first_ord AS b FROM edges WHERE ord <> first_ord UNION SELECT first_ord, ord FROM edges WHERE ord <> first_ord",
    "reach": """SELECT DISTINCT ord AS a, ord AS b FROM edges UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a""",
    "components": "SELECT a AS ord, min(b) AS component FROM reach GROUP BY a",
    "ranked": """SELECT e.ord, c.component, e.lead_id, row_number() OVER (PARTITION BY c.component ORDER BY quality_score DESC,
        (CASE WHEN has_first_name THEN 1 ELSE 0 END + CASE WHEN has_last_name THEN 1 ELSE 0 END + CASE WHEN has_email THEN 1 ELSE 0 END
         + CASE WHEN has_phone THEN 1 ELSE 0 END + CASE WHEN has_campaign_id THEN 1 ELSE 0 END) DESC, created_at DESC, e.ord) AS rn
      FROM explained e JOIN components c ON e.ord = c.ord""",
    "survivors": """SELECT r.ord, r.component, b.ord AS best_ord, b.lead_id AS best_lead_id
      FROM ranked r JOIN ranked b ON r.component = b.component AND b.rn = 1""",
    "resolved": """SELECT e.*, CASE WHEN s.ord IS NULL OR s.ord = s.best_ord THEN e.flag_status ELSE 'duplicate' END AS status,
        CASE WHEN s.ord <> s.best_ord THEN s.best_lead_id END AS duplicate_of_lead_id
      FROM explained e LEFT JOIN survivors s ON e.ord = s.ord""",
    "leads": "SELECT * FROM resolved WHERE status <> 'duplicate'",
    "dups": "SELECT * FROM resolved WHERE status = 'duplicate'",
    "invalid": """SELECT ord, source, dataset_id, campaign_is_number, fname_is_number FROM validated WHERE NOT is_valid""",
    "outcomes": """SELECT source, dataset_id, status AS outcome, quality_score FROM leads
      UNION ALL SELECT source, dataset_id, 'duplicate', NULL FROM dups
      UNION ALL SELECT source, dataset_id, 'invalid', NULL FROM invalid""",
}

_ORDER = list(_STEPS)


def query(final: str, upto: str, extra: dict[str, str] | None = None) -> str:
    """`final` over all steps up to and including `upto`, plus extra steps after them."""
    names = _ORDER[: _ORDER.index(upto) + 1]
    steps = [f"{n} AS ({_STEPS[n]})" for n in names] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return "WITH RECURSIVE " + ",\n".join(steps) + "\n" + final


_VIEW = (
    "ord, lead_id, first_name, last_name, email, phone_e164, source, campaign_id, consent, "
    "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, quality_score, status, duplicate_of_lead_id, diagnosis, suggested_action"
)
_N = "CAST(count(*) AS BIGINT)"


def _n(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"


def _avg(digits: int, c: str = "quality_score") -> str:
    return f"CAST(round_even(avg({c}), {digits}) AS DOUBLE)"


def _pct(part: str, whole: str, digits: int = 1, how: str = "round_even") -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({how}(100.0 * {part} / {whole}, {digits}) AS DOUBLE) ELSE 0.0 END"


_METRICS = f"""{_N} AS total, {_n("status = 'clean'")} AS clean, {_n("status = 'flagged'")} AS flagged,
  CAST(count(quality_score) AS BIGINT) AS scored, CAST(coalesce(sum(quality_score), 0) AS DOUBLE) AS sum_score,
  {_n('has_email')} AS email, {_n('has_phone')} AS phone, {_n('consent')} AS consent, {_n('has_campaign_id')} AS campaign,
  {_n('has_first_name')} AS name"""

# --- feeds and mapping -------------------------------------------------------------------

_FULL = "CASE WHEN fname IS NOT NULL OR lname IS NOT NULL THEN concat_ws(' ', fname, lname) END"
RAW_FIELDS = {
    "facebook": {"full_name": _FULL, "email": "email", "phone_number": "phone", "consent": "consent", "form_id": "campaign", "created_time": "ts_raw"},
    "instagram": {"Full Name": _FULL, "E-mail": "email", "Phone #": "phone", "Date": "ts_raw", "Ad ID": "campaign", "Opted In": "consent"},
    "google_form": {
        "Timestamp": "ts_raw", "What's your name?": _FULL, "Your email address": "email", "Best number to reach you": "phone",
        "Do you agree to be contacted?": "consent", "How did you hear about us?": "campaign",
    },
    "landing_page": {
        "fname": "fname", "lname": "lname", "email_addr": "email", "mobile": "phone", "opt_in": "consent", "utm_campaign": "campaign",
        "utm_source": "'landing_page'", "ts": "ts_raw",
    },
    "csv_upload": {"Full Name": _FULL, "Work Email": "email", "Email Address": "email", "Cell": "phone", "Company": "campaign"},
}
DECISIONS = {
    "facebook": {"full_name": "full_name", "email": "email", "phone_number": "phone_e164", "consent": "consent", "form_id": "campaign_id", "created_time": "created_at"},
    "instagram": {"Full Name": "full_name", "E-mail": "email", "Phone #": "phone_e164", "Date": "created_at", "Ad ID": "campaign_id", "Opted In": "consent"},
    "google_form": FORM_HEADERS,
    "landing_page": {
        "fname": "first_name", "lname": "last_name", "email_addr": "email", "mobile": "phone_e164", "opt_in": "consent",
        "utm_campaign": "campaign_id", "utm_source": "source", "ts": "created_at",
    },
    "csv_upload": {"Full Name": "full_name", "Work Email": None, "Email Address": "email", "Cell": None, "Company": None},
}


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


_CELLS = " UNION ALL ".join(
    f"SELECT ord, source, {_text(f)} AS field_name, {c} AS value FROM sub WHERE source = '{s}'"
    for s, fields in RAW_FIELDS.items()
    for f, c in fields.items()
)
_HEADERS = "SELECT DISTINCT source, field_name FROM cells"


def _normalized(c: str) -> str:
    return f"translate(lower(trim({c})), '_-', '  ')"


def _mapped(target: str) -> str:
    arms = []
    for source, fields in RAW_FIELDS.items():
        names = [f for f in fields if DECISIONS[source][f] == target]
        if names:
            arms.append(f"WHEN '{source}' THEN {fields[names[-1]]}")
    return f"CASE source {' '.join(arms)} END" if arms else "CAST(NULL AS VARCHAR)"


_NA = _list(S.NA_TOKENS)
_FEED_CELL = "CASE WHEN source IN ('instagram', 'google_form', 'csv_upload') AND {c} IN (" + _NA + ") THEN NULL ELSE {c} END"


def _feed(c: str) -> str:
    return _FEED_CELL.format(c=c)


# --- cross-batch -------------------------------------------------------------------------

_HALVES = {
    # every half (stored, incoming) is resolved on its own first
    "hkeyed": f"""SELECT ord, concat(k, ':', dataset_id, ':', v) AS key, order_day > '{X.STORED_UNTIL}' AS late FROM (
        SELECT ord, dataset_id, order_day, 'email' AS k, email AS v FROM explained WHERE email IS NOT NULL
        UNION ALL SELECT ord, dataset_id, order_day, 'phone', phone_e164 FROM explained WHERE phone_e164 IS NOT NULL) x""",
    "hedges": """SELECT ord, first_ord FROM (SELECT ord, min(ord) OVER (PARTITION BY key, late) AS first_ord,
        count(*) OVER (PARTITION BY key, late) AS n FROM hkeyed) k WHERE n > 1""",
    "hlinks": "SELECT ord AS a, first_ord AS b FROM hedges WHERE ord <> first_ord UNION SELECT first_ord, ord FROM hedges WHERE ord <> first_ord",
    "hreach": "SELECT DISTINCT ord AS a, ord AS b FROM hedges UNION SELECT hreach.a, hlinks.b FROM hreach JOIN hlinks ON hreach.b = hlinks.a",
    "hcomponents": "SELECT a AS ord, min(b) AS component FROM hreach GROUP BY a",
    "hranked": _STEPS["ranked"].replace("components c", "hcomponents c"),
    "hresolved": """SELECT e.*, r.rn, b.lead_id AS best_lead_id FROM explained e LEFT JOIN hranked r ON e.ord = r.ord
        LEFT JOIN hranked b ON r.component = b.component AND b.rn = 1""",
    "hkept": "SELECT * FROM hresolved WHERE rn IS NULL OR rn = 1",
    "hstored": f"SELECT k.key, min_by(h.lead_id, h.ord) AS lead_id FROM hkeyed k JOIN hkept h ON k.ord = h.ord WHERE h.order_day <= '{X.STORED_UNTIL}' GROUP BY k.key",
    "hmatch": f"""SELECT h.ord, min_by(s.lead_id, k.key) AS lead_id FROM hkept h JOIN hkeyed k ON h.ord = k.ord JOIN hstored s ON k.key = s.key
        WHERE h.order_day > '{X.STORED_UNTIL}' GROUP BY h.ord""",
    "halves": """SELECT h.ord, h.lead_id, h.dataset_id, h.order_day, CASE WHEN h.rn > 1 OR m.ord IS NOT NULL THEN 'duplicate' ELSE h.flag_status END AS status,
        CASE WHEN h.rn > 1 THEN h.best_lead_id ELSE m.lead_id END AS duplicate_of_lead_id
        FROM hresolved h LEFT JOIN hmatch m ON h.ord = m.ord""",
}
_GLOBAL = {
    "gkeyed": """SELECT ord, lead_id, order_day, concat('email:', email) AS key FROM scored WHERE email IS NOT NULL
        UNION ALL SELECT ord, lead_id, order_day, concat('phone:', phone_e164) FROM scored WHERE phone_e164 IS NOT NULL""",
    "gstored": f"SELECT key, min_by(lead_id, ord) AS lead_id FROM gkeyed WHERE order_day <= '{X.STORED_UNTIL}' GROUP BY key",
}

# --- logs --------------------------------------------------------------------------------

_DISPOSITIONS = {
    "requests": X.DISPOSITIONS_SQL.replace("{lead_id}", X.DUCKDB_LEAD_ID).replace("{events}", "events"),
    "accepted": f"SELECT * FROM requests WHERE disposition IN ({_list(S.CALL_STATUSES)}) AND lead_id IN (SELECT lead_id FROM leads)",
    "current": "SELECT lead_id, max_by(disposition, decided_at) AS disposition FROM accepted GROUP BY lead_id",
}


def _fold(columns: list[str], key: str, log: str) -> str:
    folded = ", ".join(f"max_by({c}, logged_at) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in columns)
    return f"SELECT {key}, {folded} FROM {log} GROUP BY {key}"


_DS_COLUMNS = ["name", "file_name", "source_kind", "status", "notes", "tags", "created_at", "deleted"]
_DS_LOG = {"log": X.DATASET_LOG_SQL.replace("{events}", "events")}
_DS_STATE = {"state": _fold(_DS_COLUMNS, "dataset_id", "log") }
_DS_SHOWN = (
    "dataset_id, name, file_name, source_kind, status, notes, tags, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"
)


def _with(steps: dict[str, str], final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in steps.items()) + "\n" + final


_BUCKET = "floor(quality_score / 10)"


def _bands(bands: list[tuple[str, int, int]], name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{label}' AS {name}, {_n(f'b BETWEEN {lo} AND {hi} AND status <> {chr(39)}flagged{chr(39)}')} AS clean, "
        f"{_n(f'b BETWEEN {lo} AND {hi} AND status = {chr(39)}flagged{chr(39)}')} AS flagged FROM bucketed"
        for label, lo, hi in bands
    )


_BUCKETED = {"bucketed": f"SELECT status, {_BUCKET} AS b FROM leads"}
_ERRORS = {
    "errors": """SELECT 'campaign_id: Input should be a valid string' AS reason FROM invalid WHERE campaign_is_number = 1
      UNION ALL SELECT 'first_name: Input should be a valid string' FROM invalid WHERE fname_is_number = 1"""
}
_CARD = {
    "card": f"""SELECT source, {_n("outcome IN ('clean', 'flagged')")} AS leads, {_n("outcome = 'clean'")} AS clean,
      {_n("outcome = 'flagged'")} AS flagged, {_n("outcome = 'invalid'")} AS invalid, {_n("outcome = 'duplicate'")} AS duplicates,
      {_avg(1)} AS avg_score, {_pct("count(*) FILTER (WHERE outcome = 'invalid')", "count(*)")} AS junk_percentage
      FROM outcomes GROUP BY source"""
}
_NOISE = """sqrt(-2 * ln((CAST(concat('0x', substring(md5(concat('a', CAST(ord AS STRING))), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0))
  * cos((CAST(concat('0x', substring(md5(concat('b', CAST(ord AS STRING))), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0 * 2 * 3.141592653589793)"""
_FEATURES = ", ".join(
    f"CAST({c} AS DOUBLE) AS {n}"
    for c, n in [
        ("has_first_name", "has_first_name"), ("has_last_name", "has_last_name"), ("has_email", "has_email"), ("has_phone", "has_phone"),
        ("has_campaign_id", "has_campaign_id"), ("consent", "consent"), ("is_free", "email_is_free_provider"),
        ("is_disposable", "email_is_disposable"), ("ph_email", "email_is_placeholder_like"), ("ph_name", "name_is_placeholder_like"),
        ("ph_phone", "phone_is_placeholder"), ("extract('hour' FROM created_at)", "created_hour"),
    ]
    + [(f"source = '{s}'", f"source_{s}") for s in S.SOURCES]
)
_TS = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"


def sql() -> dict[str, str]:
    from leadq.operators.analytics import BUTTERFLY, FIVE_BUCKETS

    q = query
    out = {
        # cleaning
        "split_full_name": q(f"""SELECT ord, CASE WHEN n IS NOT NULL THEN split_part(n, ' ', 1) END AS first_name,
            CASE WHEN contains(n, ' ') THEN substring(n, strpos(n, ' ') + 1) END AS last_name
            FROM (SELECT ord, nullif(trim({_FULL}), '') AS n FROM sub) x""", "sub"),
        "name_rescue": q("""SELECT ord, coalesce(fname, 'Pat') AS first_name, coalesce(lname, 'Doe Roe') AS last_name FROM sub""", "sub"),
        "normalize_phone": q(f"SELECT ord, phone, {_phone('phone')} AS phone_e164 FROM sub", "sub"),
        "normalize_email": q(f"SELECT ord, {_email('email')} AS email FROM sub", "sub"),
        "email_typo_fix": q(f"""SELECT ord, lower(trim(email)) AS email, {_email('email')} AS fixed FROM sub
            WHERE regexp_matches(lower(trim(email)), '{EMAIL_REGEX}')""", "sub"),
        "parse_datetime": q(f"SELECT ord, ts_raw, strftime({_timestamp('ts_raw')}, '%Y-%m-%d %H:%M:%S') AS created_at FROM sub", "sub"),
        "normalize_consent": q(f"SELECT ord, consent AS raw_consent, {_consent('consent')} AS consent FROM sub", "sub"),
        "clean_leads": q(f"SELECT ord, source, first_name, last_name, email, phone_e164, campaign_id, consent, {_TS} FROM cleaned", "cleaned"),
        "contract_check": q("""SELECT 'consent is set' AS check_name, CAST(count(*) FILTER (WHERE consent IS NULL) AS BIGINT) AS broken_rows FROM cleaned
            UNION ALL SELECT 'email is lower case', CAST(count(*) FILTER (WHERE email <> lower(email)) AS BIGINT) FROM cleaned
            UNION ALL SELECT 'phone is E.164', CAST(count(*) FILTER (WHERE NOT regexp_matches(phone_e164, '^\\+[1-9][0-9]{6,14}$')) AS BIGINT) FROM cleaned""", "cleaned"),
        # validation
        "name_letters": q(f"SELECT ord, fname, {_usable('fname')} AS usable FROM sub", "sub"),
        "validate_split": q("""SELECT ord, lead_id, is_valid, concat_ws('; ', CASE WHEN fname_is_number = 1 THEN 'first_name: string_type' END,
            CASE WHEN campaign_is_number = 1 THEN 'campaign_id: string_type' END) AS errors FROM validated""", "validated"),
        "valid_rate": q(f"SELECT round(avg(CASE WHEN is_valid THEN 1.0 ELSE 0.0 END), 9) AS valid_rate, {_N} AS records FROM validated", "validated"),
        # scoring
        "build_features": q(f"SELECT ord, {_FEATURES} FROM scored", "scored"),
        "email_domain_class": q("""SELECT ord, email, CASE WHEN NOT has_email THEN 'none' WHEN is_free THEN 'free' WHEN is_disposable THEN 'disposable'
            ELSE 'other' END AS email_class FROM scored""", "scored"),
        "placeholder_email": q("SELECT ord, email, ph_email AS is_placeholder FROM scored", "scored"),
        "placeholder_name": q(f"SELECT ord, {_placeholder_name('fname')} AS first_is_placeholder, {_placeholder_name('lname')} AS last_is_placeholder FROM sub", "sub"),
        "placeholder_phone": q("SELECT ord, phone_e164, ph_phone AS is_placeholder FROM scored", "scored"),
        "rule_score": q("SELECT ord, quality_score AS score FROM scored", "scored"),
        "score_batch": q("SELECT lead_id, quality_score FROM scored", "scored"),
        "score_band": q(f"SELECT ord, {band('quality_score')} AS band, CAST(round_even(quality_score, 0) AS INT) AS shown FROM scored", "scored"),
        "explain_signals": q("SELECT ord, array_to_string(positive_signals, ' | ') AS positive_signals, array_to_string(negative_signals, ' | ') AS negative_signals FROM explained", "explained"),
        "diagnose": q("SELECT ord, diagnosis FROM explained", "explained"),
        "suggest_action": q("SELECT ord, suggested_action FROM explained", "explained"),
        "flag_leads": q("SELECT ord, flag_status AS status FROM explained", "explained"),
        "lead_explain": q("""SELECT lead_id, array_to_string(positive_signals, ' | ') AS positive_signals,
            array_to_string(negative_signals, ' | ') AS negative_signals, diagnosis, suggested_action, quality_score, status FROM leads""", "leads"),
        "rescore": q("SELECT lead_id, quality_score, status, diagnosis, suggested_action FROM resolved", "resolved"),
        "training_set": q(f"""SELECT ord, {_FEATURES}, round(greatest(0.0, least(100.0, quality_score + 1.5 * ({_NOISE}))), 6) AS label FROM scored""", "scored"),
        # entity resolution
        "match_edges": q("SELECT ord, first_ord FROM edges", "edges"),
        "connected_components": q("SELECT ord, component FROM components", "components"),
        "survivor": q("SELECT ord, component, best_ord, best_lead_id FROM survivors", "survivors"),
        "deduplicate": q("""SELECT ord, lead_id, CASE WHEN status = 'duplicate' THEN 'duplicate' ELSE 'clean' END AS status, duplicate_of_lead_id
            FROM resolved""", "resolved"),
        "existing_keys": q(f"""SELECT g.key, g.lead_id AS stored_lead_id FROM gstored g
            WHERE g.key IN (SELECT key FROM gkeyed WHERE order_day > '{X.STORED_UNTIL}')""", "scored", _GLOBAL),
        "cross_batch_dedup": q(f"""SELECT s.ord, s.lead_id, CASE WHEN m.ord IS NULL THEN 'clean' ELSE 'duplicate' END AS status,
            m.lead_id AS duplicate_of_lead_id FROM scored s LEFT JOIN (SELECT k.ord, min_by(g.lead_id, k.key) AS lead_id
              FROM gkeyed k JOIN gstored g ON k.key = g.key WHERE k.order_day > '{X.STORED_UNTIL}' GROUP BY k.ord) m ON s.ord = m.ord
            WHERE s.order_day > '{X.STORED_UNTIL}'""", "scored", _GLOBAL),
        "dataset_scoped_dedup": q(f"SELECT ord, lead_id, status, duplicate_of_lead_id FROM halves WHERE order_day > '{X.STORED_UNTIL}'", "explained", _HALVES),
        "stream_ingest": q("SELECT ord, lead_id, dataset_id, status, duplicate_of_lead_id FROM halves", "explained", _HALVES),
        # lists
        "top_leads": q(f"SELECT {_VIEW} FROM leads ORDER BY quality_score DESC, ord LIMIT 8", "leads"),
        "ranked_page": q(f"""SELECT {_VIEW}, CAST((SELECT count(*) FROM leads WHERE quality_score BETWEEN 40 AND 69) AS BIGINT) AS total FROM leads
            WHERE quality_score BETWEEN 40 AND 69 ORDER BY quality_score DESC, leads.ord LIMIT 10 OFFSET 20""", "leads"),
        "search_leads": q(f"""SELECT {_VIEW}, CAST((SELECT count(*) FROM leads WHERE lower(first_name) LIKE '%ada%' OR lower(last_name) LIKE '%ada%'
            OR lower(email) LIKE '%ada%') AS BIGINT) AS total FROM leads
            WHERE lower(first_name) LIKE '%ada%' OR lower(last_name) LIKE '%ada%' OR lower(email) LIKE '%ada%' ORDER BY leads.ord DESC LIMIT 200""", "leads"),
        "call_list": q(f"""SELECT {_VIEW}, disposition FROM (SELECT l.*, c.disposition FROM leads l LEFT JOIN current c ON l.lead_id = c.lead_id) x
            WHERE disposition IS NULL OR disposition NOT IN ({_list(S.CALL_LIST_HIDDEN)})
            ORDER BY CASE WHEN disposition = 'high_priority' THEN 0 ELSE 1 END, quality_score DESC, ord LIMIT 20""", "leads", _DISPOSITIONS),
        "set_disposition": q("""SELECT r.seq, r.lead_id, r.disposition, CASE WHEN r.disposition = 'called_back' THEN 'unknown status'
            WHEN l.lead_id IS NULL THEN 'unknown lead' ELSE 'accepted' END AS outcome FROM requests r LEFT JOIN leads l ON r.lead_id = l.lead_id""", "leads", _DISPOSITIONS),
        "filter_leads": q("SELECT lead_id, source, status, quality_score FROM leads WHERE source IN ('facebook', 'csv_upload') AND status IN ('clean', 'flagged') AND quality_score BETWEEN 40 AND 80", "leads"),
        "preset_filters": q(f"""SELECT 'quality:high' AS preset, {_n("status = 'clean' AND quality_score >= 70")} AS leads FROM leads
            UNION ALL SELECT 'quality:suspicious', {_n("status = 'flagged'")} FROM leads UNION ALL SELECT 'range:all', {_N} FROM leads
            UNION ALL SELECT 'range:high', {_n('quality_score BETWEEN 70 AND 100')} FROM leads
            UNION ALL SELECT 'range:medium', {_n('quality_score BETWEEN 40 AND 69')} FROM leads
            UNION ALL SELECT 'range:low', {_n('quality_score BETWEEN 0 AND 39')} FROM leads""", "leads"),
        "export_filtered": q("SELECT lead_id, source, status, quality_score FROM leads WHERE source IN ('facebook', 'csv_upload') AND status IN ('clean', 'flagged') AND quality_score BETWEEN 40 AND 80", "leads"),
        "preview_without_consent": q("SELECT ord, first_name, last_name, email, source, quality_score, status FROM leads WHERE NOT consent ORDER BY ord LIMIT 25", "leads"),
        "preview_invalid": q("SELECT ord, source, dataset_id FROM invalid ORDER BY ord DESC LIMIT 25", "invalid"),
        "raw_payload": q("SELECT ord, email, email AS work_email, phone AS cell FROM sub WHERE source = 'csv_upload'", "sub"),
        "scored_completeness": q("""SELECT source, signal, CAST(round(100.0 * n / total, 0) AS BIGINT) AS pct FROM
            (SELECT source, count(*) AS total, count(email) AS email, count(phone_e164) AS phone, count(campaign_id) AS campaign, count(first_name) AS name, count(*) FILTER (WHERE consent) AS consent
             FROM leads WHERE quality_score IS NOT NULL GROUP BY source) t,
            LATERAL (VALUES ('email', email), ('phone', phone), ('consent', consent), ('campaign', campaign), ('name', name)) v(signal, n)""", "leads"),
        "recent_rows": q("SELECT ord, lead_id, duplicate_of_lead_id FROM dups ORDER BY ord DESC LIMIT 25", "dups"),
        "export_csv": q("SELECT lead_id, email, phone_e164, quality_score, status FROM leads WHERE dataset_id = 'd1'", "leads"),
        # aggregates
        "analytics_by_source": q(f"SELECT source, {_METRICS} FROM leads GROUP BY source", "leads"),
        "score_buckets": q(f"SELECT source, status, CAST({_BUCKET} AS BIGINT) AS bucket, {_N} AS leads FROM leads GROUP BY ALL", "leads"),
        "invalid_by_source": q(f"SELECT source, {_N} AS rows FROM invalid GROUP BY source", "invalid"),
        "duplicate_by_source": q(f"SELECT source, {_N} AS rows FROM dups GROUP BY source", "dups"),
        "stats": q(f"""SELECT {_n("outcome = 'clean'")} AS total_clean, {_n("outcome = 'flagged'")} AS total_flagged, {_n("outcome = 'invalid'")} AS total_invalid,
            {_n("outcome = 'duplicate'")} AS total_duplicates, nullif({_avg(2)}, 0) AS avg_quality_score,
            CAST((SELECT count(*) FROM events) AS BIGINT) AS self_healing_events, CAST(0 AS BIGINT) AS human_review_pending FROM outcomes""", "outcomes"),
        "source_performance": q("SELECT * FROM card", "outcomes", _CARD),
        "best_worst_source": q("""SELECT (SELECT source FROM card ORDER BY avg_score DESC, source LIMIT 1) AS best_source, max(avg_score) AS best_avg_score,
            (SELECT source FROM card ORDER BY junk_percentage DESC, avg_score DESC, source LIMIT 1) AS worst_source, max(junk_percentage) AS worst_junk_percentage FROM card""", "outcomes", _CARD),
        "metrics_rollup": q(f"SELECT coalesce(source, 'All sources') AS source, {_METRICS} FROM leads GROUP BY ROLLUP (source)", "leads"),
        "kpis": q(f"""SELECT {_N} AS total, {_n("status = 'clean'")} AS clean, {_n("status = 'flagged'")} AS flagged,
            CAST(round(sum(quality_score) / count(quality_score), 0) AS BIGINT) AS avg,
            {_pct('count(*) FILTER (WHERE quality_score >= 70)', 'count(quality_score)', 1, 'round')} AS high_pct, CAST(count(quality_score) AS BIGINT) AS scored FROM leads""", "leads"),
        "band_butterfly": q(_bands(BUTTERFLY, "band"), "leads", _BUCKETED),
        "score_histogram5": q(_bands(FIVE_BUCKETS, "bucket"), "leads", _BUCKETED),
        "score_histogram20": q(f"SELECT CAST(floor(quality_score / 5) * 5 AS BIGINT) AS bin_start, status, {_N} AS leads FROM leads GROUP BY ALL", "leads"),
        "avg_by_source": q(f"SELECT source, {_avg(1)} AS avg_score FROM leads GROUP BY source", "leads"),
        "quality_funnel": q(f"""SELECT band, leads, {_pct('leads', 'scored', 1, 'round')} AS pct_of_scored,
            CASE WHEN of_high > 0 THEN CAST(round(100.0 * leads / of_high, 0) AS DOUBLE) ELSE 100.0 END AS pct_of_high
            FROM (SELECT CAST(count(quality_score) AS BIGINT) AS scored, {_n('b BETWEEN 7 AND 10')} AS of_high, {_n('b BETWEEN 4 AND 6')} AS m, {_n('b BETWEEN 0 AND 3')} AS l
              FROM (SELECT quality_score, {_BUCKET} AS b FROM leads) x) t,
            LATERAL (VALUES ('high', of_high), ('medium', m), ('low', l)) v(band, leads)""", "leads"),
        "signal_completeness": q(f"""SELECT source, signal, CAST(round(100.0 * n / total, 0) AS BIGINT) AS pct FROM
            (SELECT source, {_METRICS} FROM leads GROUP BY source ORDER BY total DESC, source LIMIT 3) t,
            LATERAL (VALUES ('email', email), ('phone', phone), ('consent', consent), ('campaign', campaign), ('name', name)) v(signal, n)""", "leads"),
        "top_failures": q(f"SELECT reason, {_N} AS rows FROM errors GROUP BY reason ORDER BY rows DESC, reason LIMIT 8", "invalid", _ERRORS),
        "compliance_gaps": q(f"""SELECT 'no marketing consent' AS gap, {_n('NOT consent')} AS leads, {_pct('count(*) FILTER (WHERE NOT consent)', 'count(*)')} AS pct FROM leads
            UNION ALL SELECT 'no campaign tag', {_n('NOT has_campaign_id')}, {_pct('count(*) FILTER (WHERE NOT has_campaign_id)', 'count(*)')} FROM leads""", "leads"),
        "outcome_split": q(f"""SELECT outcome, {_N} AS rows, {_pct('count(*)', '(SELECT count(*) FROM outcomes)')} AS pct FROM outcomes GROUP BY outcome""", "outcomes"),
        "overview_totals": q(f"SELECT {_N} AS processed, CAST(count(DISTINCT source) FILTER (WHERE outcome IN ('clean', 'flagged')) AS BIGINT) AS connected_sources FROM outcomes", "outcomes"),
        "filtered_kpis": q(f"""SELECT {_N} AS scored, {_n('quality_score >= 70')} AS high, {_n('quality_score < 40')} AS low,
            {_pct('count(*) FILTER (WHERE quality_score >= 70)', 'count(*)')} AS high_pct, {_pct('count(*) FILTER (WHERE quality_score < 40)', 'count(*)')} AS low_pct,
            {_pct('count(*) FILTER (WHERE consent)', 'count(*)')} AS consent_pct, {_avg(1)} AS avg_score
            FROM leads WHERE source IN ('facebook', 'instagram', 'landing_page')""", "leads"),
        "band_counts": q(f"SELECT {band('quality_score')} AS band, {_N} AS leads FROM leads GROUP BY ALL", "leads"),
        "failure_types": f"SELECT concat(upper(substring(event_type, 1, 1)), substring(event_type, 2), 'Error') AS exception_type, {_N} AS events FROM events GROUP BY ALL",
        "batch_summary": q(f"""SELECT dataset_id, {_n("outcome IN ('clean', 'flagged')")} AS scored, {_n("outcome = 'duplicate'")} AS duplicates,
            {_n("outcome = 'invalid'")} AS invalid FROM outcomes GROUP BY dataset_id""", "outcomes"),
        "stream_kpis": q(f"SELECT source, {_N} AS total, {_n("status = 'flagged'")} AS flagged, {_n('consent')} AS consented, round(avg(quality_score), 6) AS avg_score FROM leads GROUP BY source", "leads"),
        # datasets and runs
        "dataset_summary": q(f"""SELECT dataset_id, {_n("outcome IN ('clean', 'flagged')")} AS total_leads, {_n("outcome = 'clean'")} AS clean, {_n("outcome = 'flagged'")} AS flagged,
            {_n("outcome = 'invalid'")} AS invalid, {_n("outcome = 'duplicate'")} AS duplicates, {_avg(1)} AS avg_score FROM outcomes GROUP BY dataset_id""", "outcomes"),
        "dataset_scope": q(f"SELECT source, {_METRICS} FROM leads WHERE dataset_id = 'd2' GROUP BY source", "leads"),
        "backfill_datasets": q(f"""SELECT concat('backfill-', source) AS dataset_id, {_n("outcome IN ('clean', 'flagged')")} AS total_leads, {_n("outcome = 'clean'")} AS clean,
            {_n("outcome = 'flagged'")} AS flagged, {_n("outcome = 'invalid'")} AS invalid, {_n("outcome = 'duplicate'")} AS duplicates, {_avg(1)} AS avg_score,
            source AS source_kind, 'completed' AS status,
            concat({_case('source', {'facebook': 'Facebook', 'instagram': 'Instagram', 'google_form': 'Google Form', 'landing_page': 'Landing Page'}, "'Csv Upload'")}, ' feed (imported)') AS name
            FROM outcomes GROUP BY source""", "outcomes"),
        "list_datasets": _with({**_DS_LOG, **_DS_STATE}, f"SELECT {_DS_SHOWN} FROM state WHERE deleted IS NULL ORDER BY state.created_at DESC, dataset_id LIMIT 100"),
        "update_dataset": _with({**_DS_LOG, **_DS_STATE}, """SELECT dataset_id, 'Untitled dataset' AS name, file_name, status, concat('seen ', dataset_id) AS notes, tags
            FROM state WHERE deleted IS NULL"""),
        "delete_dataset": _with({**_DS_LOG, **_DS_STATE}, "SELECT concat('ds-', CAST(user_id AS STRING)) AS dataset_id, event_id FROM events WHERE concat('ds-', CAST(user_id AS STRING)) IN (SELECT dataset_id FROM state WHERE deleted IS NULL)"),
        "run_history": _with({"log": X.RUN_LOG_SQL.replace("{events}", "events"),
            "state": _fold(["source", "status", "total_records", "processed", "failed", "started_at", "finished_at"], "run_id", "log")},
            """SELECT run_id, source, status, CAST(total_records AS BIGINT) AS total_records, CAST(processed AS BIGINT) AS processed, CAST(failed AS BIGINT) AS failed,
            CAST(floor((epoch_us(finished_at) - epoch_us(started_at)) / 1000.0) AS BIGINT) AS time_taken_ms FROM state ORDER BY started_at DESC, run_id LIMIT 20"""),
        "pretty_source": q(f"""SELECT DISTINCT source, {_case('source', {'facebook': 'Facebook', 'instagram': 'Instagram', 'google_form': 'Google Form', 'landing_page': 'Landing Page'}, "'CSV Upload'")} AS shown,
            concat({_case('source', {'facebook': 'Facebook', 'instagram': 'Instagram', 'google_form': 'Google Form', 'landing_page': 'Landing Page'}, "'Csv Upload'")}, ' import') AS import_name FROM sub""", "sub"),
        "lead_name": q("SELECT ord, coalesce(nullif(concat_ws(' ', fname, lname), ''), '(no name)') AS name FROM sub", "sub"),
        # sources
        "na_tokens": q(f"SELECT ord, CASE WHEN phone NOT IN ({_NA}) THEN phone END AS phone, CASE WHEN email NOT IN ({_NA}) THEN email END AS email FROM sub", "sub"),
        "decode_bom": "SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS chars FROM documents",
        "scan_facebook": q(f"SELECT CAST(ord AS STRING) AS leadgen_id, campaign AS form_id, {_FULL} AS full_name, email, phone AS phone_number, consent, ts_raw AS created_time FROM sub WHERE source = 'facebook'", "sub"),
        "scan_landing_page": q("""SELECT CASE WHEN fname_is_number = 1 THEN CAST(ord AS STRING) ELSE fname END AS fname, lname, email AS email_addr, phone AS mobile, consent AS opt_in,
            CASE WHEN campaign_is_number = 1 THEN CAST(ord AS STRING) ELSE campaign END AS utm_campaign, ts_raw AS ts,
            concat_ws(',', CASE WHEN fname_is_number = 1 THEN 'fname' END, CASE WHEN campaign_is_number = 1 THEN 'utm_campaign' END) AS not_text
            FROM sub WHERE source = 'landing_page'""", "sub"),
        "scan_csv": q(f"""SELECT source, {_feed(_FULL)} AS name, {_feed('email')} AS email, {_feed('phone')} AS phone, {_feed('consent')} AS consent, {_feed('ts_raw')} AS ts
            FROM sub WHERE source IN ('instagram', 'google_form', 'csv_upload')""", "sub"),
        "scan_csv_folder": q(f"""SELECT {_feed(_FULL)} AS name, {_feed('email')} AS email, {_feed('phone')} AS phone, {_feed('consent')} AS consent, {_feed('ts_raw')} AS ts
            FROM sub WHERE source IN ('instagram', 'google_form', 'csv_upload')""", "sub"),
        "scan_csv_quotes": q("""SELECT CAST(ord AS STRING) AS ref, CASE WHEN ord % 3 = 0 THEN concat('said "', order_day, '",', chr(10), 'then "', coalesce(email, ''), chr(10), chr(10), 'end')
            ELSE concat(order_day, '"') END AS note, CASE WHEN email != '' OR email IS NULL THEN coalesce(email, '?') END AS mail FROM sub""", "sub"),
        "scan_bad_first_line": q("""SELECT CAST(ord AS STRING) AS ord_text, email FROM sub
            UNION ALL SELECT '{"ord_text": "', 'malformed JSON' FROM (SELECT DISTINCT ord % 4 FROM sub) f""", "sub"),
        "scan_json_array": q("SELECT CAST(ord AS STRING) AS ord_text, email FROM sub", "sub"),
        "scan_json_shapes": q("SELECT CAST(ord AS STRING) AS ord_text, email FROM sub", "sub"),
        "ingest_union": q(f"SELECT source, source AS tag, {_feed('email')} AS email, {_feed('phone')} AS phone FROM sub", "sub"),
        "quarantine_rows": q("SELECT 'landing_page' AS source, concat('{\"ord\": ', CAST(ord AS STRING)) AS raw_data, 'unreadable row' AS reason, 'malformed JSON' AS error_message, 0 AS retries_used FROM sub", "sub"),
        "schema_evolution": q("SELECT ord, CASE WHEN dataset_id = 'd2' THEN source END AS channel FROM leads", "leads"),
        # mapping
        "profile_fields": q("""SELECT source, field_name, string_agg(value, ' | ' ORDER BY ord) AS samples FROM
            (SELECT *, row_number() OVER (PARTITION BY source, field_name ORDER BY ord) AS n FROM cells WHERE value <> '') x WHERE n <= 5 GROUP BY source, field_name""", "sub", {"cells": _CELLS}),
        "mapping_memory": q(f"""SELECT source, field_name, CASE WHEN source = 'google_form' THEN {_case('field_name', {k.replace("'", "''"): v for k, v in FORM_HEADERS.items()}, 'NULL')} END AS remembered,
            source = 'google_form' AS known FROM headers""", "sub", {"cells": _CELLS, "headers": _HEADERS}),
        "mapping_synonym": q(f"SELECT source, field_name, {_case(_normalized('field_name'), SYNONYMS, 'NULL')} AS target FROM headers", "sub", {"cells": _CELLS, "headers": _HEADERS}),
        "resolve_mapping": q("SELECT h.source, h.field_name, d.canonical_field FROM headers h JOIN decisions d ON h.source = d.source AND h.field_name = d.field_name", "sub", {
            "cells": _CELLS, "headers": _HEADERS,
            "decisions": " UNION ALL ".join(f"SELECT '{s}' AS source, {_text(f)} AS field_name, {_text(t)} AS canonical_field" for s, fs in DECISIONS.items() for f, t in fs.items())}),
        "mapping_report": q("SELECT h.source, h.field_name, d.canonical_field, CASE WHEN d.canonical_field IS NULL THEN 'unmapped' ELSE 'mapped' END AS state FROM headers h JOIN decisions d ON h.source = d.source AND h.field_name = d.field_name", "sub", {
            "cells": _CELLS, "headers": _HEADERS,
            "decisions": " UNION ALL ".join(f"SELECT '{s}' AS source, {_text(f)} AS field_name, {_text(t)} AS canonical_field" for s, fs in DECISIONS.items() for f, t in fs.items())}),
        "apply_mapping": q("SELECT ord, source, " + ", ".join(f"{_mapped(t)} AS {t}" for t in S.MAPPED_FIELDS) + " FROM sub", "sub"),
        "mapping_upsert": """SELECT source, field_name, max_by(canonical_field, decided_at) AS canonical_field, max_by(sample_value, decided_at) AS sample_value FROM (
            SELECT event_type AS source, concat('column ', CAST(user_id AS STRING)) AS field_name,
              CASE WHEN value < 10 THEN '__unknown__' WHEN value < 30 THEN 'email' ELSE 'phone_e164' END AS canonical_field, props AS sample_value, ts AS decided_at FROM events) d
            GROUP BY source, field_name""",
        "nearest_topk": """WITH parts AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) r GROUP BY label, i),
            centres AS (SELECT CAST(label AS STRING) AS corpus_id, list(v ORDER BY i) AS vector FROM parts GROUP BY label),
            sims AS (SELECT vec_id, corpus_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), vector), 9) AS similarity FROM embeddings, centres)
            SELECT vec_id, CAST(rank AS INT) AS rank, corpus_id, round(similarity, 6) AS similarity FROM
              (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, corpus_id) AS rank FROM sims) x WHERE rank <= 3""",
        "get_dataset": f"WITH log AS ({_DS_LOG['log']}), state AS ({_DS_STATE['state']}) SELECT dataset_id, name, file_name, status, notes, tags FROM state WHERE dataset_id = 'ds-7' AND NOT coalesce(deleted, FALSE)",
        "get_lead": q(f"SELECT lead_id, email, phone_e164, quality_score, status, {_TS} FROM leads WHERE lead_id = (SELECT max(lead_id) FROM leads)", "leads"),
        "dense_positions": q("""SELECT dataset_id AS batch_id, figure, CASE WHEN figure = 'changed lead ids' THEN 0 ELSE count(*) END AS n
            FROM sub, (VALUES ('records'), ('positions'), ('span'), ('taken'), ('changed lead ids')) f(figure)
            WHERE dataset_id = 'd1' OR figure != 'changed lead ids' GROUP BY dataset_id, figure""", "sub"),
        "two_batches_one_dataset": q("SELECT count(*) AS valid, count(*) AS lead_ids, count(*) AS positions FROM scored", "scored"),
    }
    whole = out["dataset_summary"]
    out["dataset_lifecycle"] = f"SELECT dataset_id, 'Csv Upload import' AS name, 'completed' AS status, total_leads, clean, flagged, invalid, duplicates, avg_score FROM ({whole}) x"
    out["log_snapshots"] = out["dataset_lifecycle"]
    out["run_lifecycle"] = f"""SELECT concat('run-', dataset_id) AS run_id, 'csv_upload' AS source, 'completed' AS status, total_leads + invalid + duplicates AS total_records,
        total_leads AS processed, invalid AS failed, duplicates FROM ({whole}) x UNION ALL SELECT 'run-d3', 'csv_upload', 'completed', 0, 0, 0, 0"""
    out["run_summary"] = f"SELECT * FROM ({out['batch_summary']}) x WHERE dataset_id = 'd2'"
    out["failure_log"] = f"""WITH s AS (SELECT * FROM ({whole}) x WHERE dataset_id = 'd1') SELECT 'b' AS batch_id, 'attempt 1' AS figure, 1 AS n UNION ALL SELECT 'b', 'attempt 2', 1
        UNION ALL SELECT 'b', 'run completed', total_leads + invalid + duplicates FROM s UNION ALL SELECT 'b', 'dataset completed', total_leads FROM s"""
    out["batch_retry"] = f"""WITH s AS (SELECT * FROM ({whole}) x WHERE dataset_id = 'd1') SELECT 'leads' AS "table", total_leads AS rows FROM s UNION ALL SELECT 'duplicate_leads', duplicates FROM s
        UNION ALL SELECT 'invalid_leads', invalid FROM s UNION ALL SELECT 'quarantine', total_leads + duplicates + invalid FROM s"""
    out["mapping_persisted"] = f"SELECT * FROM ({out['resolve_mapping']}) x WHERE canonical_field IS NOT NULL"
    return out
