"""The registered queries, each with the SQL that checks it in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushlake.config import CustomRule, SanitizeConfig
from hushlake.functions.pin import pin
from hushlake.functions.validators import iban_valid, luhn_valid, mykad_valid, placeholder
from hushlake.operators import admission, report
from hushlake.operators.hits import HIT, all_hits
from hushlake.operators.integrity import source_integrity as check_integrity
from hushlake.operators.media import media_policy as apply_media_policy
from hushlake.operators.nested import sanitize_nested
from hushlake.operators.numbering import number_sessions
from hushlake.operators.overlap import resolve_overlaps as resolve
from hushlake.operators.overlap_rows import resolve_overlap_rows
from hushlake.operators.pages import assemble_pages
from hushlake.operators.redact import as_results, sanitize_table
from hushlake.operators.session_leaks import session_leak_check as check_sessions
from hushlake.operators.sessions import found_hits, hit_rows, sanitize_sessions
from hushlake.operators.structured import leaf_table, sanitize_declared, sanitize_leaves, sanitize_structured
from hushlake.plans import oracles as o
from hushlake.plans.corpora import all_corpora, corpus, office_files, pii_sql, planted, secrets_sql, table, workbooks
from hushlake.rules import BUILTIN_RULES, selected_rules
from hushlake.sources.csv_records import csv_lines, sanitize_csv_records
from hushlake.sources.files import decode_text, sanitize_file_rows, sanitize_files
from hushlake.sources.listing import delete_on_exit, write_files
from hushlake.sources.office import docx_text, docx_warnings, xlsx_text
from hushlake.sources.scratch import scratch_path
from hushlake.sources.workbooks import sanitize_lines, workbook_lines
from hushlake.streaming.redaction import read_document_stream, read_tables, sanitize_file_stream, sanitize_stream
from hushlake.streaming.sessions import sanitize_session_stream

Query = Callable[[SparkSession, str], DataFrame]
CUSTOMER = ["c_custkey", "c_name", "c_mktsegment"]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def _content(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "content", F.col("detection_count").cast("long").alias("detection_count"))


def _positions(results: DataFrame, key: str) -> DataFrame:
    return report.detections_table(results, [key]).select(
        key,
        "category",
        F.col("start").cast("long").alias("start_pos"),
        F.col("end").cast("long").alias("end_pos"),
        "confidence",
        "placeholder",
    )


# --- redaction of the given tables ------------------------------------------
@query("sanitize_documents", o.free_text_content("documents", "doc_id", "text"))
def sanitize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return _content(sanitize_table(docs, mode="pii"), "doc_id")


@query("sanitize_pages", o.free_text_content("pages", "page_id", "html"))
def sanitize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", ["page_id", "html"])
    return _content(sanitize_table(pages, "html", mode="pii"), "page_id")


# A value per turn that comes back every three turns of a conversation.
_TURN_TEXT = """concat(text, ' -- mail user', cast(turn % 3 as string), '@conv',
    cast(conv_id % 7 as string), '.example.com')"""
_TURN_NUMBER = """(SELECT conv_id, turn, text, dense_rank() OVER (PARTITION BY conv_id
        ORDER BY first_turn) AS n
    FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id, turn % 3) AS first_turn
        FROM conversations) f)"""


def _planted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.expr(_TURN_TEXT).alias("text"))


@query(
    "sanitize_conversations",
    f"""SELECT conv_id, turn, concat(text, ' -- mail ', printf('[EMAIL_%03d]', n)) AS content,
        cast(1 as bigint) AS detection_count FROM {_TURN_NUMBER} t""",
)
def sanitize_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitize_sessions(_planted_turns(spark, sf_dir), "text", ["conv_id"], "turn", "pii")
    return out.select(
        "conv_id", "turn", "content", F.col("detection_count").cast("long").alias("detection_count")
    )


@query(
    "placeholder_numbering",
    f"""SELECT DISTINCT conv_id, 'EMAIL' AS category,
        sha256(concat('user', cast(turn % 3 as string), '@conv', cast(conv_id % 7 as string),
            '.example.com')) AS value_key, cast(n as bigint) AS number FROM {_TURN_NUMBER} t""",
)
def placeholder_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = selected_rules(SanitizeConfig(mode="pii"))
    keys = ["conv_id", "turn"]
    hits = hit_rows(found_hits(_planted_turns(spark, sf_dir), "text", keys, rules), keys)
    numbers = number_sessions(hits, ["conv_id"], "turn")
    return numbers.select(
        "conv_id",
        "category",
        F.col("value").alias("value_key"),
        F.col("number").cast("long").alias("number"),
    )


# --- one planted corpus per mode ----------------------------------------------
def _mode_query(name: str, source: str, mode: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _content(sanitize_table(corpus(spark, sf_dir, source), mode=mode), "doc_id")


_mode_query(
    "sanitize_mode_secrets_only", "secrets", "secrets_only",
    f"SELECT doc_id, {o.SECRETS_CONTENT} AS content, {o.SECRETS_COUNT} AS detection_count "
    f"FROM {o.SECRETS} q",
)
_mode_query(
    "sanitize_mode_pii", "pii", "pii",
    f"SELECT doc_id, {o.PII_CONTENT} AS content, {o.PII_COUNT} AS detection_count FROM {o.PII} q",
)
_mode_query(
    "sanitize_mode_confidential", "confidential", "confidential",
    f"""SELECT doc_id, concat('Salary [AMOUNT_001]; acct #[ACCOUNT_NUMBER_001]; see ', url,
        ' ref ', ref) AS content, cast(2 as bigint) AS detection_count FROM {o.CONFIDENTIAL} q""",
)
_mode_query(
    "sanitize_mode_strict", "confidential", "strict",
    f"""SELECT doc_id, 'Salary [AMOUNT_001]; acct #[ACCOUNT_NUMBER_001]; '
        || 'see [INTERNAL_URL_001] ref [LONG_NUMBER_001]' AS content,
        cast(4 as bigint) AS detection_count FROM {o.CONFIDENTIAL} q""",
)


# --- settings as read from a configuration file --------------------------------
# names in any case, comma strings, blanks, aliases; the call's mode replaces the mapping's
_MAPPING = {
    "document_sanitization": {
        "mode": "off",
        "confidence_threshold": "0.9",
        "enable": "email, iban ,name,phone,",
        "disable": ["Phone "],
        "rules": [{"name": "call sign", "pattern": "call(?=; )|IC "}],
    }
}


@query(
    "config_mapping",
    f"""SELECT doc_id, concat('[CALL SIGN]', mykad, '; mail [EMAIL_001] and [EMAIL_001]; call ', phone, '; card ', card, '; pay ',
        CASE WHEN iban_ok THEN '[IBAN_001]' ELSE iban END, '; from ', CASE WHEN {o.NAME_OK} THEN '[NAME_001]' ELSE person END) AS content,
        cast(3 + CASE WHEN iban_ok THEN 1 ELSE 0 END + CASE WHEN {o.NAME_OK} THEN 1 ELSE 0 END as bigint) AS detection_count
        FROM {o.PII} q""",
)
def config_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(sanitize_table(corpus(spark, sf_dir, "pii"), config=_MAPPING, mode="pii"), "doc_id")


# --- one query per detector ---------------------------------------------------
def _detector_query(name: str, source: str, category: str, oracle: str) -> None:
    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cfg = SanitizeConfig(mode="strict", enable_categories=(category,))
        return _positions(sanitize_table(corpus(spark, sf_dir, source), config=cfg), "doc_id")


_HEAD_SECRETS = [
    ("key=", "api_key"), ("; token ", "jwt"), ("; password: \"", "password"),
    ("\"; Authorization: Bearer ", "bearer"), (" ", "db_url"), (" ", "private_key"),
]
_HEAD_PII = [
    ("IC ", "mykad"), ("; mail ", "email"), (" and ", "email"), ("; call ", "phone"),
    ("; card ", "card"), ("; pay ", "iban"), ("; from ", "person"),
]
_HEAD_CONFIDENTIAL = [
    ("Salary ", "amount"), ("; acct #", "account"), ("; see ", "url"), (" ref ", "ref"),
]


def _before(layout: list[tuple[str, str]], at: int) -> str:
    """SQL of the text in front of field number ``at``."""
    parts = []
    for label, value in layout[:at]:
        parts += [f"'{label}'", value]
    return f"concat({', '.join([*parts, repr(layout[at][0])])})".replace('\\"', '"')


for _name, _category, _at, _confidence, _where in [
    ("detect_api_key", "API_KEY", 0, 0.98, "true"),
    ("detect_jwt", "JWT", 1, 0.98, "true"),
    ("detect_password", "PASSWORD", 2, 0.92, o.PASSWORD_OK),
    ("detect_auth_header", "AUTH_HEADER", 3, 0.97, "true"),
    ("detect_db_url", "DB_URL", 4, 0.95, "true"),
    ("detect_private_key", "PRIVATE_KEY", 5, 0.99, "true"),
]:
    _detector_query(
        _name, "secrets", _category,
        o.detection_sql(
            o.SECRETS, _category, _before(_HEAD_SECRETS, _at), _HEAD_SECRETS[_at][1],
            _confidence, _where,
        ),
    )
for _name, _category, _at, _confidence, _where in [
    ("detect_mykad", "MYKAD", 0, 0.95, "mykad_ok"),
    ("detect_phone", "PHONE", 3, 0.90, "true"),
    ("detect_credit_card", "CREDIT_CARD", 4, 0.94, "card_ok"),
    ("detect_iban", "IBAN", 5, 0.96, "iban_ok"),
]:
    _detector_query(
        _name, "pii", _category,
        o.detection_sql(
            o.PII, _category, _before(_HEAD_PII, _at), _HEAD_PII[_at][1], _confidence, _where
        ),
    )
_detector_query(
    "detect_email", "pii", "EMAIL",
    " UNION ALL ".join(
        o.detection_sql(o.PII, "EMAIL", _before(_HEAD_PII, at), "email", 0.99) for at in (1, 2)
    ),
)


def _name_query(name: str, confidence: float, persons: str) -> None:
    oracle = o.detection_sql(
        o.PII, "NAME", _before(_HEAD_PII, 6), "person", confidence, f"person IN ({persons})"
    )

    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cfg = SanitizeConfig(mode="pii", enable_categories=("NAME",))
        found = _positions(sanitize_table(corpus(spark, sf_dir, "pii"), config=cfg), "doc_id")
        return found.where(F.col("confidence") == confidence)


_name_query("detect_name_bin", 0.93, "'AHMAD BIN ALI', 'Siti Nur BINTI Omar'")
_name_query("detect_name_al", 0.92, "'Kumar A/L Raju'")
for _name, _category, _at, _confidence in [
    ("detect_amount", "AMOUNT", 0, 0.88),
    ("detect_account", "ACCOUNT_NUMBER", 1, 0.86),
    ("detect_internal_url", "INTERNAL_URL", 2, 0.87),
]:
    _detector_query(
        _name, "confidential", _category,
        o.detection_sql(
            o.CONFIDENTIAL, _category, _before(_HEAD_CONFIDENTIAL, _at),
            _HEAD_CONFIDENTIAL[_at][1], _confidence,
        ),
    )
_detector_query(
    "detect_long_number", "confidential", "LONG_NUMBER",
    o.detection_sql(o.CONFIDENTIAL, "LONG_NUMBER", _before(_HEAD_CONFIDENTIAL, 1), "account", 0.86)
    + " UNION ALL "
    + o.detection_sql(
        o.CONFIDENTIAL, "LONG_NUMBER", _before(_HEAD_CONFIDENTIAL, 3), "ref", 0.86
    ).replace(
        "'[LONG_NUMBER_001]'",
        "CASE WHEN ref = account THEN '[LONG_NUMBER_001]' ELSE '[LONG_NUMBER_002]' END",
    ),
)


# --- rule selection ---------------------------------------------------------
def _selection_query(name: str, cfg: SanitizeConfig, oracle_counts: list[tuple[str, str, str]]) -> None:
    counted = " UNION ALL ".join(
        f"SELECT '{category}' AS category, cast({hits} as bigint) AS hits FROM {source} q"
        for category, source, hits in oracle_counts
    )
    oracle = f"SELECT * FROM ({counted}) c WHERE hits > 0"

    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        results = sanitize_table(all_corpora(spark, sf_dir), config=cfg)
        return report.category_metrics(results, "doc_id").select("category", "hits")


def _sum(condition: str, times: int = 1) -> str:
    return f"coalesce(sum(CASE WHEN {condition} THEN {times} ELSE 0 END), 0)"


_SECRET_COUNTS = [
    ("API_KEY", o.SECRETS, "count(*)"), ("JWT", o.SECRETS, "count(*)"),
    ("PASSWORD", o.SECRETS, _sum(o.PASSWORD_OK)), ("AUTH_HEADER", o.SECRETS, "count(*)"),
    ("DB_URL", o.SECRETS, "count(*)"), ("PRIVATE_KEY", o.SECRETS, "count(*)"),
]
_PII_COUNTS = {
    "EMAIL": "count(*) * 2", "PHONE": "count(*)", "MYKAD": _sum("mykad_ok"),
    "IBAN": _sum("iban_ok"), "CREDIT_CARD": _sum("card_ok"), "NAME": _sum(o.NAME_OK),
}
_selection_query(
    "rule_selection", SanitizeConfig(mode="pii"),
    _SECRET_COUNTS + [(c, o.PII, n) for c, n in _PII_COUNTS.items()],
)
_selection_query(
    "rule_selection_enable",
    SanitizeConfig(mode="pii", enable_categories=("MYKAD", "jwt", "AMOUNT", "NOT_A_CATEGORY")),
    [("JWT", o.SECRETS, "count(*)"), ("MYKAD", o.PII, _PII_COUNTS["MYKAD"])],
)
# without DB_URL the address inside the connection string comes through as EMAIL
_selection_query(
    "rule_selection_disable",
    SanitizeConfig(
        mode="pii", enable_categories=("EMAIL", "DB_URL", "PHONE"), disable_categories=("db_url",)
    ),
    [
        ("EMAIL", f"(SELECT 2 AS w FROM {o.PII} a UNION ALL SELECT 1 FROM {o.SECRETS} b)", "sum(w)"),
        ("PHONE", o.PII, "count(*)"),
    ],
)
_selection_query(
    "threshold_filter",
    SanitizeConfig(mode="strict", confidence_threshold=0.95),
    [(c, s, n) for c, s, n in _SECRET_COUNTS if c != "PASSWORD"]
    + [(c, o.PII, _PII_COUNTS[c]) for c in ("EMAIL", "MYKAD", "IBAN")],
)

CUSTOM_RULES = (
    CustomRule("hex token", r'(?<=token = ")(?P<hex_run>[0-9a-f]{40})(?=")', "[TOKEN]"),
    CustomRule("us phone", r"\+1 \(\d{3}\) \d{3}-\d{4}", "[US_PHONE]"),
    CustomRule("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
    CustomRule("broken", r"(unclosed", "[NEVER]"),
)
_CUSTOM_STEPS = """regexp_replace(regexp_replace(regexp_replace(text,
    '(token = ")[0-9a-f]{40}(")', '\\1[TOKEN]\\2', 'g'),
    '\\+1 \\(\\d{3}\\) \\d{3}-\\d{4}', '[US_PHONE]', 'g'),
    '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b', '[IP]', 'g')"""


@query(
    "custom_rules",
    f"""SELECT doc_id, {_CUSTOM_STEPS} AS content, cast(
        len(regexp_extract_all(text, 'token = "[0-9a-f]{{40}}"'))
        + len(regexp_extract_all(text, '\\+1 \\(\\d{{3}}\\) \\d{{3}}-\\d{{4}}'))
        + len(regexp_extract_all(text, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b')) as bigint)
        AS detection_count FROM documents""",
)
def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    cfg = SanitizeConfig(mode="secrets_only", custom_rules=CUSTOM_RULES)
    return _content(sanitize_table(docs, config=cfg), "doc_id")


# --- scalar functions ---------------------------------------------------------
def _check_query(name: str, column: str, check: Callable[[str], object], verdict: str) -> None:
    @query(name, f"SELECT doc_id, {verdict} AS valid FROM {o.PII} q")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        values = planted(spark, sf_dir, pii_sql("{base}"), "customer")
        return values.select("doc_id", check(column).alias("valid"))


_check_query("luhn_valid", "card", luhn_valid, "card_ok")
_check_query("iban_valid", "iban", iban_valid, "iban_ok")
_check_query("mykad_valid", "mykad", mykad_valid, "mykad_ok")


@query(
    "placeholder_format",
    "SELECT o_orderkey, printf('[ORDER_%03d]', o_orderkey) AS token FROM orders",
)
def placeholder_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", ["o_orderkey"]).select(
        "o_orderkey", placeholder("'ORDER'", "cast(o_orderkey as int)").alias("token")
    )


# --- core engine --------------------------------------------------------------
@query(
    "hits_with_offsets",
    f"""WITH {o.free_text_parts('documents', 'doc_id', 'text', emails_only=True)}
    SELECT key AS doc_id, cast(start_pos as bigint) AS start_pos,
        cast(start_pos + length(part) as bigint) AS end_pos FROM parts WHERE hit""",
)
def hits_with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [r for r in BUILTIN_RULES if r.category == "EMAIL"]
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"]).withColumnRenamed("text", "__text")
    found = pin(docs.select("doc_id", F.expr(all_hits("__text", rules)).alias("hits")), "hits")
    hits = found.select("doc_id", F.explode("hits").alias("h"))
    return hits.select(
        "doc_id",
        F.col("h.start").cast("long").alias("start_pos"),
        F.col("h.end").cast("long").alias("end_pos"),
    )


@query(
    "all_hits",
    "SELECT doc_id, category, start_pos, end_pos FROM ("
    + " UNION ALL ".join(
        o.detection_sql(o.CONFIDENTIAL, c, _before(_HEAD_CONFIDENTIAL, at),
                        _HEAD_CONFIDENTIAL[at][1], 0.9)
        for c, at in [("AMOUNT", 0), ("ACCOUNT_NUMBER", 1), ("LONG_NUMBER", 1),
                      ("INTERNAL_URL", 2), ("LONG_NUMBER", 3)]
    )
    + ") h",
)
def all_hits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = selected_rules(SanitizeConfig(mode="strict"))
    names = ", ".join(f"'{r.category}'" for r in rules)
    docs = corpus(spark, sf_dir, "confidential").withColumnRenamed("text", "__text")
    found = pin(docs.select("doc_id", F.expr(all_hits("__text", rules)).alias("hits")), "hits")
    hits = found.select("doc_id", F.explode("hits").alias("h"))
    return hits.select(
        "doc_id",
        F.expr(f"get(array({names}), h.rule)").alias("category"),
        F.col("h.start").cast("long").alias("start_pos"),
        F.col("h.end").cast("long").alias("end_pos"),
    )


# Eight spans per order that nest, chain, touch and tie.
_SPAN_START = "cast((o_orderkey * 7 + i * i * 13 + i * o_orderkey * 3) % 40 as int)"
_SPAN_LENGTH = "cast((o_orderkey * 5 + i * 11) % 9 + 1 as int)"


@query(
    "resolve_overlaps",
    f"""WITH RECURSIVE spans AS (
        SELECT o_orderkey, i, {_SPAN_START} AS s, {_SPAN_START} + {_SPAN_LENGTH} AS e
        FROM (SELECT o_orderkey, unnest(range(0, 8)) AS i FROM orders) x),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY s - e, s, i) AS r
        FROM spans),
    greedy AS (
        SELECT o_orderkey, cast(0 as bigint) AS r, cast([] as STRUCT(s INT, e INT)[]) AS kept
        FROM orders
        UNION ALL
        SELECT g.o_orderkey, k.r,
            CASE WHEN len(list_filter(g.kept, lambda x: k.s < x.e AND k.e > x.s)) > 0
                THEN g.kept ELSE list_append(g.kept, {{'s': k.s, 'e': k.e}}) END
        FROM greedy g JOIN ranked k ON k.o_orderkey = g.o_orderkey AND k.r = g.r + 1)
    SELECT o_orderkey, cast(u.s as bigint) AS start_pos, cast(u.e as bigint) AS end_pos
    FROM (SELECT o_orderkey, unnest(kept) AS u FROM greedy WHERE r = 8) z""",
)
def resolve_overlaps_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = f"""transform(sequence(0, 7), i -> named_struct('start', {_SPAN_START},
        'end', {_SPAN_START} + {_SPAN_LENGTH}, 'rank', i, 'rule', i, 'value', ''))"""
    kept = (
        table(spark, sf_dir, "orders", ["o_orderkey"])
        .select("o_orderkey", F.expr(spans).cast(f"array<{HIT}>").alias("__hits"))
        .select("o_orderkey", F.expr(resolve("__hits")).alias("kept"))
    )
    kept = pin(kept, "kept").select("o_orderkey", F.explode("kept").alias("h"))
    return kept.select(
        "o_orderkey",
        F.col("h.start").cast("long").alias("start_pos"),
        F.col("h.end").cast("long").alias("end_pos"),
    )


@query("overlap_rows", ORACLES["resolve_overlaps"])
def overlap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spans as rows of three long documents, in which orders stand one after another."""
    spans = f"""transform(sequence(0, 7), i -> named_struct('start', o_orderkey * 60 + {_SPAN_START},
        'end', o_orderkey * 60 + {_SPAN_START} + {_SPAN_LENGTH}, 'rank', i))"""
    hits = (
        table(spark, sf_dir, "orders", ["o_orderkey"])
        .select(F.expr("nullif(o_orderkey % 3, 0)").alias("doc"), F.explode(F.expr(spans)).alias("h"))
        .select("doc", "h.*")
    )
    return resolve_overlap_rows(hits, ["doc"]).select(
        F.expr("start div 60").alias("o_orderkey"),
        F.expr("cast(start % 60 as bigint)").alias("start_pos"),
        F.expr("cast(end - (start div 60) * 60 as bigint)").alias("end_pos"),
    )


_DOC_PARTS = f"WITH {o.free_text_parts('documents', 'doc_id', 'text')}"


def _documents_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return sanitize_table(docs, mode="pii")


@query(
    "detections_table",
    f"""{_DOC_PARTS} SELECT key AS doc_id, cast(row_number() OVER (
            PARTITION BY key ORDER BY start_pos) - 1 as bigint) AS det_ord, category,
        cast(start_pos as bigint) AS start_pos, cast(start_pos + length(part) as bigint) AS end_pos,
        cast(CASE category WHEN 'EMAIL' THEN 0.99 ELSE 0.94 END as double) AS confidence,
        placeholder FROM parts WHERE hit""",
)
def detections_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.detections_table(_documents_pii(spark, sf_dir), ["doc_id"])
    return found.select(
        "doc_id",
        F.col("det_ord").cast("long").alias("det_ord"),
        "category",
        F.col("start").cast("long").alias("start_pos"),
        F.col("end").cast("long").alias("end_pos"),
        "confidence",
        "placeholder",
    )


@query(
    "detection_count",
    f"""{_DOC_PARTS} SELECT key AS doc_id,
        cast(count(*) FILTER (WHERE hit) as bigint) AS detection_count FROM parts GROUP BY key""",
)
def detection_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_pii(spark, sf_dir).select(
        "doc_id", F.col("detection_count").cast("long").alias("detection_count")
    )


_DOC_CATEGORIES = """coalesce(string_agg(DISTINCT category, ',' ORDER BY category)
    FILTER (WHERE hit), '')"""


@query(
    "doc_categories",
    f"{_DOC_PARTS} SELECT key AS doc_id, {_DOC_CATEGORIES} AS categories FROM parts GROUP BY key",
)
def doc_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_pii(spark, sf_dir).select(
        "doc_id", F.array_join("categories", ",").alias("categories")
    )


_METRICS = """SELECT category, cast(count(*) as bigint) AS hits,
    cast(count(DISTINCT key) as bigint) AS docs,
    cast(count(DISTINCT (key, placeholder)) as bigint) AS placeholders
    FROM parts WHERE hit GROUP BY category"""


@query("category_metrics", f"{_DOC_PARTS} {_METRICS}")
def category_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.category_metrics(_documents_pii(spark, sf_dir), "doc_id")


# the known categories, stated on their own
_CATEGORY_ROWS = """('ACCOUNT_NUMBER'), ('AMOUNT'), ('API_KEY'), ('AUTH_HEADER'), ('CREDIT_CARD'), ('DB_URL'), ('EMAIL'),
    ('IBAN'), ('INTERNAL_URL'), ('JWT'), ('LONG_NUMBER'), ('MYKAD'), ('NAME'), ('PASSWORD'), ('PHONE'), ('PRIVATE_KEY')"""


@query(
    "category_catalogue",
    f"""{_DOC_PARTS}, metrics AS ({_METRICS})
    SELECT c.category, coalesce(hits, 0) AS hits, coalesce(docs, 0) AS docs,
        coalesce(placeholders, 0) AS placeholders
    FROM (VALUES {_CATEGORY_ROWS}) c(category) LEFT JOIN metrics m ON m.category = c.category""",
)
def category_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = report.category_metrics(_documents_pii(spark, sf_dir), "doc_id")
    return report.catalogue_with_metrics(spark, metrics)


# --- admission ----------------------------------------------------------------
_FILE_NAMES = (
    "a.tar.gz", "a.TGZ", ".env", "A.TXT", "b.md", "x.bin", "noext", "c.v2.JSON", "d.docx", "e.",
)
_FILE_EXTS = (".tar.gz", ".tgz", "", ".txt", ".md", ".bin", "", ".json", ".docx", "")
_NAME_SQL = (
    "CASE doc_id % 10 "
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_FILE_NAMES))
    + " END"
)
_EXT_SQL = (
    "CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_FILE_EXTS)) + " END"
)
_PATH_SQL = f"concat('/corpus/', cast(doc_id as string), '/', {_NAME_SQL})"


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing derived from the documents: their sizes, varied names."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr(_PATH_SQL).alias("path"),
        F.expr("cast(n_chars * 1000 as bigint)").alias("length"),
        F.expr("doc_id % 7 <> 3").alias("exists"),
    )


@query("doc_extension", f"SELECT doc_id, {_EXT_SQL} AS ext FROM documents")
def doc_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = admission.file_name(F.col("path"))
    return _listing(spark, sf_dir).select("doc_id", admission.doc_extension(name).alias("ext"))


_GATE_ERROR = f"""CASE WHEN doc_id % 7 = 3 THEN 'FileNotFoundError'
    WHEN n_chars * 1000 > 2 * 1024 * 1024 THEN 'FileTooLargeError'
    WHEN {_EXT_SQL} IN ('.tar.gz', '.tgz') THEN 'ArchiveNotSupportedError'
    WHEN {_EXT_SQL} IN ('', '.bin') THEN 'UnsupportedFormatError' END"""


@query(
    "admission_gate",
    f"""SELECT doc_id, error, CASE error
        WHEN 'FileNotFoundError' THEN concat('Not a file: ', path)
        WHEN 'FileTooLargeError' THEN 'File exceeds max_file_size_mb=2.0'
        WHEN 'ArchiveNotSupportedError'
            THEN 'Archives (.zip/.tar/.gz) are not supported in v1; extract files first'
        WHEN 'UnsupportedFormatError' THEN concat('Unsupported format ''', ext,
            '''; refuse to send raw contents (fail closed)') END AS message
    FROM (SELECT doc_id, {_PATH_SQL} AS path, {_EXT_SQL} AS ext, {_GATE_ERROR} AS error
        FROM documents) g""",
)
def admission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = SanitizeConfig(max_file_size_mb=2.0)
    gated = admission.admit(_listing(spark, sf_dir), cfg, exists="exists")
    return gated.select("doc_id", "error", "message")


_LIMITED = SanitizeConfig(mode="pii", max_text_length=4000)


@query(
    "text_length_gate",
    """SELECT doc_id, cast(length(text) as bigint) AS text_length,
        length(text) <= 4000 AS admitted FROM documents""",
)
def text_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return admission.text_length_gate(docs, "text", _LIMITED).select(
        "doc_id", F.col("n_chars").cast("long").alias("text_length"), "admitted"
    )


@query(
    "fail_closed_rows",
    f"""WITH {o.free_text_parts('documents', 'doc_id', 'text')},
    done AS (SELECT key, count(*) FILTER (WHERE hit) AS n, sum(length(part)) AS chars,
        string_agg(CASE WHEN hit THEN placeholder ELSE part END, '' ORDER BY idx) AS content
        FROM parts GROUP BY key)
    SELECT key AS doc_id, chars <= 4000 AS sanitized,
        CASE WHEN chars > 4000 THEN '' ELSE content END AS content,
        CASE WHEN chars > 4000 THEN 'FileTooLargeError' END AS error,
        CASE WHEN chars > 4000 THEN 'Text exceeds max_text_length=4000' ELSE '' END AS warnings,
        cast(CASE WHEN chars > 4000 THEN 0 ELSE n END as bigint) AS detection_count FROM done""",
)
def fail_closed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return sanitize_table(docs, config=_LIMITED).select(
        "doc_id",
        "sanitized",
        "content",
        F.col("metadata.error").alias("error"),
        F.array_join("warnings", "|").alias("warnings"),
        F.col("detection_count").cast("long").alias("detection_count"),
    )


@query(
    "mode_off",
    """SELECT doc_id, text AS content, false AS sanitized, 'mode=off' AS warnings,
        cast(0 as bigint) AS detection_count FROM documents""",
)
def mode_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return sanitize_table(docs, mode="off").select(
        "doc_id",
        "content",
        "sanitized",
        F.array_join("warnings", "|").alias("warnings"),
        F.col("detection_count").cast("long").alias("detection_count"),
    )


_MEDIA_EXT = "CASE page_id % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.webp' ELSE '.gif' END"
_MEDIA_TEXT = "CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN '  ' END"
_MEDIA_MODES = ("secrets_only", "pii", "confidential", "strict")


@query(
    "media_policy",
    f"""SELECT page_id, mode, ext, CASE WHEN NOT ok THEN '' WHEN trim(t) = ''
            THEN '[UNSANITIZED_IMAGE_CONTENT]' ELSE t END AS text,
        ok AND mode <> 'secrets_only' AS block_original_bytes,
        CASE WHEN NOT ok THEN 'UnsupportedFormatError' END AS error,
        CASE WHEN NOT ok THEN concat('No extracted text for image format ', ext)
        ELSE concat_ws('|', CASE WHEN mode <> 'secrets_only'
            THEN 'Original image bytes must not be sent to the model in this mode' END,
            CASE WHEN mode = 'strict'
            THEN 'strict mode: do not forward original image bytes even if OCR is clean' END,
            CASE WHEN trim(t) = ''
            THEN 'OCR produced no text; image content not safely sanitizable' END) END AS warnings
    FROM (SELECT *, ext <> '.gif' AND t IS NOT NULL AS ok FROM (
        SELECT page_id, unnest(['secrets_only', 'pii', 'confidential', 'strict']) AS mode,
            {_MEDIA_EXT} AS ext, {_MEDIA_TEXT} AS t FROM pages) a) b""",
)
def media_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "pages").select(
        "page_id",
        F.explode(F.array(*[F.lit(m) for m in _MEDIA_MODES])).alias("mode"),
        F.expr(_MEDIA_EXT).alias("ext"),
        F.expr(_MEDIA_TEXT).alias("extracted_text"),
    )
    out = apply_media_policy(media, F.col("mode"))
    return out.withColumn("warnings", F.array_join("warnings", "|"))


# A conversation stands for a document, its turns for the pages.
_PAGE_IMAGE = "(conv_id + turn) % 4 = 1"
_PAGE_FAILED = "(conv_id + turn) % 5 = 2"
_PAGE_BODY = "CASE WHEN (conv_id + turn) % 6 = 0 THEN '   ' ELSE text END"
_PAGE_LIMIT = 3000


def _pages_sql(limit: int | float) -> str:
    return f"""WITH p AS (SELECT conv_id, turn, {_PAGE_IMAGE} AS image, {_PAGE_FAILED} AS failed,
            CASE WHEN NOT {_PAGE_FAILED} AND trim({_PAGE_BODY}) <> '' THEN text END AS body
        FROM conversations),
    d AS (SELECT conv_id,
        coalesce(string_agg(body, chr(10) || chr(10) ORDER BY turn), '')
            || CASE WHEN bool_or(image) THEN chr(10) || chr(10) || '[UNSANITIZED_IMAGE_CONTENT]'
               ELSE '' END AS text,
        min(turn) FILTER (WHERE image) AS first_image,
        list(turn ORDER BY turn) FILTER (WHERE failed) AS fails
        FROM p GROUP BY conv_id),
    w AS (SELECT conv_id, string_agg(warning, '|' ORDER BY turn, o) AS warnings FROM (
        SELECT conv_id, turn, 0 AS o,
            'Failed to extract text from PDF page ' || cast(turn as string) AS warning
        FROM p WHERE failed
        UNION ALL SELECT conv_id, first_image, 1,
            '[UNSANITIZED_IMAGE_CONTENT] PDF may contain embedded images'
        FROM d WHERE first_image IS NOT NULL) u GROUP BY conv_id)
    SELECT d.conv_id, CASE WHEN length(text) > {limit} THEN '' ELSE text END AS text,
        CASE WHEN length(text) > {limit}
            THEN 'Extracted text exceeds max_text_length={limit}'
            ELSE coalesce(warnings, '') END AS warnings,
        CASE WHEN length(text) > {limit} THEN 'FileTooLargeError' END AS error
    FROM d LEFT JOIN w ON w.conv_id = d.conv_id"""


def _assembled(spark: SparkSession, sf_dir: str, cfg: SanitizeConfig) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(
        "conv_id",
        F.col("turn").alias("page_no"),
        F.expr(_PAGE_BODY).alias("text"),
        F.expr(_PAGE_IMAGE).alias("has_images"),
        F.expr(_PAGE_FAILED).alias("failed"),
    )
    return assemble_pages(pages, "conv_id", cfg).withColumn("warnings", F.array_join("warnings", "|"))


@query("page_text_assembly", _pages_sql(1 << 40))
def page_text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir, SanitizeConfig())


@query("page_text_limit", _pages_sql(_PAGE_LIMIT))
def page_text_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit as the feature: longer documents fail closed."""
    return _assembled(spark, sf_dir, SanitizeConfig(max_text_length=_PAGE_LIMIT))


@query(
    "source_integrity",
    """SELECT concat('/corpus/', cast(doc_id as string), '.txt') AS path,
        doc_id % 11 IN (0, 1, 2, 3) AS changed,
        CASE WHEN doc_id % 11 IN (0, 1, 2, 3) THEN
            'Original file metadata changed unexpectedly during sanitization' END AS warning
    FROM documents""",
)
def source_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in eleven files grew, was touched, was removed or is new."""
    docs = table(spark, sf_dir, "documents")
    path = F.expr("concat('/corpus/', cast(doc_id as string), '.txt')").alias("path")

    def listing(grown: str, touched: str, absent: str) -> DataFrame:
        return docs.where(F.expr(f"NOT ({absent})")).select(
            path,
            F.expr(f"timestamp_seconds(1700000000 + CASE WHEN {touched} THEN 1 ELSE 0 END)").alias(
                "modificationTime"
            ),
            F.expr(f"n_chars + CASE WHEN {grown} THEN 1 ELSE 0 END").alias("length"),
        )

    before = listing("false", "false", "doc_id % 11 = 3")
    after = listing("doc_id % 11 = 0", "doc_id % 11 = 1", "doc_id % 11 = 2")
    return check_integrity(before, after)


# --- sources ------------------------------------------------------------------
@query(
    "scan_text_files",
    r"""SELECT concat('/corpus/', cast(doc_id as string), '.txt') AS path,
        regexp_replace(concat(text, chr(13), chr(10), 'mail', chr(13), 'end', chr(65533)),
            '\r\n?', chr(10), 'g') AS text FROM documents""",
)
def scan_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with Windows and old Mac line ends and one bad byte."""
    raw = "concat(cast(concat(text, '\\r\\nmail\\rend') as binary), unhex('FF'))"
    return table(spark, sf_dir, "documents").select(
        F.expr("concat('/corpus/', cast(doc_id as string), '.txt')").alias("path"),
        decode_text(F.expr(raw)).alias("text"),
    )


_MAIL1 = "concat('user', cast(c_custkey%50 as string), '@', lower(c_mktsegment), '.example.com')"
_MAIL2 = "concat('other', cast(c_custkey as string), '@example.org')"
_JSON = f"""concat('{{"b": {{"mail": "', {_MAIL1}, '", "id": ', cast(c_custkey as string),
    '}}, "a": ["', {_MAIL2}, '", 4111111111111111, "', {_MAIL1}, ' ok"], "n": null}}')"""
_YAML = f"""concat('mail: ', {_MAIL1}, '\\nid: ', cast(c_custkey as string), '\\nmore:\\n- ',
    {_MAIL2}, '\\n- plain\\n')"""
_XML = f"""concat('<user mail="', {_MAIL1}, '"><email>', {_MAIL2}, '</email>tail ', {_MAIL1},
    '<note/></user>')"""
_CSV = f"""concat('email,id\\n', {_MAIL1}, ',', cast(c_custkey as string), '\\n"x, ', {_MAIL2},
    '",2\\n')"""


def _structured(spark: SparkSession, sf_dir: str, doc: str, kind: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer", CUSTOMER).select("c_custkey", F.expr(doc).alias("text"))
    return sanitize_structured(docs, "text", kind, mode="pii", key="c_custkey")


_N3 = "cast(3 as bigint) AS detection_count"


@query(
    "json_sanitize",
    f"""SELECT c_custkey, '[EMAIL_001]' AS mail, cast(c_custkey as string) AS id,
        '[EMAIL_002]' AS a0, '4111111111111111' AS a1, '[EMAIL_001] ok' AS a2, {_N3}
    FROM customer""",
)
def json_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    def field(path: str, name: str):
        return F.get_json_object("content", path).alias(name)

    return _structured(spark, sf_dir, _JSON, "json").select(
        "c_custkey",
        field("$.b.mail", "mail"),
        field("$.b.id", "id"),
        field("$.a[0]", "a0"),
        field("$.a[1]", "a1"),
        field("$.a[2]", "a2"),
        F.col("detection_count").cast("long").alias("detection_count"),
    )


@query(
    "yaml_leaf_sanitize",
    """SELECT c_custkey, concat('mail: ''[EMAIL_001]''', chr(10), 'id: ',
        cast(c_custkey as string), chr(10), 'more:', chr(10), '- ''[EMAIL_002]''', chr(10),
        '- plain', chr(10)) AS content, cast(2 as bigint) AS detection_count FROM customer""",
)
def yaml_leaf_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(_structured(spark, sf_dir, _YAML, "yaml"), "c_custkey")


@query(
    "xml_sanitize",
    f"""SELECT c_custkey, '<user mail="[EMAIL_001]"><email>[EMAIL_002]</email>'
        || 'tail [EMAIL_001]<note /></user>' AS content, {_N3} FROM customer""",
)
def xml_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(_structured(spark, sf_dir, _XML, "xml"), "c_custkey")


@query(
    "csv_sanitize",
    """SELECT c_custkey, concat('email,id', chr(13), chr(10), '[EMAIL_001],',
        cast(c_custkey as string), chr(13), chr(10), '"x, [EMAIL_002]",2', chr(13), chr(10))
        AS content, cast(2 as bigint) AS detection_count FROM customer""",
)
def csv_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _content(_structured(spark, sf_dir, _CSV, "csv"), "c_custkey")


# --- the same with a declared schema, without Python ---------------------------
def _declared(
    spark: SparkSession, sf_dir: str, doc: str, schema: str, kind: str
) -> DataFrame:
    docs = table(spark, sf_dir, "customer", CUSTOMER).select("c_custkey", F.expr(doc).alias("text"))
    fields = T.StructType.fromDDL(schema)
    out = sanitize_declared(docs, "text", fields, kind, mode="pii")
    return out.withColumn("detection_count", F.col("detection_count").cast("long")).withColumn(
        "warnings", F.array_join("warnings", "|")
    )


_JSON_BROKEN = f"""CASE WHEN c_custkey % 5 = 2 THEN concat('{{', {_MAIL1}) ELSE concat(
    '{{"b": {{"mail": "', {_MAIL1}, '", "id": ', cast(c_custkey as string),
    '}}, "a": ["', {_MAIL2}, '", "', {_MAIL1}, ' ok"], "n": null}}') END"""


@query(
    "json_sanitize_declared",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 2 THEN NULL ELSE '[EMAIL_001]' END AS mail,
        CASE WHEN c_custkey % 5 = 2 THEN NULL ELSE cast(c_custkey as string) END AS id,
        CASE WHEN c_custkey % 5 = 2 THEN NULL ELSE '[EMAIL_002]' END AS a0,
        CASE WHEN c_custkey % 5 = 2 THEN 'Malformed JSON; sanitized as plain text' ELSE '' END
            AS warnings,
        CASE WHEN c_custkey % 5 = 2 THEN '{[EMAIL_001]' END AS plain,
        cast(CASE WHEN c_custkey % 5 = 2 THEN 1 ELSE 3 END as bigint) AS detection_count
    FROM customer""",
)
def json_sanitize_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "b STRUCT<mail: STRING, id: BIGINT>, a ARRAY<STRING>, n STRING"
    out = _declared(spark, sf_dir, _JSON_BROKEN, schema, "json")
    return out.select(
        "c_custkey",
        F.get_json_object("content", "$.b.mail").alias("mail"),
        F.get_json_object("content", "$.b.id").alias("id"),
        F.get_json_object("content", "$.a[0]").alias("a0"),
        "warnings",
        F.when(F.col("warnings") != "", F.col("content")).alias("plain"),
        "detection_count",
    )


@query(
    "xml_sanitize_declared",
    """SELECT c_custkey, '[EMAIL_001]' AS mail, '[EMAIL_002]' AS email,
        cast(2 as bigint) AS detection_count FROM customer""",
)
def xml_sanitize_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = f"""concat('<user mail="', {_MAIL1}, '"><email>', {_MAIL2}, '</email><n>5</n></user>')"""
    out = _declared(spark, sf_dir, doc, "_mail STRING, email STRING, n INT", "xml")
    return out.select(
        "c_custkey",
        F.regexp_extract("content", '<ROW mail="([^"]*)"', 1).alias("mail"),
        F.regexp_extract("content", "<email>([^<]*)</email>", 1).alias("email"),
        "detection_count",
    )


@query(
    "csv_sanitize_declared",
    """SELECT c_custkey, concat('[EMAIL_001],', cast(c_custkey as string), ',[EMAIL_002]')
        AS content, cast(2 as bigint) AS detection_count FROM customer""",
)
def csv_sanitize_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = f"concat({_MAIL1}, ',', cast(c_custkey as string), ',', {_MAIL2})"
    out = _declared(spark, sf_dir, doc, "mail STRING, id INT, other STRING", "csv")
    return out.select("c_custkey", "content", "detection_count")


_BROKEN = f"concat('{{\"mail\": \"', {_MAIL1}, '\"', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '}}' END)"


@query(
    "malformed_fallback",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '{"mail": "[EMAIL_001]"'
            ELSE concat('{', chr(10), '  "mail": "[EMAIL_001]"', chr(10), '}') END AS content,
        CASE WHEN c_custkey % 3 = 0 THEN 'Malformed JSON; sanitized as plain text' ELSE '' END
            AS warnings, cast(1 as bigint) AS detection_count FROM customer""",
)
def malformed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir, _BROKEN, "json").select(
        "c_custkey",
        "content",
        F.array_join("warnings", "|").alias("warnings"),
        F.col("detection_count").cast("long").alias("detection_count"),
    )


@query(
    "nested_sanitize",
    """SELECT c_custkey, '[EMAIL_001]' AS email, c_custkey AS id,
        'keep|[EMAIL_002]|[EMAIL_001]' AS tags, concat('key', cast(c_custkey as string), '@x.com')
        AS attr_key, 'see [EMAIL_002]' AS attr_value, cast(4 as bigint) AS detection_count
    FROM customer""",
)
def nested_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = f"""named_struct('email', {_MAIL1}, 'id', c_custkey,
        'tags', array('keep', {_MAIL2}, {_MAIL1}),
        'attrs', map(concat('key', cast(c_custkey as string), '@x.com'), concat('see ', {_MAIL2})))"""
    rows = table(spark, sf_dir, "customer", CUSTOMER).select("c_custkey", F.expr(record).alias("r"))
    return sanitize_nested(rows, "r", mode="pii").select(
        "c_custkey",
        "r.email",
        "r.id",
        F.array_join("r.tags", "|").alias("tags"),
        F.expr("get(map_keys(r.attrs), 0)").alias("attr_key"),
        F.expr("get(map_values(r.attrs), 0)").alias("attr_value"),
        F.col("detection_count").cast("long").alias("detection_count"),
    )


@query(
    "leaf_sanitize",
    """SELECT c_custkey, cast(l.ord as bigint) AS leaf_ord, l.path, l.content FROM (
        SELECT c_custkey, unnest([
            {'ord': 0, 'path': '$.b.mail', 'content': '[EMAIL_001]'},
            {'ord': 1, 'path': '$.a[0]', 'content': '[EMAIL_002]'},
            {'ord': 2, 'path': '$.a[2]', 'content': '[EMAIL_001] ok'}]) AS l FROM customer) x""",
)
def leaf_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer", CUSTOMER).select("c_custkey", F.expr(_JSON).alias("text"))
    leaves = leaf_table(docs, "text", F.lit("json"))
    out = sanitize_sessions(leaves, "value", ["c_custkey"], "leaf_ord", "pii")
    return out.select("c_custkey", F.col("leaf_ord").cast("long").alias("leaf_ord"), "path", "content")


@query(
    "leaf_rebuild",
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 4 AS doc,
            row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey) AS n FROM customer)
    SELECT doc, CASE WHEN doc < 2 THEN concat('[', chr(10), string_agg(concat('  {', chr(10), '    "id": ', cast(k as string),
            ',', chr(10), '    "mail": "to ', printf('[EMAIL_%03d]', n), ' \\"ok\\""', chr(10), '  }'), concat(',', chr(10)) ORDER BY n),
            chr(10), ']')
        ELSE concat('<all>', string_agg(concat('<c id="', cast(k as string), '">&lt;', printf('[EMAIL_%03d]', n), '&gt;</c>tail &amp;'), ''
            ORDER BY n), '</all>') END AS content, cast(count(*) as bigint) AS detection_count, false AS fell_back
    FROM c GROUP BY doc""",
)
def leaf_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers in two JSON and two XML documents of very many leaves, redacted leaf by leaf."""
    entry = f"""CASE WHEN c_custkey % 4 < 2 THEN concat('{{"id": ', cast(c_custkey as string), ', "mail": "to ', {_MAIL2}, ' \\\\"ok\\\\""}}')
        ELSE concat('<c id="', cast(c_custkey as string), '">&lt;', {_MAIL2}, '&gt;</c>tail &amp;') END"""
    rows = table(spark, sf_dir, "customer", CUSTOMER).select("c_custkey", F.expr(entry).alias("entry"))
    docs = rows.groupBy((F.col("c_custkey") % 4).alias("doc")).agg(
        F.expr("transform(sort_array(collect_list(struct(c_custkey, entry))), x -> x.entry)").alias("entries")
    ).select(
        "doc",
        F.expr("if(doc < 2, concat('[', array_join(entries, ','), ']'), concat('<all>', array_join(entries, ''), '</all>'))").alias("text"),
        F.expr("if(doc < 2, 'json', 'xml')").alias("kind"),
    )
    return sanitize_leaves(docs, "text", F.col("kind"), ["doc"], mode="pii").drop("error")


_KIND_EXT = "CASE c_custkey % 6 WHEN 0 THEN 'txt' WHEN 1 THEN 'json' WHEN 2 THEN 'yml' WHEN 3 THEN 'xml' WHEN 4 THEN 'CSV' ELSE 'zip' END"
_KIND_PATH = f"concat('/corpus/c', cast(c_custkey as string), '.', {_KIND_EXT})"


def _mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of five types and an archive, shaped like the binaryFile source."""
    text = f"""CASE c_custkey % 6 WHEN 0 THEN concat('to ', {_MAIL1}, '\\r\\nand ', {_MAIL2})
        WHEN 1 THEN {_JSON} WHEN 2 THEN {_YAML} WHEN 3 THEN {_XML} WHEN 4 THEN {_CSV}
        ELSE {_MAIL1} END"""
    return (
        table(spark, sf_dir, "customer", CUSTOMER)
        .select(F.expr(_KIND_PATH).alias("path"), F.expr(text).cast("binary").alias("content"))
        .withColumn("length", F.octet_length("content").cast("long"))
    )


_MIXED_CONTENT = """CASE {kind}
        WHEN 0 THEN concat('to [EMAIL_001]', chr(10), 'and [EMAIL_002]')
        WHEN 1 THEN concat('{{', chr(10), '  "b": {{', chr(10), '    "mail": "[EMAIL_001]",',
            chr(10), '    "id": ', cast(c_custkey as string), chr(10), '  }},', chr(10), '  "a": [',
            chr(10), '    "[EMAIL_002]",', chr(10), '    4111111111111111,', chr(10),
            '    "[EMAIL_001] ok"', chr(10), '  ],', chr(10), '  "n": null', chr(10), '}}')
        WHEN 2 THEN concat('mail: ''[EMAIL_001]''', chr(10), 'id: ', cast(c_custkey as string),
            chr(10), 'more:', chr(10), '- ''[EMAIL_002]''', chr(10), '- plain', chr(10))
        WHEN 3 THEN '<user mail="[EMAIL_001]"><email>[EMAIL_002]</email>tail [EMAIL_001]<note /></user>'
        WHEN 4 THEN concat('email,id', chr(13), chr(10), '[EMAIL_001],',
            cast(c_custkey as string), chr(13), chr(10), '"x, [EMAIL_002]",2', chr(13), chr(10))
        ELSE '' END"""
_MIXED_RESULTS = f"""(SELECT {_KIND_PATH} AS path, c_custkey % 6 AS kind,
    concat('c', cast(c_custkey as string), '.', {_KIND_EXT}) AS file,
    {_MIXED_CONTENT.format(kind="c_custkey % 6")} AS content,
    cast(CASE c_custkey % 6 WHEN 1 THEN 3 WHEN 3 THEN 3 WHEN 5 THEN 0 ELSE 2 END as bigint)
        AS detections FROM customer)"""


@query(
    "dispatch_by_type",
    f"""SELECT path, CASE kind WHEN 0 THEN 'text' WHEN 1 THEN 'json' WHEN 2 THEN 'yaml'
        WHEN 3 THEN 'xml' WHEN 4 THEN 'csv' END AS content_type, content,
        detections AS detection_count FROM {_MIXED_RESULTS} r""",
)
def dispatch_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitize_file_rows(_mixed_files(spark, sf_dir), mode="pii").select(
        "path",
        F.col("metadata.content_type").alias("content_type"),
        "content",
        F.col("detection_count").cast("long").alias("detection_count"),
    )


_OFFICE_TEXT = """CASE kind WHEN 6 THEN concat('write to [EMAIL_001]', chr(10), chr(10), '[EMAIL_002]',
        chr(10), chr(10), '[UNSANITIZED_IMAGE_CONTENT] embedded images were not OCR''d')
    WHEN 7 THEN concat('## Sheet 1', chr(10), 'A1:[EMAIL_001] | B1:=SUM(A2)', chr(10), 'A2:',
        cast(c_custkey as string)) ELSE '' END"""
_SCAN_EXT = "['.txt', '.json', '.yml', '.xml', '.CSV', '.zip', '.docx', '.xlsx', '.md', '.log', '.txt', '.png']"
#: folders, and names of which two kinds are hidden
_SCAN_PATH = """concat('d', cast(c_custkey % 5 as string), CASE WHEN c_custkey % 12 = 10 THEN '/_part' ELSE '/e' END,
    cast(c_custkey % 3 as string), CASE WHEN c_custkey % 12 = 9 THEN '/.c' ELSE '/c' END,
    cast(c_custkey as string), {ext})"""


def _files_to_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content`` of files of twelve kinds: each type, an archive, office files, an empty
    file, a hidden one, one in a hidden folder, and an image."""
    ext = f"element_at(array({_SCAN_EXT[1:-1]}), cast(c_custkey % 12 as int) + 1)"
    text = f"""CASE c_custkey % 12 WHEN 0 THEN concat('to ', {_MAIL1}, '\\r\\nand ', {_MAIL2})
        WHEN 1 THEN {_JSON} WHEN 2 THEN {_YAML} WHEN 3 THEN {_XML} WHEN 4 THEN {_CSV}
        WHEN 8 THEN '' ELSE {_MAIL1} END"""
    rows = table(spark, sf_dir, "customer", CUSTOMER).select(
        F.expr(_SCAN_PATH.format(ext=ext)).alias("path"),
        F.expr(text).cast("binary").alias("plain"),
        office_files(
            F.expr(ext),
            F.expr(f"array({_MAIL1}, {_MAIL2}, cast(c_custkey as string))"),
        ).alias("office"),
    )
    return rows.select("path", F.coalesce("office", "plain").alias("content"))


@query(
    "scan_all_files",
    f"""SELECT {_SCAN_PATH.format(ext=f"{_SCAN_EXT}[c_custkey % 12 + 1]")} AS path,
        CASE kind WHEN 0 THEN 'text' WHEN 1 THEN 'json' WHEN 2 THEN 'yaml' WHEN 3 THEN 'xml'
            WHEN 4 THEN 'csv' WHEN 6 THEN 'text' WHEN 7 THEN 'text' WHEN 8 THEN 'text' END AS content_type,
        CASE WHEN kind < 5 THEN content ELSE {_OFFICE_TEXT} END AS content,
        CASE kind WHEN 5 THEN 'ArchiveNotSupportedError' WHEN 9 THEN 'HiddenFileError'
            WHEN 10 THEN 'HiddenFileError' WHEN 11 THEN 'UnsupportedFormatError' END AS error,
        cast(CASE kind WHEN 1 THEN 3 WHEN 3 THEN 3 WHEN 0 THEN 2 WHEN 2 THEN 2 WHEN 4 THEN 2 WHEN 6 THEN 2
            WHEN 7 THEN 1 ELSE 0 END as bigint) AS detection_count
    FROM (SELECT c_custkey, c_custkey % 12 AS kind, {_MIXED_CONTENT.format(kind="c_custkey % 12")} AS content FROM customer) f""",
)
def scan_all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a file in the shared scratch folder, listed, opened and redacted from there."""
    root = scratch_path(spark, "files")
    write_files(_files_to_scan(spark, sf_dir), root).write.format("noop").mode("overwrite").save()
    delete_on_exit(spark, root)
    found = sanitize_files(spark, root, mode="pii")
    return found.select(
        F.regexp_extract("path", "/(d[0-4]/.*)$", 1).alias("path"),
        F.col("metadata.content_type").alias("content_type"),
        "content",
        F.col("metadata.error").alias("error"),
        F.col("detection_count").cast("long").alias("detection_count"),
    )


@query(
    "result_payload",
    f"""SELECT file, 'pii' AS mode, kind <> 5 AS sanitized, detections,
        CASE WHEN kind = 5 THEN '' ELSE 'EMAIL' END AS categories,
        CASE WHEN kind = 5 THEN 'Archives (.zip/.tar/.gz) are not supported in v1; '
            || 'extract files first' ELSE '' END AS warnings,
        CASE WHEN kind = 5 THEN 'ArchiveNotSupportedError' END AS error, content
    FROM {_MIXED_RESULTS} r""",
)
def result_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = report.result_payload(sanitize_file_rows(_mixed_files(spark, sf_dir), mode="pii"))
    return records.select(
        "file",
        "mode",
        "sanitized",
        F.col("detections").cast("long").alias("detections"),
        F.array_join("categories", ",").alias("categories"),
        F.array_join("warnings", "|").alias("warnings"),
        F.col("metadata.error").alias("error"),
        "content",
    )


@query(
    "docx_paragraphs",
    """SELECT c_custkey, concat('Dear ', c_name, chr(10), chr(10), 'write to user',
        cast(c_custkey % 50 as string), '@', lower(c_mktsegment), '.example.com',
        CASE WHEN c_custkey % 2 = 0 THEN concat(chr(10), chr(10),
            '[UNSANITIZED_IMAGE_CONTENT] embedded images were not OCR''d') ELSE '' END) AS text,
        cast(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END as bigint) AS n_warnings FROM customer""",
)
def docx_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph runs as the container reader yields them, from customer rows."""
    paragraphs = f"""array(array('  Dear ', c_name, ' '), array(' ', '\\t'),
        array('write to user', cast(c_custkey % 50 as string),
              substring({_MAIL1}, length(concat('user', cast(c_custkey % 50 as string))) + 1)))"""
    parts = table(spark, sf_dir, "customer", CUSTOMER).select(
        "c_custkey",
        F.expr(paragraphs).alias("paragraphs"),
        F.expr("c_custkey % 2 = 0").alias("has_media"),
    )
    return parts.select(
        "c_custkey",
        docx_text("paragraphs", "has_media").alias("text"),
        F.size(docx_warnings("has_media")).cast("long").alias("n_warnings"),
    )


@query(
    "xlsx_cells",
    """SELECT c_custkey, concat('## Sheet 1', chr(10), 'A1:', c_name, ' | B1:9', chr(10),
        '## Sheet 2', chr(10), 'A1:=SUM(B1) | ', cast(c_custkey as string), ' | C1:', chr(10),
        '## Sheet 3', chr(10), 'A1:user', cast(c_custkey % 50 as string), '@', lower(c_mktsegment),
        '.example.com') AS text FROM customer""",
)
def xlsx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbook parts as the container reader yields them: sheet10 sorts before
    sheet2, an index without shared string, a formula, cells without ref or value."""
    cell = "named_struct('ref', {}, 't', {}, 'v', {}, 'f', {})"
    c1 = cell.format("'A1'", "'s'", "'0'", "string(null)")
    c2 = cell.format("'B1'", "'s'", "'9'", "string(null)")
    c3 = cell.format("'A1'", "'s'", "'1'", "string(null)")
    c4 = cell.format("'A1'", "string(null)", "'3'", "'SUM(B1)'")
    c5 = cell.format("''", "'n'", "cast(c_custkey as string)", "string(null)")
    c6 = cell.format("'C1'", "string(null)", "string(null)", "string(null)")
    sheet = "named_struct('part', 'xl/worksheets/sheet{}.xml', 'rows', array({}))"
    sheets = ", ".join(
        [
            sheet.format(2, f"array({c3})"),
            sheet.format(10, f"array({c4}, {c5}, {c6})"),
            sheet.format(1, f"array({c1}, {c2})"),
        ]
    )
    parts = table(spark, sf_dir, "customer", CUSTOMER).select(
        "c_custkey",
        F.expr(f"array(c_name, {_MAIL1})").alias("shared"),
        F.expr(f"array({sheets})").alias("sheets"),
    )
    return parts.select("c_custkey", xlsx_text("shared", "sheets").alias("text"))


@query(
    "xlsx_lines",
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 7 AS book,
            row_number() OVER (PARTITION BY c_custkey % 7 ORDER BY c_custkey) AS n,
            count(*) OVER (PARTITION BY c_custkey % 7) AS size FROM customer),
        lines AS (
            SELECT book, 2 * n - 1 AS line, concat('A', cast(k as string), ':', printf('[EMAIL_%03d]', n), ' | B',
                cast(k as string), ':=SUM(C1) | 99999999') AS content, 1 AS hits FROM c
            UNION ALL SELECT DISTINCT book, 0, '## Sheet 1', 0 FROM c
            UNION ALL SELECT DISTINCT book, 4294967296, '## Sheet 2', 0 FROM c
            UNION ALL SELECT DISTINCT book, 4294967297, concat('A1:', printf('[EMAIL_%03d]', size)), 1 FROM c)
    SELECT concat('book', cast(book as string), '.xlsx') AS path, cast(line as bigint) AS line, content,
        cast(hits as bigint) AS detection_count, NULL::VARCHAR AS error FROM lines""",
)
def xlsx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven workbooks of all customers: cells and shared strings as tables, joined by index,
    redacted line by line with numbers that run through a workbook."""
    customers = table(spark, sf_dir, "customer", CUSTOMER).select("c_custkey", F.expr(_MAIL2).alias("mail"))
    books = customers.groupBy(F.expr("c_custkey % 7").alias("book")).agg(
        F.sort_array(F.collect_list(F.struct("c_custkey", "mail"))).alias("rows")
    )
    files = books.select(
        F.expr("concat('book', cast(book as string), '.xlsx')").alias("path"),
        workbooks(F.expr("rows.c_custkey"), F.expr("rows.mail")).alias("content"),
    )
    out = sanitize_lines(workbook_lines(files), mode="pii")
    return out.select("path", "line", "content", F.col("detection_count").cast("long").alias("detection_count"), "error")


@query(
    "csv_large_files",
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 3 AS part,
            row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_custkey) AS n FROM customer)
    SELECT concat('part', cast(part as string), '.csv') AS path, concat(cast(k as string), ',', printf('[EMAIL_%03d]', n),
            ',"say ""hi"",', chr(10), 'see ', printf('[EMAIL_%03d]', n), '"') AS content,
        cast(2 as bigint) AS detection_count FROM c
    UNION ALL SELECT DISTINCT concat('part', cast(part as string), '.csv'), 'id,mail,note', cast(0 as bigint) FROM c""",
)
def csv_large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers in three CSV files with line ends inside of quotes, read by byte ranges and
    redacted record by record, with numbers that run through a file."""
    record = f"concat(cast(c_custkey as string), ',', {_MAIL2}, ',\"say \"\"hi\"\",\\n', 'see ', {_MAIL2}, '\"\\n')"
    records = table(spark, sf_dir, "customer", CUSTOMER).select("c_custkey", F.expr(record).alias("record"))
    files = records.groupBy(F.expr("concat('part', cast(c_custkey % 3 as string), '.csv')").alias("path")).agg(
        F.sort_array(F.collect_list(F.struct("c_custkey", "record"))).alias("rows")
    )
    root = scratch_path(spark, "csv-files")
    whole = files.select("path", F.expr("concat('id,mail,note\\n', array_join(rows.record, ''))").alias("content"))
    write_files(whole, root).write.format("noop").mode("overwrite").save()
    delete_on_exit(spark, root)
    out = sanitize_csv_records(csv_lines(spark, root), mode="pii")
    return out.select(F.element_at(F.split("path", "/"), -1).alias("path"), "content", "detection_count")


# --- reports ------------------------------------------------------------------
@query(
    "audit_table",
    f"""{_DOC_PARTS} SELECT key AS doc_id, '(text)' AS file, 'pii' AS mode,
        cast(count(*) FILTER (WHERE hit) as bigint) AS detections,
        CASE WHEN {_DOC_CATEGORIES} = '' THEN 'none' ELSE {_DOC_CATEGORIES} END AS categories
    FROM parts GROUP BY key""",
)
def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = report.audit_table(_documents_pii(spark, sf_dir), ["doc_id"])
    return audit.withColumn("detections", F.col("detections").cast("long"))


@query(
    "warning_rows",
    """SELECT doc_id, '(text)' AS file, 'Text exceeds max_text_length=4000' AS detail
    FROM documents WHERE length(text) > 4000""",
)
def warning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return report.warning_rows(sanitize_table(docs, config=_LIMITED), ["doc_id"])


@query(
    "leak_check",
    f"""SELECT doc_id, 'PASSWORD' AS category, cast(1 as bigint) AS leaked_values
    FROM {o.SECRETS} q WHERE {o.PASSWORD_OK}""",
)
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The password is repeated later as ordinary prose, where no rule sees it."""
    repeated = planted(spark, sf_dir, secrets_sql("{base}"), "customer").select(
        "doc_id", F.concat("text", F.lit(" again "), "password").alias("text")
    )
    results = sanitize_table(repeated.withColumn("original", F.col("text")), mode="pii")
    return report.leak_check(results, ["doc_id"], "original", mode="pii")


# A password that every third turn names as one, and that the others repeat as prose. Conversations
# share it by sevens, so one that never masks it must not be reported.
_TOLD = "concat('pw', substr(md5(cast(conv_id % 7 as string)), 1, 6 + cast(conv_id % 12 as int)))"
_TOLD_TEXT = f"""CASE WHEN turn % 3 = 0 THEN concat(text, ' password: "', {_TOLD}, '"')
    ELSE concat(text, ' again ', {_TOLD}, ' and') END"""


@query(
    "session_leak_check",
    """SELECT DISTINCT conv_id, turn, 'PASSWORD' AS category, cast(1 as bigint) AS leaked_values FROM conversations c
    WHERE turn % 3 <> 0 AND EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn % 3 = 0)""",
)
def session_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one turn masks stands as prose in others, where no rule sees it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_TOLD_TEXT).alias("text"))
    cfg = SanitizeConfig(mode="pii", enable_categories=("PASSWORD",))
    results = sanitize_sessions(turns.withColumn("original", F.col("text")), "text", ["conv_id"], "turn", config=cfg)
    return check_sessions(results, ["conv_id"], ["turn"], "original", config=cfg)


@query("stream_sanitize", ORACLES["sanitize_documents"])
def stream_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, a file or a folder of files, as a stream into a parquet sink, read back."""
    schema = table(spark, sf_dir, "documents").schema
    stream = read_document_stream(spark, f"{sf_dir}/documents.parquet", schema, "*")
    sink = scratch_path(spark, "stream-sink")
    sanitize_stream(
        stream.select("doc_id", "text"), sink, scratch_path(spark, "stream-checkpoint"), mode="pii"
    ).awaitTermination()
    done = T.StructType([schema["doc_id"], T.StructField("content", T.StringType()), T.StructField("detection_count", T.IntegerType())])
    return _content(spark.read.schema(done).parquet(sink), "doc_id")


@query("stream_sessions", ORACLES["sanitize_conversations"])
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations in three pieces, one after the other: numbers go on where they were."""
    root = scratch_path(spark, "stream-sessions")
    delete_on_exit(spark, root)
    turns = _planted_turns(spark, sf_dir)
    for piece in range(3):
        turns.where(F.least(F.floor(F.col("turn") / 3), F.lit(2)) == piece).write.mode("append").parquet(f"{root}/in")
        stream = read_document_stream(spark, f"{root}/in", turns.schema)
        sanitize_session_stream(
            stream, f"{root}/out", f"{root}/checkpoint", "text", ["conv_id"], "turn", mode="pii"
        ).awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.select(
        "conv_id", "turn", "content", F.col("detection_count").cast("long").alias("detection_count")
    )


@query(
    "stream_files",
    f"""SELECT path, CASE kind WHEN 0 THEN 'text' WHEN 1 THEN 'json' WHEN 2 THEN 'yaml'
        WHEN 3 THEN 'xml' WHEN 4 THEN 'csv' END AS content_type, content, detections AS detection_count,
        detections AS detection_rows, CASE WHEN kind = 5 THEN 'ArchiveNotSupportedError' END AS error
    FROM {_MIXED_RESULTS} r""",
)
def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of five types and an archive as a stream: half of them, then the others, which are
    added between two runs; the results beside the rows of the detections table."""
    root = scratch_path(spark, "stream-files")
    delete_on_exit(spark, root)
    files = _mixed_files(spark, sf_dir).withColumn("half", F.pmod(F.xxhash64("path"), F.lit(2)))
    for half in (0, 1):
        write_files(files.where(f"half = {half}"), f"{root}/in").write.format("noop").mode("overwrite").save()
        sanitize_file_stream(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", mode="pii").awaitTermination()
    results, detections = read_tables(spark, f"{root}/out")
    rows = detections.groupBy("path").agg(F.count(F.lit(1)).alias("detection_rows"))
    return results.join(rows, "path", "left").select(
        F.regexp_extract("path", "(/corpus/.*)$", 1).alias("path"),
        F.col("metadata.content_type").alias("content_type"),
        "content",
        F.col("detection_count").cast("long").alias("detection_count"),
        F.coalesce("detection_rows", F.lit(0)).alias("detection_rows"),
        F.col("metadata.error").alias("error"),
    )


@query(
    "private_use_text",
    """SELECT doc_id, concat(m, '[EMAIL_001]', m, n) AS content, cast(1 as bigint) AS detection_count
    FROM (SELECT doc_id, repeat(chr(57344), cast(doc_id % 5 as bigint)) || CASE WHEN doc_id % 2 = 0 THEN chr(57345) ELSE '' END
        AS m, chr(57344) AS n FROM documents) t""",
)
def private_use_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses between the characters that the engine marks matches with."""
    mark = F.lit("\ue000")
    m = F.concat(F.repeat(mark, F.col("doc_id") % 5), F.when(F.col("doc_id") % 2 == 0, F.lit("\ue001")).otherwise(F.lit("")))
    docs = table(spark, sf_dir, "documents", ["doc_id"])
    planted_texts = docs.select("doc_id", F.concat(m, F.lit("a@b.com"), m, mark).alias("text"))
    return _content(sanitize_table(planted_texts, mode="pii"), "doc_id")


_NULL_KEY = "CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id END"
_NULL_TURN = "CASE WHEN turn % 2 = 0 THEN NULL ELSE turn END"


@query(
    "sessions_null_keys",
    f"""SELECT coalesce(cast(conv_id as string), '') AS conv_id, coalesce(cast(turn as string), '') AS turn,
        concat(text, ' [EMAIL_001]') AS content, cast(1 as bigint) AS detection_count
    FROM (SELECT {_NULL_KEY} AS conv_id, {_NULL_TURN} AS turn, text, conv_id AS c, turn AS t
        FROM conversations) q""",
)
def sessions_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and places that are null; nothing stays as it was."""
    turns = table(spark, sf_dir, "conversations")
    keyed = turns.select(
        F.expr(_NULL_KEY).alias("conv_id"), F.expr(_NULL_TURN).alias("turn"), F.concat("text", F.lit(" a@b.com")).alias("text")
    )
    cfg = SanitizeConfig(mode="pii", enable_categories=("EMAIL",))
    out = sanitize_sessions(keyed, "text", ["conv_id"], "turn", config=cfg)
    return out.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("conv_id", "turn")],
        "content", F.col("detection_count").cast("long").alias("detection_count"),
    )


@query(
    "session_metrics",
    f"""SELECT 'EMAIL' AS category, cast(count(*) as bigint) AS hits, cast(count(DISTINCT conv_id) as bigint) AS docs,
        cast((SELECT count(*) FROM (SELECT DISTINCT conv_id, n FROM {_TURN_NUMBER} t)) as bigint) AS placeholders
    FROM {_TURN_NUMBER} t""",
)
def session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session of several turns is one document, whose turns share placeholders."""
    cfg = SanitizeConfig(mode="pii", enable_categories=("EMAIL",))
    out = sanitize_sessions(_planted_turns(spark, sf_dir), "text", ["conv_id"], "turn", config=cfg)
    return report.category_metrics(out, "conv_id")


@query(
    "custom_rules_long_runs",
    """SELECT doc_id, '[RUN] [RUN]' AS content, cast(2 as bigint) AS detection_count FROM documents""",
)
def custom_rules_long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeated group over runs that would overflow the JVM's stack."""
    docs = table(spark, sf_dir, "documents", ["doc_id"])
    runs = F.concat(F.repeat(F.lit("ab1"), (F.lit(4000) + F.col("doc_id") % 7).cast("int")), F.lit(" x9"))
    rule = CustomRule("run", r"(?:[a-z]|\d)+", "[RUN]")
    cfg = SanitizeConfig(mode="secrets_only", custom_rules=(rule,), enable_categories=("RUN",))
    return _content(sanitize_table(docs.select("doc_id", runs.alias("text")), config=cfg), "doc_id")


@query(
    "json_deep",
    """SELECT s_suppkey, concat(repeat('[', 20000), '{"k":"[EMAIL_001]","n":', cast(s_suppkey as string), '}', repeat(']', 20000)) AS content,
        '' AS warnings FROM supplier""",
)
def json_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents nested deeper than any call stack are walked like others."""
    nested = F.expr(
        """concat(repeat('[', 20000), '{"k": "s', s_suppkey, '@b.com", "n": ', s_suppkey, '}', repeat(']', 20000))"""
    )
    docs = table(spark, sf_dir, "supplier", ["s_suppkey"]).select("s_suppkey", nested.alias("text"))
    out = sanitize_structured(docs, "text", "json", mode="pii", key="s_suppkey")
    return out.select(
        "s_suppkey",
        F.regexp_replace("content", r"\s", "").alias("content"),
        F.array_join("warnings", "|").alias("warnings"),
    )


_ALIASES = "".join(f"r{i}: *{{anchor}}{{end}}" for i in range(30))


@query(
    "yaml_aliases",
    "SELECT s_suppkey, replace(concat('base: &id001~  mail: ''[EMAIL_001]''~  n: ', cast(s_suppkey as string), '~"
    + _ALIASES.format(anchor="id001", end="~")
    + "last: x [EMAIL_001]~'), '~', chr(10)) AS content, '' AS warnings FROM supplier",
)
def yaml_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anchor with many aliases: more leaves than the text has room for, walked once."""
    text = F.expr(
        "replace(concat('base: &b~  mail: s', s_suppkey, '@b.com~  n: ', s_suppkey, '~"
        + _ALIASES.format(anchor="b", end="~")
        + "last: x s', s_suppkey, '@b.com~'), '~', chr(10))"
    )
    docs = table(spark, sf_dir, "supplier", ["s_suppkey"]).select("s_suppkey", text.alias("text"))
    out = sanitize_structured(docs, "text", "yaml", mode="pii", key="s_suppkey")
    return out.select("s_suppkey", "content", F.array_join("warnings", "|").alias("warnings"))


@query(
    "session_audit",
    f"""SELECT conv_id, turn, '(text)' AS file, 'pii' AS mode, cast(1 as bigint) AS detections, 'EMAIL' AS categories
    FROM {_TURN_NUMBER} t""",
)
def session_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit rows of redacted sessions."""
    out = sanitize_sessions(_planted_turns(spark, sf_dir), "text", ["conv_id"], "turn", "pii")
    audit = report.audit_table(as_results(out, "pii"), ["conv_id", "turn"])
    return audit.withColumn("detections", F.col("detections").cast("long"))
