"""Pieces of the SQL that checks the queries in DuckDB.

Expected texts are composed from the planted values where possible. Only the
given free-text tables need patterns, written for RE2 (which has no lookaround).
"""

from __future__ import annotations

from hushlake.plans.corpora import confidential_sql, pii_sql, secrets_sql

MYKAD_OK = """(cast(substr(mykad, 3, 2) as int) BETWEEN 1 AND 12
    AND cast(substr(mykad, 5, 2) as int) BETWEEN 1 AND 31
    AND cast(substr(mykad, 8, 2) as int) BETWEEN 1 AND 99)"""

IBAN_OK = """(cast(concat('32142829', substr(iban, 9, 14), '1611', substr(iban, 3, 2))
    as hugeint) % 97 = 1)"""


def luhn_ok(value: str) -> str:
    digits = rf"regexp_replace({value}, '\D', '', 'g')"
    digit = f"cast(substr({digits}, i, 1) as int)"
    return f"""(length({digits}) BETWEEN 13 AND 19 AND
        list_sum(list_transform(range(1, length({digits}) + 1), lambda i:
            CASE WHEN (length({digits}) - i) % 2 = 1
                 THEN CASE WHEN 2 * {digit} > 9 THEN 2 * {digit} - 9 ELSE 2 * {digit} END
                 ELSE {digit} END)) % 10 = 0)"""


NAME_OK = "person <> 'Alice Tan'"
CARD_OK = luhn_ok("card")
PASSWORD_OK = "length(password) >= 6"

PII = f"(SELECT *, {MYKAD_OK} AS mykad_ok, {IBAN_OK} AS iban_ok, {CARD_OK} AS card_ok FROM ({pii_sql()}) p0)"
SECRETS = f"({secrets_sql()})"
CONFIDENTIAL = f"({confidential_sql()})"

PII_CONTENT = f"""concat('IC ', CASE WHEN mykad_ok THEN '[MYKAD_001]' ELSE mykad END,
    '; mail [EMAIL_001] and [EMAIL_001]; call [PHONE_001]; card ',
    CASE WHEN card_ok THEN '[CREDIT_CARD_001]' ELSE card END, '; pay ',
    CASE WHEN iban_ok THEN '[IBAN_001]' ELSE iban END, '; from ',
    CASE WHEN {NAME_OK} THEN '[NAME_001]' ELSE person END)"""
PII_COUNT = f"""cast(3 + CASE WHEN mykad_ok THEN 1 ELSE 0 END + CASE WHEN card_ok THEN 1 ELSE 0 END
    + CASE WHEN iban_ok THEN 1 ELSE 0 END + CASE WHEN {NAME_OK} THEN 1 ELSE 0 END as bigint)"""

SECRETS_CONTENT = f"""concat('key=[API_KEY_001]; token [JWT_001]; password: "',
    CASE WHEN {PASSWORD_OK} THEN '[PASSWORD_001]' ELSE password END,
    '"; Authorization: Bearer [AUTH_HEADER_001] [DB_URL_001] [PRIVATE_KEY_001]')"""
SECRETS_COUNT = f"cast(5 + CASE WHEN {PASSWORD_OK} THEN 1 ELSE 0 END as bigint)"


def detection_sql(corpus: str, category: str, before: str, value: str, confidence: float,
                  where: str = "true") -> str:
    """One detection per row: after the text ``before``, over ``value``."""
    return f"""SELECT doc_id, '{category}' AS category,
        cast(length({before}) as bigint) AS start_pos,
        cast(length({before}) + length({value}) as bigint) AS end_pos,
        cast({confidence} as double) AS confidence, '[{category}_001]' AS placeholder
        FROM {corpus} q WHERE {where}"""


# --- free text: emails and cards, the only built-in hits in the given tables --
_S = "chr(57344)"
_EMAIL = r"(^|[^\pL\pN_])([\pL\pN_.%+-]+@[\pL\pN_.-]+\.[\pL\pN_]{2,})"
_CARD = r"\b(?:\d[ -]*?){13,19}\b"


def free_text_parts(source: str, key: str, text: str, emails_only: bool = False) -> str:
    """CTEs ending in ``parts(key, idx, part, hit, category, start_pos, n)``."""
    cards = text if emails_only else (
        f"regexp_replace({text}, '{_CARD}', {_S} || '\\0' || {_S}, 'g')"
    )
    return f"""
    marked AS (SELECT {key} AS key, string_split(regexp_replace({cards},
        '{_EMAIL}', '\\1' || {_S} || '\\2' || {_S}, 'g'), {_S}) AS ps FROM {source}),
    cut AS (SELECT key, unnest(range(1, len(ps) + 1)) AS idx, unnest(ps) AS part FROM marked),
    placed AS (SELECT *,
        coalesce(sum(length(part)) OVER (PARTITION BY key ORDER BY idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos,
        CASE WHEN idx % 2 = 1 THEN NULL WHEN contains(part, '@') THEN 'EMAIL'
             WHEN {luhn_ok('part')} THEN 'CREDIT_CARD' END AS category FROM cut),
    firsts AS (SELECT key, category, part, dense_rank() OVER (
            PARTITION BY key, category ORDER BY min(start_pos)) AS n
        FROM placed WHERE category IS NOT NULL GROUP BY key, category, part),
    parts AS (SELECT p.*, f.n, f.n IS NOT NULL AS hit,
        printf('[%s_%03d]', p.category, f.n) AS placeholder
        FROM placed p LEFT JOIN firsts f USING (key, category, part))"""


def free_text_content(source: str, key: str, text: str) -> str:
    return f"""WITH {free_text_parts(source, key, text)}
    SELECT key AS {key},
        string_agg(CASE WHEN hit THEN placeholder ELSE part END, '' ORDER BY idx) AS content,
        cast(count(*) FILTER (WHERE hit) as bigint) AS detection_count
    FROM parts GROUP BY key"""
