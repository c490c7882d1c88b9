"""The rule catalogue and its selection.

Rules are chosen on the driver, so a rule that is not selected never enters the
plan. Patterns are literals: Spark compiles a literal pattern once per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.config import MODES, SanitizeConfig
from hushlake.functions import validators
from hushlake.functions.dialect import (
    BOUNDARY,
    DIGIT,
    NOT_AFTER_WORD,
    NOT_BEFORE_WORD,
    SPACE,
    SPACE_CHARS,
    WORD,
    WORD_CHARS,
    UnsupportedPatternError,
    python_pattern_to_java,
)


@dataclass(frozen=True)
class Rule:
    """One detector.

    ``group`` 0 replaces the whole match. ``group`` 2 replaces only the second
    capture; the first one is then the prefix that stays, and an empty second one is
    no match: so a pattern may step over a run in which it cannot match, instead of
    trying every place in it. ``engine`` is "python" for custom patterns that
    java.util.regex cannot express or would need its stack for. ``any_of`` are
    literals of which every match contains at least one, ``needs_digits`` says
    that every match holds ``DIGIT_RUN``: both are cheap tests that let a row
    skip the pattern.
    """

    category: str
    tier: str
    confidence: float
    pattern: str
    group: int = 0
    any_of: tuple[str, ...] = ()
    needs_digits: bool = False
    validator: str | None = None
    replacement: str | None = None
    engine: str = "jvm"


# Eight digits with nothing but spaces or hyphens in between: the least that
# any card, national id, phone, account or long number contains.
DIGIT_RUN = rf"{DIGIT}(?:[{SPACE_CHARS}-]*{DIGIT}){{7}}"

_TOKEN = r"(?:[A-Z][A-Za-z'`.-]*)"

_PEM_HEAD = "-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"
_PEM = rf"{_PEM_HEAD}[\s\S]+?-----END (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"
_JWT = rf"eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}{BOUNDARY}"

# --- Fixed values -----------------------------------------------------------
# Category, tier, confidence and grammar of the built-in detectors, in
# collection order. These decide results and must not change. They are written
# for java.util.regex with Python's word, digit and space classes spelled out;
# `(?=...)` in front only lets the matcher fail early.
BUILTIN_RULES: tuple[Rule, ...] = (
    Rule(
        "PRIVATE_KEY", "secrets_only", 0.99,
        # a head without an end has none for later heads either: step over the rest
        rf"(?:(?={_PEM})|({_PEM_HEAD}[\s\S]*+))({_PEM})?+",
        group=2,
        any_of=("PRIVATE KEY-----",),
    ),
    Rule(
        "JWT", "secrets_only", 0.98,
        # where the first head of a run fails, so do all others in the run
        rf"{NOT_AFTER_WORD}(?:(?={_JWT})|(eyJ[A-Za-z0-9_-]*+))({_JWT})?+",
        group=2,
        any_of=("eyJ",),
    ),
    Rule(
        "API_KEY", "secrets_only", 0.98,
        rf"(?=[sgxAhn]){NOT_AFTER_WORD}(?:sk-(?:proj-|ant-)?[A-Za-z0-9_-]{{16,}}"
        r"|ghp_[A-Za-z0-9]{20,}"
        r"|github_pat_[A-Za-z0-9_]{20,}"
        r"|xox[baprs]-[A-Za-z0-9-]{10,}"
        r"|AKIA[0-9A-Z]{16}"
        r"|AIza[0-9A-Za-z_-]{20,}"
        r"|xai-[A-Za-z0-9_-]{20,}"
        r"|hf_[A-Za-z0-9]{20,}"
        rf"|ntn_[A-Za-z0-9]{{20,}}){BOUNDARY}",
        any_of=("sk-", "ghp_", "github_pat_", "xox", "AKIA", "AIza", "xai-", "hf_", "ntn_"),
    ),
    Rule(
        "PASSWORD", "secrets_only", 0.92,
        rf"(?=[PpSsCc\x{{17f}}])((?iu:password|passwd|pwd|secret|client_secret)"
        rf"{SPACE}*[:=]{SPACE}*[\"']?)([^{SPACE_CHARS}\"']{{6,}})",
        group=2,
        any_of=(":", "="),
    ),
    Rule(
        "AUTH_HEADER", "secrets_only", 0.97,
        rf"(?=[Aa])((?iu:Authorization){SPACE}*:{SPACE}*(?iu:Bearer|Basic){SPACE}+)"
        rf"([^{SPACE_CHARS}]+)",
        group=2,
        any_of=(":",),
    ),
    Rule(
        "DB_URL", "secrets_only", 0.95,
        rf"{NOT_AFTER_WORD}(?iu:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)"
        rf"://[^{SPACE_CHARS}\"']+",
        any_of=("://",),
    ),
    Rule(
        "EMAIL", "pii", 0.99,
        # a run of local characters is entered at its start, or one character after the last match
        rf"{NOT_AFTER_WORD}(?:(?<![{WORD_CHARS}.%+-])|(?<=\G[.%+-]))[{WORD_CHARS}.%+-]++@[{WORD_CHARS}.-]+\.{WORD}{{2,}}{NOT_BEFORE_WORD}",
        any_of=("@",),
    ),
    Rule(
        "MYKAD", "pii", 0.95,
        rf"(?={DIGIT}){NOT_AFTER_WORD}{DIGIT}{{6}}-?{DIGIT}{{2}}-?{DIGIT}{{4}}{NOT_BEFORE_WORD}",
        needs_digits=True,
        validator="mykad",
    ),
    Rule(
        "IBAN", "pii", 0.96,
        rf"(?=[A-Z]){NOT_AFTER_WORD}[A-Z]{{2}}{DIGIT}{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}"
        rf"(?:[ ]?[A-Z0-9]{{1,4}})?{NOT_BEFORE_WORD}",
        validator="iban",
    ),
    Rule(
        "CREDIT_CARD", "pii", 0.94,
        rf"(?={DIGIT}){NOT_AFTER_WORD}(?:{DIGIT}[ -]*?){{13,19}}{BOUNDARY}",
        needs_digits=True,
        validator="card",
    ),
    Rule(
        "PHONE", "pii", 0.90,
        rf"(?=[+0]){NOT_AFTER_WORD}"
        rf"(?:\+60[{SPACE_CHARS}-]?(?:1[0-9]|[3-9])[{SPACE_CHARS}-]?{DIGIT}{{3,4}}"
        rf"[{SPACE_CHARS}-]?{DIGIT}{{3,4}}"
        rf"|0(?:1[0-9]|[3-9]{DIGIT})[{SPACE_CHARS}-]?{DIGIT}{{3,4}}"
        rf"[{SPACE_CHARS}-]?{DIGIT}{{3,4}}"
        rf"|\+[1-9]{DIGIT}{{7,14}}){NOT_BEFORE_WORD}",
        needs_digits=True,
    ),
    Rule(
        "NAME", "pii", 0.93,
        rf"(?=[A-Z]){NOT_AFTER_WORD}{_TOKEN}(?:{SPACE}+{_TOKEN}){{0,6}}"
        rf"{SPACE}+(?:BIN|BINTI|Bin|Binti|bin|binti|BT\.?|BTE\.?|Bt\.?|Bte\.?){SPACE}+"
        rf"{_TOKEN}(?:{SPACE}+{_TOKEN}){{0,4}}{BOUNDARY}",
        any_of=("BIN", "Bin", "bin", "BT", "Bt"),
    ),
    Rule(
        "NAME", "pii", 0.92,
        rf"(?=[A-Z]){NOT_AFTER_WORD}{_TOKEN}(?:{SPACE}+{_TOKEN}){{0,4}}"
        rf"{SPACE}+A/[LPlp]{SPACE}+"
        rf"{_TOKEN}(?:{SPACE}+{_TOKEN}){{0,4}}{BOUNDARY}",
        any_of=("A/L", "A/P", "A/l", "A/p"),
    ),
    Rule(
        "AMOUNT", "confidential", 0.88,
        rf"(?=[RMrm]){NOT_AFTER_WORD}(?:"
        rf"(?iu:RM|MYR){SPACE}?{DIGIT}{{1,3}}(?:,{DIGIT}{{3}})*(?:\.{DIGIT}{{2}})?{NOT_BEFORE_WORD}"
        rf"|(?iu:RM|MYR){SPACE}?{DIGIT}+(?:\.{DIGIT}{{2}})?{NOT_BEFORE_WORD})",
    ),
    Rule(
        "ACCOUNT_NUMBER", "confidential", 0.86,
        rf"(?=[Aa]){NOT_AFTER_WORD}((?iu:account|acct|a/c)[{SPACE_CHARS}#:.-]*)"
        rf"({DIGIT}{{8,20}}){NOT_BEFORE_WORD}",
        group=2,
        needs_digits=True,
    ),
    Rule(
        "INTERNAL_URL", "strict", 0.87,
        rf"{NOT_AFTER_WORD}https?://(?:localhost|127\.0\.0\.1"
        rf"|10\.{DIGIT}+\.{DIGIT}+\.{DIGIT}+|192\.168\.{DIGIT}+\.{DIGIT}+"
        rf"|[{WORD_CHARS}.-]+\.internal)(?::{DIGIT}+)?(?:/[^{SPACE_CHARS}\"']*)?",
        any_of=("http://", "https://"),
    ),
    Rule(
        "LONG_NUMBER", "strict", 0.86,
        rf"(?={DIGIT}){NOT_AFTER_WORD}{DIGIT}{{10,}}{NOT_BEFORE_WORD}",
        needs_digits=True,
    ),
)
# --- End of fixed values ----------------------------------------------------

VALIDATORS = {
    "card": validators.luhn_sql,
    "iban": validators.iban_sql,
    "mykad": validators.mykad_sql,
}

KNOWN_CATEGORIES: tuple[str, ...] = tuple(sorted({r.category for r in BUILTIN_RULES}))


def custom_rules(config: SanitizeConfig) -> list[Rule]:
    """Custom rules as catalogue rules; patterns Python rejects are dropped."""
    out = []
    for rule in config.custom_rules:
        engine = "jvm"
        try:
            pattern = python_pattern_to_java(rule.pattern)
        except UnsupportedPatternError:
            pattern, engine = rule.pattern, "python"
        if pattern is not None:
            out.append(
                Rule(rule.category, "custom", rule.confidence, pattern,
                     replacement=rule.replacement, engine=engine)
            )
    return out


def selected_rules(config: SanitizeConfig) -> list[Rule]:
    """Rules for one run in collection order: custom first, then by tier.

    Mode tiers are cumulative, category lists apply to built-in rules only, and
    the confidence threshold (equal passes) applies to every rule.
    """
    if config.mode == "off":
        return []
    builtin = [
        r
        for r in BUILTIN_RULES
        if MODES.index(r.tier) <= config.mode_rank and config.allows(r.category)
    ]
    return [
        r
        for r in custom_rules(config) + builtin
        if r.confidence >= config.confidence_threshold
    ]


def tie_ranks(rules: list[Rule]) -> list[int]:
    """Rank of each rule among hits of equal span: confidence, then order."""
    order = sorted(range(len(rules)), key=lambda i: (-rules[i].confidence, i))
    ranks = [0] * len(rules)
    for rank, i in enumerate(order):
        ranks[i] = rank
    return ranks


def rules_table(spark: SparkSession) -> DataFrame:
    """The built-in catalogue as a table (no patterns)."""
    rows = [
        (i + 1, MODES.index(r.tier), r.tier, r.category, r.confidence, r.group)
        for i, r in enumerate(BUILTIN_RULES)
    ]
    return spark.createDataFrame(
        rows,
        "rule_ord int, tier_rank int, tier string, category string, "
        "confidence double, span_group int",
    )


def select_rules_table(rules: DataFrame, config: SanitizeConfig) -> DataFrame:
    """The relational form of ``selected_rules`` over ``rules_table``."""
    out = rules.where(F.col("tier_rank") <= config.mode_rank)
    out = out.where(F.col("confidence") >= config.confidence_threshold)
    if config.mode == "off":
        out = out.where(F.lit(False))
    if config.disable_categories:
        out = out.where(~F.col("category").isin(*config.disable_categories))
    if config.enable_categories:
        out = out.where(F.col("category").isin(*config.enable_categories))
    return out
