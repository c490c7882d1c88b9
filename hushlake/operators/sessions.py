"""Redaction with a placeholder session that spans rows.

Used for conversations (one session over all turns) and for leaf tables. Hits are
found per row, numbered across the rows of a session, and brought back to their
row. A session may be of any size: see ``number_sessions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.config import SanitizeConfig
from hushlake.functions.arrays import literal_array, struct
from hushlake.functions.pin import other_columns, pin
from hushlake.functions.validators import placeholder
from hushlake.operators.numbering import null_safe_join, number_sessions
from hushlake.operators.redact import (
    Settings,
    admitted_text,
    no_detections,
    with_kept,
)
from hushlake.operators.splice import splice
from hushlake.rules import Rule, selected_rules
from hushlake.sources.scratch import written


_ROW_HIT = "struct<start:int,end:int,category:string,confidence:double,fixed:string,value:string>"


def found_hits(df: DataFrame, text_col: str, keys: list[str], rules: list[Rule]) -> DataFrame:
    """``keys`` and the kept ``hits`` of every row, also of rows without any. Values are
    hashed: numbering needs no more than their equality."""

    def of_rule(values: list, dtype: str) -> str:
        return f"get({literal_array(values, dtype)}, h.rule)"

    fields = struct(
        start="h.start",
        end="h.end",
        category=of_rule([r.category for r in rules], "string"),
        confidence=of_rule([r.confidence for r in rules], "double"),
        fixed=of_rule([r.replacement for r in rules], "string"),
        value="sha2(h.value, 256)",
    )
    kept = df.select(*keys, F.col(text_col).alias("__text"))
    kept = with_kept(kept, "__text", rules)
    hits = F.expr(f"cast(transform(__kept, h -> {fields}) as array<{_ROW_HIT}>)")
    return pin(kept.drop("__text"), "__kept").select(*keys, hits.alias("hits"))


def hit_rows(found: DataFrame, keys: list[str]) -> DataFrame:
    """Kept hits as rows: keys, start, end, category, confidence, fixed, value."""
    return found.select(*keys, F.explode("hits").alias("h")).select(*keys, "h.*")


def sanitize_sessions(
    df: DataFrame,
    text_col: str,
    session: list[str],
    order: str,
    mode: str | None = None,
    config: Settings = None,
) -> DataFrame:
    """Redact ``text_col``; equal values share a placeholder within a session.

    ``order`` is a whole number that places rows within their session; null keys and
    null orders are like any other. Rows over a length limit of ``config`` get an empty
    text and ``error``. Hits are found once and written to the scratch folder, with hashed
    values; a row that the join does not find there again fails closed.
    """
    cfg = SanitizeConfig.resolve(config, mode)
    rules = selected_rules(cfg)
    # rows that share session and order are told apart by their text
    keys = [*session, order, "__row"]
    others = other_columns(df, text_col)
    too_long = F.coalesce(F.length(text_col) > F.lit(cfg.max_text_length), F.lit(False))
    base = df.withColumn(
        "error", F.when(too_long, F.lit("FileTooLargeError"))
    ).withColumn("__text", admitted_text(F.col(text_col), cfg))
    base = base.withColumn("__row", F.coalesce(F.xxhash64(text_col), F.lit(0)))
    if not rules:
        return base.select(
            *others,
            F.when(too_long, F.lit("")).otherwise(F.col(text_col)).alias("content"),
            no_detections().alias("detections"),
            F.lit(0).alias("detection_count"),
            "error",
        )
    found = written(found_hits(base, "__text", keys, rules), "session-hits")
    hits = hit_rows(found, keys)
    numbers = number_sessions(hits.where(F.col("fixed").isNull()), session, order)
    tagged = null_safe_join(hits, numbers, [*session, "category", "value"], "left").select(
        *keys,
        F.struct(
            F.lit(0).alias("leaf_ord"),
            "category",
            "start",
            "end",
            "confidence",
            F.coalesce("fixed", placeholder("category", "number")).alias("placeholder"),
        ).alias("d"),
    )
    by_start = "transform(sort_array(collect_set(struct(d.start, d.end, d))), x -> x.d)"
    # every row has an entry, with the number of its hits: what is missing was lost
    expected = found.groupBy(*keys).agg(F.max(F.size("hits")).alias("__expected"))
    per_row = tagged.groupBy(*keys).agg(F.expr(by_start).alias("detections"))
    known = null_safe_join(expected, per_row, keys, "left").withColumn(
        "detections", F.coalesce("detections", no_detections())
    )
    whole = F.coalesce(F.size("detections") == F.col("__expected"), F.lit(False))
    numbered = ~F.exists("detections", lambda d: d["placeholder"].isNull())
    joined = (
        null_safe_join(base, known, keys, "left")
        .withColumn("error", F.coalesce("error", F.when(~(whole & numbered), F.lit("UnmatchedRowError"))))
        .withColumn("detections", F.when(F.col("error").isNull(), F.col("detections")).otherwise(no_detections()))
    )
    return joined.select(
        *others,
        F.when(F.col("error").isNotNull(), F.lit(""))
        .otherwise(F.expr(splice("__text", "detections")))
        .alias("content"),
        "detections",
        F.size("detections").alias("detection_count"),
        "error",
    )
