"""The redaction pipeline as projections over a text column: no shuffle.

hits -> overlap resolution -> numbering -> splice, one ``withColumn`` each, so
that Catalyst evaluates every step once. Intermediate columns hold raw values
and are dropped before the result is returned.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushlake.config import SanitizeConfig
from hushlake.functions.arrays import empty_array, let, literal_array, prefix_sums, struct
from hushlake.functions.pin import other_columns, pin
from hushlake.functions.validators import placeholder_sql
from hushlake.operators.hits import all_hits, python_cuts
from hushlake.operators.numbering import number_in_row
from hushlake.operators.overlap import resolve_overlaps
from hushlake.operators.splice import splice
from hushlake.rules import Rule, selected_rules

DETECTION = (
    "struct<leaf_ord:int,category:string,start:int,end:int,confidence:double,"
    "placeholder:string>"
)
METADATA = "struct<error:string,content_type:string,block_original_bytes:boolean>"
RESULT_COLUMNS = (
    "content", "detections", "warnings", "sanitized", "mode", "file_name",
    "metadata", "detection_count", "categories",
)

Settings = SanitizeConfig | Mapping[str, Any] | None


def kept_hits(text: str, rules: list[Rule], python: str | None = None) -> str:
    """Disjoint hits of one text; ``text`` should be a plain column name."""
    return let("found", all_hits(text, rules, python), resolve_overlaps("found"))


def with_kept(df: DataFrame, text: str, rules: list[Rule], kept: str = "__kept") -> DataFrame:
    """Add the disjoint hits of a text column."""
    cuts = python_cuts(F.col(text), rules)
    if cuts is None:
        return df.withColumn(kept, F.expr(kept_hits(text, rules)))
    cut = pin(df.withColumn("__cuts", cuts), "__cuts")
    return cut.withColumn(kept, F.expr(kept_hits(text, rules, "__cuts"))).drop("__cuts")


def _of_rule(values: list[Any], element_type: str, hit: str) -> str:
    return f"get({literal_array(values, element_type)}, {hit}.rule)"


def numbering_items(kept: str, rules: list[Rule], leaf: str = "0") -> str:
    """Hits in the shape ``number_in_row`` takes. Rules with a fixed replacement
    count under a name of their own, so they take no number of a category."""
    keys = [r.category if r.replacement is None else "=" + r.category for r in rules]
    item = struct(
        leaf=leaf,
        start="ih.start",
        end="ih.end",
        category=_of_rule(keys, "string", "ih"),
        value="ih.value",
    )
    return f"transform({kept}, ih -> {item})"


def detections_for(kept: str, numbers: str, rules: list[Rule], leaf: str = "0") -> str:
    """Value-free detections; ``numbers`` is aligned with ``kept``."""
    if not rules:
        return empty_array(DETECTION)
    category = _of_rule([r.category for r in rules], "string", "dh")
    token = placeholder_sql(category, "dn.number")
    if any(r.replacement is not None for r in rules):
        fixed = _of_rule([r.replacement for r in rules], "string", "dh")
        token = f"coalesce({fixed}, {token})"
    detection = struct(
        leaf_ord=leaf,
        category=category,
        start="dh.start",
        end="dh.end",
        confidence=_of_rule([r.confidence for r in rules], "double", "dh"),
        placeholder=token,
    )
    return f"zip_with({kept}, {numbers}, (dh, dn) -> {detection})"


def no_detections() -> Column:
    return F.expr(empty_array(DETECTION))


def admitted_text(text: Column, config: SanitizeConfig) -> Column:
    """The text, or null where it is too long to process.

    Bytes that are no UTF-8 become U+FFFD here: offsets are only defined on valid
    text. Valid text is passed on as it is.
    """
    valid = F.make_valid_utf8(text)
    if config.max_text_length == math.inf:
        return valid
    return F.when(F.length(text) <= config.max_text_length, valid)


def with_detections(
    df: DataFrame, text: Column, rules: list[Rule], content: str, detections: str
) -> DataFrame:
    """Add the redacted text and its detections for one text column."""
    if not rules:
        return df.withColumns({content: text, detections: no_detections()})
    marked = (
        with_kept(df.withColumn("__text", text), "__text", rules)
        .withColumn("__numbers", F.expr(number_in_row(numbering_items("__kept", rules))))
        .withColumn(detections, F.expr(detections_for("__kept", "__numbers", rules)))
        .drop("__kept", "__numbers")
    )
    # a filter on the result must not run the detectors again
    return (
        pin(marked, detections)
        .withColumn(content, F.expr(splice("__text", detections)))
        .drop("__text")
    )


def with_leaf_detections(
    df: DataFrame, leaves: Column, rules: list[Rule], content: str, detections: str
) -> DataFrame:
    """As ``with_detections`` for an array of texts that share one session.

    ``content`` becomes the array of redacted texts, ``detections`` the flat
    list over all of them, ordered by leaf and start.
    """
    if not rules:
        return df.withColumns({content: leaves, detections: no_detections()})
    items = f"flatten(transform(__kept, (lk, li) -> {numbering_items('lk', rules, 'li')}))"
    own = "slice(lbound.numbers, get(lbound.offsets, li) + 1, size(lk))"
    marks = f"transform(__kept, (lk, li) -> {detections_for('lk', own, rules, 'li')})"
    leaf_text = let("lm", "get(lbound, li)", splice("lt", "lm"))
    # What a lambda uses from outside is bound first. Catalyst may inline the
    # expression behind a column, and inside a lambda it would run per element.
    sizes = prefix_sums("transform(__kept, lk -> size(lk))")
    bound = struct(numbers="__numbers", offsets=sizes)
    df = df.withColumn("__leaves", F.transform(leaves, F.make_valid_utf8))
    cuts = python_cuts(F.col("__leaves"), rules, leaves=True)
    own_cuts = None
    if cuts is not None:
        df, own_cuts = pin(df.withColumn("__cuts", cuts), "__cuts"), "get(__cuts, lc)"
    worked = (
        df.withColumn(
            "__kept", F.expr(f"transform(__leaves, (lt, lc) -> {kept_hits('lt', rules, own_cuts)})")
        )
        .withColumn("__numbers", F.expr(number_in_row(items)))
        .withColumn("__marks", F.expr(let("lbound", bound, marks)))
        .withColumn(
            content,
            F.expr(let("lbound", "__marks", f"transform(__leaves, (lt, li) -> {leaf_text})")),
        )
        .withColumn(detections, F.coalesce(F.flatten("__marks"), no_detections()))
        .drop("__leaves", "__kept", "__numbers", "__marks", "__cuts")
    )
    return pin(worked, content, detections)


def result_columns(
    content: Column,
    detections: Column,
    warnings: Column,
    error: Column,
    mode: str,
    file_name: Column | None = None,
    content_type: Column | None = None,
    block_original_bytes: Column | None = None,
) -> dict[str, Column]:
    """The fixed result schema. A row with an error fails closed: empty content,
    no detections, and only the message as warning."""
    ok = error.isNull()
    null_text, null_bool = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    kept = F.when(ok, detections).otherwise(no_detections())
    return {
        "content": F.when(ok, content).otherwise(F.lit("")),
        "detections": kept,
        "warnings": warnings,
        "sanitized": ok if mode != "off" else F.lit(False),
        "mode": F.lit(mode),
        "file_name": F.lit("") if file_name is None else file_name,
        "metadata": F.struct(
            error.alias("error"),
            F.when(ok, null_text if content_type is None else content_type).alias(
                "content_type"
            ),
            F.when(ok, null_bool if block_original_bytes is None else block_original_bytes)
            .alias("block_original_bytes"),
        ),
        "detection_count": F.size(kept),
        "categories": F.array_sort(
            F.array_distinct(F.transform(kept, lambda d: d["category"]))
        ),
    }


def as_results(df: DataFrame, mode: str, content: str = "content") -> DataFrame:
    """Session, nested and declared outputs in the fixed result schema, for the reports.

    ``content`` names the redacted column; one that is no text becomes JSON. Other columns
    pass through.
    """
    given = F.col(f"`{content}`")
    if not isinstance(df.schema[content].dataType, T.StringType):
        given = F.to_json(given)
    warnings = F.col("warnings") if "warnings" in df.columns else F.expr(empty_array("string"))
    names = {content, "error", "warnings", *RESULT_COLUMNS}
    cols = result_columns(given, F.col("detections"), warnings, F.col("error"), mode)
    return df.select(*other_columns(df, *names), *[c.alias(n) for n, c in cols.items()])


def sanitize_table(
    df: DataFrame,
    text_col: str = "text",
    mode: str | None = None,
    config: Settings = None,
) -> DataFrame:
    """Redact a text column: one document per row, one session per row.

    The text column is replaced by the result columns; all others pass through.
    Works on batch and streaming DataFrames alike.
    """
    cfg = SanitizeConfig.resolve(config, mode)
    text = F.col(text_col)
    others = other_columns(df, text_col)
    null_error = F.lit(None).cast("string")
    if cfg.mode == "off":
        cols = result_columns(
            text, no_detections(), F.array(F.lit("mode=off")), null_error, "off"
        )
        return df.select(*others, *[c.alias(n) for n, c in cols.items()])

    rules = selected_rules(cfg)
    worked = with_detections(
        df.withColumn("__long", F.length(text) > cfg.max_text_length),
        admitted_text(text, cfg),
        rules,
        "__content",
        "__detections",
    )
    too_long = F.coalesce(F.col("__long"), F.lit(False))
    error = F.when(too_long, F.lit("FileTooLargeError"))
    warnings = F.when(
        too_long, F.array(F.lit(f"Text exceeds max_text_length={cfg.max_text_length}"))
    ).otherwise(F.expr(empty_array("string")))
    cols = result_columns(
        F.col("__content"), F.col("__detections"), warnings, error, cfg.mode
    )
    return worked.select(*others, *[c.alias(n) for n, c in cols.items()])
