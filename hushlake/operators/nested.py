"""Redact the string leaves of a nested column; keys and other types stay.

The column's type is known at plan time, so the walk is generated: leaves are
gathered into one array in visit order, redacted in one session, and put back by
position. No shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushlake.config import SanitizeConfig
from hushlake.functions.arrays import empty_array, let, literal, prefix_sums
from hushlake.functions.pin import other_columns
from hushlake.operators.redact import Settings, no_detections, with_leaf_detections
from hushlake.rules import selected_rules


def leaf_count(dtype: T.DataType) -> int | None:
    """Number of string leaves of a value; None if it varies from row to row."""
    if isinstance(dtype, T.StringType):
        return 1
    if isinstance(dtype, T.StructType):
        counts = [leaf_count(f.dataType) for f in dtype.fields]
        return None if None in counts else sum(counts)
    if isinstance(dtype, T.ArrayType | T.MapType):
        inner = dtype.elementType if isinstance(dtype, T.ArrayType) else dtype.valueType
        return 0 if leaf_count(inner) == 0 else None
    return 0


def _elements(expr: str, dtype: T.ArrayType | T.MapType) -> tuple[str, T.DataType]:
    if isinstance(dtype, T.ArrayType):
        return expr, dtype.elementType
    return f"map_values({expr})", dtype.valueType


def _field(expr: str, name: str) -> str:
    return expr + ".`" + name.replace("`", "``") + "`"


def count_sql(expr: str, dtype: T.DataType, depth: int = 0) -> str:
    fixed = leaf_count(dtype)
    if fixed is not None:
        return str(fixed)
    if isinstance(dtype, T.StructType):
        parts = [count_sql(_field(expr, f.name), f.dataType, depth) for f in dtype.fields]
        return "(" + " + ".join(parts) + ")"
    items, inner = _elements(expr, dtype)
    each = count_sql(f"wc{depth}", inner, depth + 1)
    total = f"aggregate({items}, 0, (wa{depth}, wc{depth}) -> wa{depth} + {each})"
    return f"coalesce({total}, 0)"


def gather_sql(expr: str, dtype: T.DataType, depth: int = 0) -> str:
    """All string leaves in visit order, nulls included."""
    if isinstance(dtype, T.StringType):
        return f"array({expr})"
    if isinstance(dtype, T.StructType):
        parts = [
            gather_sql(_field(expr, f.name), f.dataType, depth)
            for f in dtype.fields
            if leaf_count(f.dataType) != 0
        ]
        return f"concat({', '.join(parts)})"
    items, inner = _elements(expr, dtype)
    each = gather_sql(f"wg{depth}", inner, depth + 1)
    flat = f"flatten(transform({items}, wg{depth} -> {each}))"
    return f"coalesce({flat}, {empty_array('string')})"


def rebuild_sql(expr: str, dtype: T.DataType, leaves: str, base: str, depth: int = 0) -> str:
    """The value with its leaves taken from ``leaves``, starting at ``base``."""
    if leaf_count(dtype) == 0:
        return expr
    if isinstance(dtype, T.StringType):
        return f"get({leaves}, {base})"
    if isinstance(dtype, T.StructType):
        parts, at = [], base
        for f in dtype.fields:
            child = _field(expr, f.name)
            rebuilt = rebuild_sql(child, f.dataType, leaves, at, depth)
            parts.append(f"{literal(f.name)}, {rebuilt}")
            at = f"{at} + {count_sql(child, f.dataType, depth)}"
        return f"CASE WHEN {expr} IS NOT NULL THEN named_struct({', '.join(parts)}) END"
    items, inner = _elements(expr, dtype)
    e, i, offs = f"we{depth}", f"wi{depth}", f"wo{depth}"
    fixed = leaf_count(inner)
    if fixed is not None:
        body = rebuild_sql(e, inner, leaves, f"{base} + {i} * {fixed}", depth + 1)
        rebuilt = f"transform({items}, ({e}, {i}) -> {body})"
    else:
        body = rebuild_sql(e, inner, leaves, f"{base} + get({offs}, {i})", depth + 1)
        sizes = f"transform({items}, {e} -> {count_sql(e, inner, depth + 1)})"
        rebuilt = let(
            offs,
            f"CASE WHEN {expr} IS NOT NULL THEN {prefix_sums(sizes)} END",
            f"transform({items}, ({e}, {i}) -> {body})",
        )
    if isinstance(dtype, T.MapType):
        return f"map_from_arrays(map_keys({expr}), {rebuilt})"
    return rebuilt


def sanitize_nested(
    df: DataFrame,
    column: str,
    mode: str | None = None,
    config: Settings = None,
) -> DataFrame:
    """Redact ``column`` (struct, array or map) in place, one session per row.

    Adds ``detections``, ``detection_count``, ``categories`` and ``error``. A row
    whose leaves are longer than ``max_text_length`` in total fails closed: the
    column becomes null and ``error`` is set.
    """
    cfg = SanitizeConfig.resolve(config, mode)
    dtype = df.schema[column].dataType
    rules = selected_rules(cfg) if leaf_count(dtype) != 0 else []
    others = other_columns(df, column)
    if not rules:
        return df.select(
            *others,
            f"`{column}`",
            no_detections().alias("detections"),
            F.lit(0).alias("detection_count"),
            F.expr(empty_array("string")).alias("categories"),
            F.lit(None).cast("string").alias("error"),
        )
    # an internal name, which no lambda variable of the walk can hide
    df = df.withColumnRenamed(column, "__nested")
    quoted = "__nested"
    total = "aggregate(__all, 0L, (wt, ws) -> wt + coalesce(length(ws), 0))"
    gathered = df.withColumn("__all", F.expr(gather_sql(quoted, dtype))).withColumn(
        "error",
        F.when(F.expr(total) > cfg.max_text_length, F.lit("FileTooLargeError")),
    )
    worked = with_leaf_detections(
        gathered,
        F.when(F.col("error").isNull(), F.col("__all")),
        rules,
        "__out",
        "detections",
    )
    # bound once: inside a lambda the inlined column would run per element
    rebuilt = let("wout", "__out", rebuild_sql(quoted, dtype, "wout", "0"))
    return worked.select(
        *others,
        F.when(F.col("error").isNull(), F.expr(rebuilt)).alias(column),
        "detections",
        F.size("detections").alias("detection_count"),
        F.expr("array_sort(array_distinct(transform(detections, d -> d.category)))").alias(
            "categories"
        ),
        "error",
    )
