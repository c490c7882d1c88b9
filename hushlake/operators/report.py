"""Value-free outputs: records, detections, audit rows, metrics, leak check."""

from __future__ import annotations

import sys
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.config import SanitizeConfig
from hushlake.functions.pin import pin
from hushlake.operators.redact import Settings, with_kept
from hushlake.rules import KNOWN_CATEGORIES, selected_rules

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def detections_table(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per detection, in order; never a value."""
    return results.select(*keys, F.posexplode("detections").alias("det_ord", "d")).select(
        *keys, "det_ord", "d.*"
    )


def result_payload(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The machine-readable record of each document, ready for ``write.json``."""
    return results.select(
        *(keys or []),
        F.col("file_name").alias("file"),
        "mode",
        "sanitized",
        F.col("detection_count").alias("detections"),
        "categories",
        "warnings",
        "metadata",
        "content",
    )


def write_payload(results: DataFrame, path: str, keys: list[str] | None = None) -> None:
    result_payload(results, keys).write.mode("errorifexists").json(path)


def write_detections(results: DataFrame, path: str, keys: list[str]) -> None:
    detections_table(results, keys).write.mode("errorifexists").parquet(path)


def audit_table(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What may be logged: file, mode, number of detections, category names."""
    names = F.array_join("categories", ",")
    return results.select(
        *(keys or []),
        F.when(F.col("file_name") == "", F.lit("(text)")).otherwise(F.col("file_name")).alias("file"),
        "mode",
        F.col("detection_count").alias("detections"),
        F.when(names == "", F.lit("none")).otherwise(names).alias("categories"),
    )


def warning_rows(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per document and warning."""
    return results.select(
        *(keys or []),
        F.when(F.col("file_name") == "", F.lit("(text)")).otherwise(F.col("file_name")).alias("file"),
        F.explode("warnings").alias("detail"),
    )


def category_metrics(results: DataFrame, key: str | list[str]) -> DataFrame:
    """Hits, documents and distinct placeholders per category over a corpus.

    ``key`` names a document (a session, where its rows share placeholders). Rows are
    counted by themselves first; a document of several rows is put together by (key,
    category, placeholder), so what is shuffled are counts, never texts.
    """
    keys = [key] if isinstance(key, str) else list(key)
    per_row = results.select(
        *keys,
        F.explode(
            F.expr(
                """transform(array_distinct(transform(detections, d -> struct(d.category, d.placeholder))),
                    p -> struct(p.category as category, p.placeholder as placeholder, size(filter(detections,
                        d -> d.category = p.category and d.placeholder = p.placeholder)) as hits))"""
            )
        ).alias("m"),
    )
    per_placeholder = per_row.groupBy(*keys, "m.category", "m.placeholder").agg(F.sum("m.hits").alias("hits"))
    per_doc = per_placeholder.groupBy(*keys, "category").agg(
        F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("placeholders")
    )
    return per_doc.groupBy("category").agg(
        F.sum("hits").alias("hits"),
        F.count(F.lit(1)).alias("docs"),
        F.sum("placeholders").alias("placeholders"),
    )


def category_catalogue(spark: SparkSession) -> DataFrame:
    """The known categories in order."""
    return spark.createDataFrame([(c,) for c in KNOWN_CATEGORIES], "category string")


def catalogue_with_metrics(spark: SparkSession, metrics: DataFrame) -> DataFrame:
    """Every known category with its metrics, 0 where nothing was found, and every
    category of custom rules that has metrics. A row per category on either side."""
    zero = {"hits": 0, "docs": 0, "placeholders": 0}
    return category_catalogue(spark).join(metrics, "category", "full").na.fill(zero).orderBy("category")


def _found_again(contents: pa.Array, hits: pa.Array) -> pa.Array:
    """For each row, the rules and numbers of distinct hit values that the content holds."""
    out = []
    for content, values in zip(contents.to_pylist(), hits.to_pylist(), strict=True):
        wanted = {(h["value"], h["rule"]) for h in values or () if h["value"]}
        held = _present({value for value, _ in wanted}, content or "")
        found = Counter(rule for value, rule in wanted if value in held)
        out.append([{"rule": rule, "n": n} for rule, n in sorted(found.items())])
    return pa.array(out, pa.list_(pa.struct([("rule", pa.int32()), ("n", pa.int64())])))


def _present(values: set[str], content: str) -> set[str]:
    """The values that occur in the content, by one pass where there are many."""
    if len(values) > 64:
        try:
            import ahocorasick
        except ImportError:
            pass
        else:
            automaton = ahocorasick.Automaton()
            for value in values:
                automaton.add_word(value, value)
            automaton.make_automaton()
            return {value for _, value in automaton.iter(content)}
    return {value for value in values if value in content}


def leak_check(
    results: DataFrame,
    keys: list[str],
    text_col: str = "text",
    mode: str | None = None,
    config: Settings = None,
    content_col: str = "content",
) -> DataFrame:
    """Rows whose redacted content still holds the value of one of their hits.

    ``results`` has the text as it was beside the content that is to be given out.
    Only spans are replaced, so a value may also occur elsewhere as ordinary prose.
    Reports ``category`` and number of such distinct values, never the value. Hits
    with a fixed replacement are left out. A row is checked by itself: no shuffle.
    """
    cfg = SanitizeConfig.resolve(config, mode)
    rules = selected_rules(cfg)
    flags = ", ".join(str(r.replacement is None).lower() for r in rules) or "true"
    numbered = f"transform(filter(__kept, h -> get(array({flags}), h.rule)), h -> struct(h.rule, h.value))"
    both = results.select(
        *keys, F.make_valid_utf8(text_col).alias("__text"), F.col(content_col).alias("__content")
    )
    worked = with_kept(both, "__text", rules)
    hits = pin(worked, "__kept").select(*keys, "__content", F.expr(numbered).alias("__hits")).where("size(__hits) > 0")
    find = F.arrow_udf(_found_again, "array<struct<rule: int, n: bigint>>")
    names = ", ".join(f"'{r.category}'" for r in rules) or "''"
    return (
        hits.select(*keys, F.explode(find("__content", "__hits")).alias("l"))
        .select(*keys, F.expr(f"get(array({names}), l.rule)").alias("category"), F.col("l.n").alias("leaked_values"))
    )
