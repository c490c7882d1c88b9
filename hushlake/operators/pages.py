"""Assemble documents from a table of page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.config import SanitizeConfig
from hushlake.operators.media import IMAGE_MARKER, is_blank

# --- Fixed values -----------------------------------------------------------
PAGE_IMAGE_WARNING = "[UNSANITIZED_IMAGE_CONTENT] PDF may contain embedded images"
PAGE_FAILED_WARNING = "Failed to extract text from PDF page "
PAGE_GAP = "\n\n"
# --- End of fixed values ----------------------------------------------------

# Pages joined in one step. A document is put together from runs of this many.
RUN_PAGES = 256
# Copies of the (few) oversized documents in the anti join, so that the pages of
# one huge document are spread over as many tasks.
SALTS = 32


def assemble_pages(
    pages: DataFrame,
    doc: str,
    config: SanitizeConfig,
    page_no: str = "page_no",
    text: str = "text",
    has_images: str = "has_images",
    failed: str = "failed",
) -> DataFrame:
    """One row per document: ``text, warnings, error``.

    Non-blank pages in page order, a blank line between them; a warning per failed
    page and one for embedded images, in order of first appearance; with images a
    marker is appended. A document over ``max_text_length`` fails closed: its size
    is summed first, and its pages are dropped before anything is collected, so no
    group in memory grows beyond the limit.
    """
    body = F.when(F.col(failed), F.lit("")).otherwise(F.coalesce(F.col(text), F.lit("")))
    rows = pages.select(
        F.col(doc).alias("doc"),
        F.col(page_no).cast("long").alias("page_no"),
        F.when(~is_blank(body), body).alias("body"),
        F.coalesce(F.col(has_images), F.lit(False)).alias("image"),
        F.coalesce(F.col(failed), F.lit(False)).alias("failed"),
    )
    gap, marker = len(PAGE_GAP), len(PAGE_GAP + IMAGE_MARKER)
    n_pages = F.count("body")
    size = (
        F.coalesce(F.sum(F.length("body")), F.lit(0))
        + F.greatest(n_pages - 1, F.lit(0)) * gap
        + F.when(F.max("image"), F.lit(marker)).otherwise(F.lit(0))
    )
    oversized = (
        rows.groupBy("doc").agg(size.alias("n_chars")).where(F.col("n_chars") > config.max_text_length)
    ).select("doc")
    salted = oversized.select(
        "doc", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    kept = rows.withColumn("salt", F.pmod(F.xxhash64("page_no"), F.lit(SALTS)).cast("int")).join(
        salted, ["doc", "salt"], "left_anti"
    )
    page_warnings = F.array_compact(
        F.array(
            F.when(F.col("failed"), F.concat(F.lit(PAGE_FAILED_WARNING), F.col("page_no"))),
            F.when(F.col("image"), F.lit(PAGE_IMAGE_WARNING)),
        )
    )
    page = F.struct(
        "page_no", "body", "image", page_warnings.alias("warnings")
    )
    # runs of pages first: small groups, and far fewer rows for the second step
    runs = (
        kept.withColumn("run", F.expr(f"page_no div {RUN_PAGES}"))
        .groupBy("doc", "run")
        .agg(F.sort_array(F.collect_list(page)).alias("pages"))
        .select(
            "doc",
            "run",
            F.expr("filter(transform(pages, p -> p.body), b -> b IS NOT NULL)").alias("bodies"),
            F.expr("array_distinct(flatten(transform(pages, p -> p.warnings)))").alias("warnings"),
            F.expr("exists(pages, p -> p.image)").alias("image"),
        )
        .select(
            "doc",
            F.struct(
                "run",
                F.when(F.size("bodies") > 0, F.array_join("bodies", PAGE_GAP)).alias("body"),
                "warnings",
                "image",
            ).alias("r"),
        )
    )
    docs = (
        runs.groupBy("doc")
        .agg(F.sort_array(F.collect_list("r")).alias("runs"))
        .select(
            "doc",
            F.expr("exists(runs, r -> r.image)").alias("image"),
            # array_join skips runs without text
            F.expr(
                f"array_join(transform(runs, r -> r.body), '{PAGE_GAP}')".replace("\n", "\\n")
            ).alias("body"),
            F.expr("array_distinct(flatten(transform(runs, r -> r.warnings)))").alias("warnings"),
        )
        .select(
            F.col("doc").alias(doc),
            F.when(F.col("image"), F.concat("body", F.lit(PAGE_GAP + IMAGE_MARKER)))
            .otherwise(F.col("body"))
            .alias("text"),
            "warnings",
            F.lit(None).cast("string").alias("error"),
        )
    )
    rejected = oversized.select(
        F.col("doc").alias(doc),
        F.lit("").alias("text"),
        F.array(
            F.lit(f"Extracted text exceeds max_text_length={config.max_text_length}")
        ).alias("warnings"),
        F.lit("FileTooLargeError").alias("error"),
    )
    return docs.unionByName(rejected)
