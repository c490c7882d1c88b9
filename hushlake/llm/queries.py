"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hushlake.llm.chunks import repeated_passages
from hushlake.llm.decontamination import benchmark_overlaps
from hushlake.llm.filter_audit import audit_filters
from hushlake.llm.html_text import extract_text
from hushlake.llm.licenses import scan_licenses
from hushlake.llm.near_dup import near_duplicates
from hushlake.llm.oracles import FILTER_AUDIT, NEAR_DUPLICATES, PREFIX_TRIE, secret_scan_sql
from hushlake.llm.packing import pack_documents
from hushlake.llm.prefix_trie import prefix_trie
from hushlake.llm.quality import quality
from hushlake.llm.secrets import scan_secrets
from hushlake.llm.simhash import simhash_components
from hushlake.llm.tables import table
from hushlake.llm.toxicity import toxicity_scores
from hushlake.llm.url_filter import judge_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The others learn models, vote, tokenise or parse; tests hold them against plain versions.
ORACLES: dict[str, str] = {
    "op5_secret_scan": secret_scan_sql(),
    "op6_minhash_near_dedup": NEAR_DUPLICATES,
    "op11_conversation_prefix_trie": PREFIX_TRIE,
    "op12_filter_interaction_audit": FILTER_AUDIT,
}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the 1024 tokens bind here: the capacities for documents and attention cost are slack by default."""
    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_key")


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


@query
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


@query
def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
