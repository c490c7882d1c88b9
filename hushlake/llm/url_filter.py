"""URL verdicts: a rule list first, gradient-boosted trees for the rest.

A rule is a host and a path; it fits the host and all subdomains where the path starts with
the rule's, and the longest fitting rule wins. URLs that a rule decides are the labelled
ones: a bounded sample of them, by hash order, trains boosted trees on lexical features and
on suffix statistics (how many labelled URLs of a registrable name were blocked, smoothed
towards the overall share). All labelled URLs enter the statistics, but a training row takes
those of the other folds, so that its own label, and those of equal URLs, say nothing about it.
The trees judge the URLs that no rule decides, inside Spark's own plan. Of equally long rules
that fit, the last given wins.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and
is judged by the trees on zero lengths; with labels of one class only, that class is the verdict
of all others; without labels it is ``allow``. Repeated rows each get their verdict.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.llm.html_text import host_of
from hushlake.llm.tables import pick, written

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labelled URLs that train the trees.
TRAINING_ROWS = 20_000
TREES, DEPTH = 15, 4
SMOOTHING = 20.0
#: A URL's fold is a hash of it.
FOLDS = 5

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "n_params", "query_length",
    "n_labels", "longest_label", "n_hyphens", "has_fragment", "has_extension", "is_secure", "suffix_rate", "suffix_count",
)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _decide(rules: tuple[tuple[str, str], ...], host: str, path: str) -> Column:
    """``struct(rule, verdict)`` of the longest fitting rule, or null. Rules are a short list of the caller."""
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = (F.col(host) == name) | F.endswith(F.col(host), F.lit("." + name))
        fits = fits & F.startswith(F.col(path), F.lit(slash + rest))
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _entropy(text: str) -> Column:
    """Entropy of a short string's characters, in bits."""
    return F.expr(
        f"""get(transform(array(filter(split({text}, ''), c -> c <> '')), cs -> aggregate(array_distinct(cs), 0D,
            (s, c) -> s - size(filter(cs, x -> x = c)) / size(cs) * log2(size(filter(cs, x -> x = c)) / size(cs)))), 0)"""
    )


def lexical(urls: DataFrame) -> DataFrame:
    """``urls(url, host, path, ...)`` with the lexical features and the registrable ``suffix``."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    count = lambda text, pattern: F.char_length(F.regexp_replace(text, f"[^{pattern}]", "")).cast("double")
    return urls.select(
        "*",
        F.char_length(url).cast("double").alias("url_length"),
        F.char_length(host).cast("double").alias("host_length"),
        F.char_length(path).cast("double").alias("path_length"),
        count(path, "/").alias("depth"),
        (count(url, "0-9") / F.greatest(F.char_length(url), F.lit(1))).alias("digit_ratio"),
        _entropy("host").alias("entropy"),
        F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0).alias("n_params"),
        F.char_length(query).cast("double").alias("query_length"),
        F.size(labels).cast("double").alias("n_labels"),
        F.coalesce(F.array_max(F.transform(labels, F.char_length)), F.lit(0)).cast("double").alias("longest_label"),
        count(host, "-").alias("n_hyphens"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double").alias("has_extension"),
        F.startswith(url, F.lit("https://")).cast("double").alias("is_secure"),
        F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3)).alias("suffix"),
    )


def _fold_sums(labelled: DataFrame) -> DataFrame:
    """``suffix, fold, blocked, n`` of the labelled URLs. Aggregated before the shuffle."""
    return labelled.groupBy("suffix", "fold").agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("n"))


def _statistics(sums: DataFrame, share: float) -> DataFrame:
    """Smoothed share of blocked URLs and log count of every suffix."""
    totals = sums.groupBy("suffix").agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n"))
    return totals.select("suffix", *_rates(F.col("blocked"), F.col("n"), share))


def _rates(blocked: Column, n: Column, share: float) -> list[Column]:
    rate = (blocked + share * SMOOTHING) / (n + SMOOTHING)
    return [rate.alias("suffix_rate"), F.log1p(n).alias("suffix_count")]


def out_of_fold(rows: DataFrame, sums: DataFrame, share: float) -> DataFrame:
    """``rows(suffix, fold, ...)`` with the statistics of their suffix over all other folds."""
    totals = sums.groupBy("suffix").agg(F.sum("blocked").alias("all_blocked"), F.sum("n").alias("all_n"))
    joined = rows.join(totals, "suffix", "left").join(sums, ["suffix", "fold"], "left")
    other = [F.coalesce(f"all_{c}", F.lit(0)) - F.coalesce(c, F.lit(0)) for c in ("blocked", "n")]
    return joined.select(*rows.columns, *_rates(*other, share))


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES
) -> DataFrame:
    """Per row ``id_col, host, path, rule, verdict, block_probability`` (of the trees; null where a rule decides)."""
    rows = pick(pages, id=id_col, url=url_col).select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    decided = lexical(rows.withColumn("decided", _decide(rules, "host", "path")))
    labelled = decided.filter("decided is not null").withColumn("label", (F.col("decided.verdict") == "block").cast("double"))
    labelled = labelled.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    out = [F.col("id").alias(id_col), "host", "path", F.col("decided.rule").alias("rule")]
    if not n or blocked in (0, n):
        other = F.lit("block" if n and blocked else "allow")
        return decided.select(
            *out, F.coalesce("decided.verdict", other).alias("verdict"), F.lit(None).cast("double").alias("block_probability")
        )
    share = blocked / n
    sums = written(_fold_sums(labelled), "url-suffixes")
    statistics = _statistics(sums, share)
    chosen = labelled.select(*FEATURES[:-2], "suffix", "fold", "label", "url").orderBy(F.xxhash64("url"), "url").limit(TRAINING_ROWS)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")

    def with_statistics(df: DataFrame) -> DataFrame:
        joined = df.join(statistics, "suffix", "left")
        return joined.withColumns(
            {"suffix_rate": F.coalesce("suffix_rate", F.lit(share)), "suffix_count": F.coalesce("suffix_count", F.lit(0.0))}
        )

    training = written(out_of_fold(chosen, sums, share).select(*FEATURES, "label"), "url-training")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=7).fit(assembler.transform(training))
    judged = trees.transform(assembler.transform(with_statistics(decided)))
    p = vector_to_array("probability")[1]
    trees_say = F.when(p >= 0.5, "block").otherwise("allow")
    return judged.select(
        *out, F.coalesce("decided.verdict", trees_say).alias("verdict"),
        F.when(F.col("decided").isNull(), p).alias("block_probability"),
    )
