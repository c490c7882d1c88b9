"""Secrets by shape and by how many owners share them, in DataFrame functions only.

Each text is searched once per kind of pattern. Matches and the gaps between them (split on
the same pattern) give the offsets. Every candidate value is hashed and counted over the
whole corpus by distinct repositories and owners: a value that ``example_owners`` owners
share is a copied example, one with few owners that also looks random is live. Counts are
aggregated by (hash, owner, repository) before the shuffle by hash, so a value in a third of
all rows is a few rows by then.

The pattern kinds assign, access and hex give the base spans. The method adds spans of kind
``owned``: long mixed runs of letters and digits, apart from base spans, that are live.

Defined cases: a null text is empty; a null owner or repository is counted as none; repeated
rows count once per owner and repository and each get their result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions.arrays import prefix_sums
from hushlake.functions.pin import pin
from hushlake.llm.tables import fresh, pick, written

#: kind, gate, pattern, group that holds the value, least length of the value
KINDS = (
    (
        "assign",
        r"(?i:password|passwd|secret|token|api_?key)",
        r"(?i:(?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        1,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]{14}", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16}", r"[0-9a-f]{16,}", 0, 16),
    ("owned", r"[A-Za-z0-9+/_=-]{20}", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
EXAMPLE_OWNERS = 4
#: a live value has this many different characters
LIVE_CHARACTERS = 8
MASK = "[SECRET]"
_SPAN = "struct<start: bigint, rank: int, end: bigint, kind: string, value: string>"


def _matches(text: Column) -> list[Column]:
    """For each kind, its matches, values and gaps; empty arrays where the gate finds nothing."""
    none = F.array().cast("array<string>")
    out = []
    for kind, gate, pattern, group, _ in KINDS:
        found = text.rlike(gate)
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        out += [
            F.when(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"{kind}_hits"),
            F.when(found, values).otherwise(none).alias(f"{kind}_values"),
            F.when(found, F.split(text, pattern, -1)).otherwise(none).alias(f"{kind}_gaps"),
        ]
    return out


def _spans(df: DataFrame) -> DataFrame:
    """Arrays ``base`` (sorted) and ``more`` (candidates of the method) from the matches."""
    for kind, *_ in KINDS:
        sizes = f"transform({kind}_hits, (h, i) -> char_length(get({kind}_gaps, i)) + char_length(h))"
        df = df.withColumn(f"{kind}_before", F.expr(prefix_sums(sizes)))
    df = pin(df, *[f"{kind}_before" for kind, *_ in KINDS])

    def spans(kind: str, rank: int, least: int) -> str:
        start = f"cast(get({kind}_before, i) + char_length(get({kind}_gaps, i)) as bigint)"
        return f"""filter(transform({kind}_hits, (h, i) -> cast(named_struct(
            'start', {start}, 'rank', {rank}, 'end', {start} + char_length(h), 'kind', '{kind}',
            'value', get({kind}_values, i)) as {_SPAN})), s -> char_length(s.value) >= {least})"""

    parts = [spans(kind, rank, least) for rank, (kind, _, _, _, least) in enumerate(KINDS)]
    used = [f"{kind}_{what}" for kind, *_ in KINDS for what in ("hits", "values", "gaps", "before")]
    df = df.select("*", F.expr(f"array_sort(concat({', '.join(parts[:3])}))").alias("base"), F.expr(parts[3]).alias("own"))
    df = pin(df.drop(*used), "base", "own")
    more = """filter(own, c -> c.value rlike '[0-9]' and c.value rlike '[A-Za-z]'
        and not exists(base, b -> b.start < c.end and c.start < b.end))"""
    return pin(df.withColumn("more", F.expr(more)).drop("own"), "more")


def _text_of(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def find_spans(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """One row per document with ``base`` and ``more`` spans, without its text; written to scratch."""
    rows = pick(docs, id=id_col, text=text_col, owner=owner_col, repo=repo_col)
    matched = rows.select(
        "id", F.col("owner").cast("string").alias("owner"), F.col("repo").cast("string").alias("repo"),
        F.xxhash64("text").alias("text_key"), *_matches(F.col("text")),
    )
    columns = [f"{kind}_{what}" for kind, *_ in KINDS for what in ("hits", "values", "gaps")]
    found = _spans(pin(matched, *columns))
    return written(found.withColumn("row", F.monotonically_increasing_id()), "secret-spans")


def ownership(found: DataFrame, example_owners: int) -> tuple[DataFrame, DataFrame]:
    """All candidate spans, and ``value_hash, owners, repos, live`` of every value."""
    spans = found.select(
        "row", "text_key", "owner", "repo", F.explode(F.concat("base", "more")).alias("s")
    ).select("row", "text_key", "owner", "repo", "s.*", F.sha2("s.value", 256).alias("value_hash"))
    looks_random = F.size(F.array_remove(F.array_distinct(F.split("value", "")), "")) >= LIVE_CHARACTERS
    each = spans.groupBy("value_hash", "owner", "repo").agg(F.max(looks_random).alias("random"))
    counts = each.groupBy("value_hash", "owner").agg(F.max("random").alias("random"), F.count("repo").alias("repos"))
    total = counts.groupBy("value_hash").agg(
        F.count("owner").alias("owners"), F.sum("repos").alias("repos"), F.max("random").alias("random")
    )
    return spans, total.select(
        "value_hash", "owners", "repos", (F.col("random") & (F.col("owners") < example_owners)).alias("live")
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "source",
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """One row per document: counts, ``base_sha256`` and ``spans``, then ``n_owned``, ``n_live`` and
    ``n_example`` (spans by verdict) and ``max_owners`` of its values (0 without any)."""
    found = find_spans(docs, id_col, text_col, owner_col, repo_col)
    spans, verdicts = ownership(found, example_owners)
    judged = (
        spans.select("row", "start", "rank", "end", "kind", "value_hash")
        .join(verdicts, "value_hash")
        .groupBy("row")
        .agg(
            F.collect_list(F.when((F.col("kind") == "owned") & F.col("live"), F.struct("start", "rank", "end", "kind"))).alias("owned"),
            F.count_if("live").alias("n_live"),
            F.count_if(~F.col("live")).alias("n_example"),
            F.max("owners").alias("max_owners"),
        )
    )
    base = "transform(base, s -> struct(s.start as start, s.rank as rank, s.end as end, s.kind as kind))"
    count = {kind: F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint)") for kind, *_ in KINDS[:3]}
    zero = F.lit(0).cast("long")
    return found.join(judged, "row", "left").select(
        F.col("id").alias(id_col),
        *[count[kind].alias(f"n_{kind}") for kind in count],
        F.expr(f"sha2({_text_of('base')}, 256)").alias("base_sha256"),
        F.expr(_text_of(f"array_sort(concat({base}, coalesce(owned, array())))")).alias("spans"),
        F.expr("cast(coalesce(size(owned), 0) as bigint)").alias("n_owned"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_example", "max_owners")],
    )


def redact_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "source",
    length_col: str | None = "n_chars",
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """The same documents and columns; live values in the texts are replaced by ``MASK``.

    ``length_col`` follows the new length where a text changed.
    """
    found = find_spans(docs, id_col, text_col, owner_col, repo_col)
    spans, verdicts = ownership(found, example_owners)
    live = (
        spans.join(verdicts.filter("live"), "value_hash")
        .groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct((-F.char_length("value")).alias("n"), "value"))).alias("live"))
    )
    key, values, text = fresh(docs, "text_key"), fresh(docs, "live_values"), F.col("`" + text_col.replace("`", "``") + "`")
    changed = F.aggregate(F.col(values), text, lambda t, v: F.replace(t, v["value"], F.lit(MASK)))
    joined = docs.withColumn(key, F.xxhash64(text)).join(
        live.select(F.col("text_key").alias(key), F.col("live").alias(values)), key, "left"
    )
    new = fresh(docs, "new_text")
    joined = joined.withColumn(new, F.when(F.col(values).isNull(), text).otherwise(changed))

    def column(name: str) -> Column:
        quoted = F.col("`" + name.replace("`", "``") + "`")
        if name == text_col:
            return F.col(new).alias(name)
        if name == length_col:
            kind = docs.schema[name].dataType
            return F.when(F.col(values).isNull(), quoted).otherwise(F.char_length(new).cast(kind)).alias(name)
        return quoted

    return joined.select(*[column(c) for c in docs.columns])
