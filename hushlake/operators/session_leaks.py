"""Values that are masked in one row of a session and stand as prose in another.

An inverted index per session. A value is looked up by one of its n-grams: the least of the
hashes in its first window of n-grams. The same window lies in any content that holds the
value, so contents list the least hash of each of their windows, a fifth of their n-grams for
long values. Equal grams say where the value would begin and how long it would be; the digest
of just that piece is compared with the digests of the session's values. Lists of values never
meet lists of rows, and no value or text is shuffled but the contents of rows with a candidate.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.config import SanitizeConfig
from hushlake.functions.arrays import literal_array
from hushlake.functions.pin import pin
from hushlake.operators.numbering import null_safe_join
from hushlake.operators.redact import Settings, with_kept
from hushlake.rules import selected_rules
from hushlake.sources.scratch import written

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: (shortest value, letters of a gram, grams of a window); the window of the shortest value fits
SIZES = ((1, 1, 1), (3, 3, 1), (8, 5, 4), (16, 8, 9))
SEED = "struct<size: int, gram: bigint, at: int>"


def size_of(length: int) -> int:
    """The last of ``SIZES`` whose values are at most as long as this one."""
    return sum(length >= least for least, _, _ in SIZES) - 1


def gram_hashes(text: str, letters: int) -> np.ndarray:
    """A hash of the code points from each place on."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - letters + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(letters):
        h = (h + codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def least_of_windows(h: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the least of some window."""
    n = len(h) - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least = h[:n].copy()
    for k in range(1, window):
        np.minimum(least, h[k : k + n], out=least)
    chosen = np.zeros(len(h), bool)
    for k in range(window):
        chosen[k : k + n] |= h[k : k + n] == least
    return np.flatnonzero(chosen)


def seed_of(value: str) -> dict[str, int]:
    """Size, gram and place in the value of the gram by which it is looked up."""
    size = size_of(len(value))
    _, letters, window = SIZES[size]
    first = gram_hashes(value, letters)[:window]
    at = int(first.argmin())
    return {"size": size, "gram": int(first[at]), "at": at}


def _seeds(values: pa.Array) -> pa.Array:
    kind = pa.struct([("size", pa.int32()), ("gram", pa.int64()), ("at", pa.int32())])
    return pa.array([seed_of(v) if v else None for v in values.to_pylist()], kind)


def _grams(sizes: list[int], content: Column) -> Column:
    """The grams that a content lists for each of ``sizes``."""
    kind = pa.list_(pa.struct([("size", pa.int32()), ("gram", pa.int64()), ("at", pa.int32())]))

    def run(contents: pa.Array) -> pa.Array:
        ends, parts = [0], []
        for text in contents.to_pylist():
            total = ends[-1]
            for size in sizes:
                _, letters, window = SIZES[size]
                h = gram_hashes(text or "", letters)
                places = least_of_windows(h, window)
                parts.append((np.full(len(places), size, np.int32), h[places], places.astype(np.int32)))
                total += len(places)
            ends.append(total)
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 3
        rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return F.arrow_udf(run, f"array<{SEED}>")(content)


def _pieces(contents: pa.Array, spans: pa.Array) -> pa.Array:
    """SHA-256 of each distinct piece, given by begin and length, that lies in the content."""
    out = []
    for content, wanted in zip(contents.to_pylist(), spans.to_pylist(), strict=True):
        text = content or ""
        pieces = {text[s["begin"] : s["begin"] + s["n"]] for s in wanted if 0 <= s["begin"] <= len(text) - s["n"]}
        out.append([hashlib.sha256(p.encode("utf-8", "replace")).hexdigest() for p in pieces])
    return pa.array(out, pa.list_(pa.string()))


def session_leak_check(
    results: DataFrame,
    session: list[str],
    keys: list[str],
    text_col: str = "text",
    mode: str | None = None,
    config: Settings = None,
    content_col: str = "content",
    with_fixed: bool = False,
) -> DataFrame:
    """Rows whose redacted content holds the value of a hit in any row of their session.

    ``results`` has the text as it was beside the content that is to be given out. Reports
    ``session``, ``keys``, ``category`` and the number ``leaked_values`` of distinct such values,
    never a value. Hits with a fixed replacement are left out, as in ``leak_check``, unless
    ``with_fixed``. Null keys are a session like any other, null texts and contents hold nothing, and rows that are equal in
    session and keys are reported as one. The values' digests and grams are written to the scratch
    folder, so the detectors run once.
    """
    cfg = SanitizeConfig.resolve(config, mode)
    rules = selected_rules(cfg)
    row = list(dict.fromkeys([*session, *keys]))
    both = results.select(
        *row,
        F.make_valid_utf8(text_col).alias("__text"),
        F.coalesce(F.make_valid_utf8(content_col), F.lit("")).alias("__content"),
    )
    # 64 bits of the session join grams; digests decide, beside the session itself
    both = both.withColumn("__session", F.xxhash64(*[F.struct(F.col(s).isNull(), s) for s in session]))
    names = literal_array([r.category for r in rules], "string")
    free = literal_array([with_fixed or r.replacement is None for r in rules], "boolean")
    chosen = f"""array_distinct(transform(filter(__kept, h -> get({free}, h.rule) AND h.value <> ''),
        h -> struct(get({names}, h.rule) AS category, h.value AS value)))"""
    kept = pin(with_kept(both.drop("__content"), "__text", rules), "__kept")
    hits = kept.select(*session, "__session", F.explode(F.expr(chosen)).alias("h")).select(
        *session, "__session", "h.category", "h.value"
    )
    seeded = pin(hits.withColumn("seed", F.arrow_udf(_seeds, SEED)("value")), "seed")
    values = written(
        seeded.select(
            *session, "__session", "category", F.sha2("value", 256).alias("digest"),
            F.length("value").alias("n"), "seed.size", "seed.gram", F.col("seed.at").alias("offset"),
        ).distinct(),
        "session-values",
    )
    sizes = sorted(r.size for r in values.select("size").distinct().collect())  # at most len(SIZES) rows
    content = both.drop("__text").withColumn("__row", F.xxhash64("__session", "__content"))
    index = content.select("__session", "__row", F.explode(_grams(sizes, F.col("__content"))).alias("g")).select(
        "__session", "__row", "g.*"
    )
    # values that share gram, place and length ask for the same piece
    asked = values.select("__session", "size", "gram", "offset", "n").distinct()
    spans = (
        index.join(asked, ["__session", "size", "gram"])
        .groupBy("__row")
        .agg(F.collect_set(F.struct((F.col("at") - F.col("offset")).alias("begin"), "n")).alias("spans"))
    )
    pieces = F.arrow_udf(_pieces, "array<string>")
    held = content.join(spans, "__row").select(*row, F.explode(pieces("__content", "spans")).alias("digest"))
    masked = values.select(*session, "category", "digest").distinct()
    return (
        null_safe_join(held, masked, [*session, "digest"])
        .groupBy(*row, "category")
        .agg(F.countDistinct("digest").alias("leaked_values"))
    )
