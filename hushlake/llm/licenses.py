"""License texts by diagonal voting.

Every rolling window of ``K`` words of a document is hashed; Spark joins the hashes to the
positions of the same windows in license templates: whole licenses, and the statements by
which texts name one. A match votes for the diagonal of its two positions. Votes are counted
per text, template and diagonal; neighbouring diagonals (a word more or less) merge into one
span. A span with votes of one in ``VOTES_ONE_IN`` of its template's windows is verified on
the text: the longest common subsequence of the words around it with the template's may miss
one word in ``ONE_IN``. The join's other side comes from a fixed list of templates, so it is
small; before the join a lossy filter (a bitmap of ``FILTER_BITS`` address bits) leaves out
windows that surely have no partner, and lets some pass that have none.

Equal texts vote once: hits are taken from one row of each text, found again by its hash.

Phrases are counted on their own as the base result; the method adds the labels of verified
templates.

Defined cases: a null text is empty; without words or phrases the positions are null, the
labels empty strings and the score 0; repeated rows each get their result. A very long text
is one row of hits: memory follows the longest text. Ties between templates do not matter,
all verified ones give their labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushlake.llm.license_texts import STATEMENTS, WHOLE
from hushlake.llm.tables import pick, written
from hushlake.llm.words import ALNUM, blocks, mix

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = WHOLE + STATEMENTS
K = 3
#: Diagonals at most so far apart belong to one span.
NEIGHBOURS = 3
#: A span holds its template's words in order; one word in so many may be missing.
ONE_IN = 10
#: One in so many of a template's windows must vote for a span before its words are compared.
VOTES_ONE_IN = 4
#: Address bits of the lossy filter before the join: 16 MB in a worker, whatever the templates hold.
FILTER_BITS = 24


def _hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for block in blocks(pa.array(texts, pa.string()), ALNUM):
        words = block.hashes()
        out.extend(words[a:b] for a, b in zip(block.lo, block.hi, strict=True))
    return out


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` words in a row."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, k, dtype=np.uint64)
    for offset in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[offset : offset + n]
    return h ^ (h >> np.uint64(31))


def template_positions() -> tuple[list[np.ndarray], list[tuple[int, int, int]]]:
    """The templates' words, and ``gram, template, position`` of every window."""
    words = _hashes([text for _, text in TEMPLATES])
    rows = [(int(g), t, p) for t, w in enumerate(words) for p, g in enumerate(_grams(w, K).view(np.int64).tolist())]
    return words, rows


SCANNED = (
    "id {id}, text_key long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "hits array<struct<position: bigint, gram: bigint>>"
)


def scan_words(docs: DataFrame, id_type: str) -> DataFrame:
    """Per document of ``docs(id, text_key, text)``: the base result, and windows that pass the lossy filter."""
    _, positions = template_positions()
    grams = np.array([g for g, _, _ in positions], dtype=np.int64).view(np.uint64)
    shift = np.uint64(64 - FILTER_BITS)
    phrases = [(label, _grams(w, len(w))[0], len(w)) for (_, label), w in zip(PHRASES, _hashes([p for p, _ in PHRASES]), strict=True)]
    schema = SCANNED.format(id=id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
        maybe[mix(grams) >> shift] = True
        for batch in batches:
            for block in blocks(batch.column("text"), ALNUM):
                words, n = block.hashes(), len(block)
                found: list[list[tuple[int, str]]] = [[] for _ in range(n)]
                for label, gram, size in phrases:
                    at = np.flatnonzero(_grams(words, size) == gram)
                    doc = np.searchsorted(block.hi, at, side="right")
                    for d, p in zip(doc.tolist(), at.tolist(), strict=True):
                        if p + size <= block.hi[d]:
                            found[d].append((p - int(block.lo[d]), label))
                h = _grams(words, K)
                at = np.flatnonzero(maybe[mix(h) >> shift])
                doc = np.searchsorted(block.hi, at, side="right")
                inside = at + K <= block.hi[doc]
                at, doc = at[inside], doc[inside]
                hits: list[list[dict]] = [[] for _ in range(n)]
                for d in np.unique(doc).tolist():
                    own = at[doc == d] - block.lo[d]
                    hits[d] = [{"position": p, "gram": g} for p, g in zip(own.tolist(), h[own + block.lo[d]].view(np.int64).tolist(), strict=True)]
                places = [sorted(p for p, _ in f) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(block.first, n),
                        batch.column("text_key").slice(block.first, n),
                        pa.array(block.hi - block.lo),
                        pa.array([len(p) for p in places], pa.int64()),
                        pa.array([p[0] if p else None for p in places], pa.int64()),
                        pa.array([p[-1] if p else None for p in places], pa.int64()),
                        pa.array([",".join(sorted({label for _, label in f})) for f in found], pa.string()),
                        pa.array(hits, pa.list_(pa.struct([("position", pa.int64()), ("gram", pa.int64())]))),
                    ],
                    names=["id", "text_key", "n_words", "n_base", "first_word", "last_word", "base_labels", "hits"],
                )

    return docs.mapInArrow(run, schema)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence: a row of the table is the bits of one integer."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        both = row & places.get(y, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def _agreement(template: list[int], words: list[int]) -> int:
    """Most template words in order within a stretch little longer than the template.

    Stretches begin at half a template's length from each other, so a long span costs its length.
    """
    n = len(template)
    starts = range(0, max(1, len(words) - n), max(1, n // 2))
    return max(common_subsequence(template, words[s : s + n + n // 2 + 1]) for s in starts)


def _spans(scanned: DataFrame) -> DataFrame:
    """``text_key, template, start, end`` (document words) of merged diagonals with enough votes."""
    templates, positions = template_positions()
    table = scanned.sparkSession.createDataFrame(positions, "gram long, template int, place long")
    least = F.element_at(F.array(*[F.lit(-(-(len(w) - K + 1) // VOTES_ONE_IN)) for w in templates]), F.col("template") + 1)
    one_each = scanned.filter("size(hits) > 0").select("text_key", "hits").dropDuplicates(["text_key"])
    votes = (
        one_each.select("text_key", F.inline("hits"))
        .join(F.broadcast(table), "gram")  # a row per word of the templates above
        .groupBy("text_key", "template", (F.col("position") - F.col("place")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("votes"), F.min("position").alias("low"), F.max("position").alias("high"))
    )
    order = Window.partitionBy("text_key", "template").orderBy("diagonal")
    fresh_span = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS, F.lit(True))
    return (
        votes.withColumn("new", fresh_span.cast("int"))
        .withColumn("span", F.sum("new").over(order))
        .groupBy("text_key", "template", "span")
        .agg(F.min("low").alias("start"), (F.max("high") + K).alias("end"), F.sum("votes").alias("votes"))
        .filter(F.col("votes") >= least)
    )


def verified_spans(texts: DataFrame) -> DataFrame:
    """``text_key, label, share`` of ``texts(text_key, text, spans)``: the templates that the words around spans hold."""
    templates = [w.view(np.int64).tolist() for w in template_positions()[0]]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            keys, spans = batch.column("text_key").to_pylist(), batch.column("spans").to_pylist()
            for block in blocks(batch.column("text"), ALNUM):
                words = block.hashes().view(np.int64)
                for d, (lo, hi) in enumerate(zip(block.lo.tolist(), block.hi.tolist(), strict=True), block.first):
                    for span in spans[d]:
                        template = templates[span["template"]]
                        n = len(template)
                        around = words[max(lo, lo + span["start"] - n) : min(hi, lo + span["end"] + n)].tolist()
                        common = _agreement(template, around)
                        if n - common <= n // ONE_IN:
                            for column, value in zip(out, (keys[d], TEMPLATES[span["template"]][0], common / n), strict=True):
                                column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())],
                names=["text_key", "label", "share"],
            )

    return texts.select("text_key", "text", "spans").mapInArrow(verify, "text_key long, label string, share double")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    rows = pick(docs, id=id_col, text=text_col).withColumn("text_key", F.xxhash64("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    scanned = written(scan_words(rows, id_type), "license-hits")
    spans = _spans(scanned).groupBy("text_key").agg(F.collect_list(F.struct("template", "start", "end")).alias("spans"))
    proposed = written(spans, "license-spans")
    # every copy of a text is verified where it lies; their equal results merge below
    verified = verified_spans(rows.join(proposed, "text_key"))
    found = written(
        verified.groupBy("text_key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share")), "license-labels"
    )
    base = "filter(split(base_labels, ','), x -> x <> '')"
    return scanned.join(found, "text_key", "left").select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.expr(f"array_join(array_sort(array_union({base}, coalesce(more, array()))), ',')").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
