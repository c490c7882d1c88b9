"""Repeated passages by content-defined chunks.

A gear hash rolls over the bytes of a text; where its high bits are zero a chunk ends. The
cut depends on the ``GEAR_BYTES`` bytes before it and on no position, so an insertion
changes the chunks it touches and no others. Long stretches without a cut, as in a text of one
word over and over, are cut where their hash is least, which is at one phase of what repeats.

Every ``SHINGLE`` neighbouring chunks are compared by digest: one aggregation gives the places in
the smallest and the largest document of each digest, and a digest with two different documents
is repeated. A passage is a row of repeated digests whose places in one partner follow one
another in the same way: the partner holds all of it, word for word. Passages of at least
``min_chars`` are reported; a passage loses up to one chunk at either end.

A digest that a third of all rows hold is two places per task before the shuffle, and the
join back to the chunks is split like any skewed join. Chunks repeated in one document only
are not repeated.

Defined cases: null and empty texts have no chunks; rows with a null id report nothing;
repeated rows of one id are one document; ids are numbers, and text ids fail the job; a digest
whose smallest document holds it at several places counts with the first of them; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushlake.llm.tables import fresh, pick
from hushlake.llm.words import Block, blocks, random_words, ranges, span_hashes, window_hash

GEAR_BYTES = 16
#: one byte in ``2 ** CUT_BITS`` ends a chunk, unless one of the ``NEAR`` bytes before it does
CUT_BITS = 5
NEAR = 8
#: Chunks longer than this are cut again at the least hash, in pieces of at least so many bytes.
LONG_BYTES = 256
#: Neighbouring chunks of one digest.
SHINGLE = 2
#: Passages of 50 words have 250 characters and more; a chunk at each end may be lost.
MIN_CHARS = 150

_GEAR = (random_words(256, 21) >> np.uint64(48)).astype(np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the last ``GEAR_BYTES`` bytes at each byte."""
    h = _GEAR[data]
    step = 1
    while step < GEAR_BYTES:
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint16(step) if step < len(h) else 0
        h = h + shifted
        step *= 2
    return h


def cut_points(h: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Byte positions after which a chunk may end, by content alone; ``whole`` tells where a code point ends."""
    at = np.flatnonzero(((h >> np.uint16(16 - CUT_BITS)) == 0) & whole) + 1
    apart = np.ones(len(at), dtype=bool)
    apart[1:] = np.diff(at) > NEAR
    return at[apart]


def _least_cuts(h: np.ndarray, whole: np.ndarray, begin: int, end: int) -> list[int]:
    """Cuts inside a long chunk: where its hash is least, ``LONG_BYTES`` apart and more."""
    first = begin + GEAR_BYTES
    places = np.flatnonzero(whole[first : end - 1])
    if not len(places):
        return []
    values = h[first : end - 1][places]
    least = first + places[values == values.min()] + 1
    cuts, i = [], 0
    while i < len(least):
        cuts.append(int(least[i]))
        i = int(np.searchsorted(least, least[i] + LONG_BYTES))
    return cuts


def chunk_block(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every chunk of a block; document ends cut, their first bytes do not."""
    edges = block.base
    h = gear_hashes(block.data)
    whole = np.ones(len(block.data), dtype=bool)
    whole[:-1] = (block.data[1:] & 0xC0) != 0x80
    cuts = cut_points(h, whole)
    doc = np.searchsorted(edges, cuts, side="right") - 1
    cuts = cuts[cuts - edges[np.minimum(doc, len(edges) - 1)] >= GEAR_BYTES + NEAR]
    bounds = np.unique(np.concatenate((edges, cuts)))
    more = [c for i in np.flatnonzero(np.diff(bounds) > LONG_BYTES) for c in _least_cuts(h, whole, bounds[i], bounds[i + 1])]
    bounds = np.unique(np.concatenate((bounds, np.array(more, dtype=bounds.dtype))))
    return bounds[:-1], bounds[1:]


SHINGLES = "id long, number int, start int, end int, digest long"


def shingles(docs: DataFrame) -> DataFrame:
    """Every ``SHINGLE`` neighbouring chunks of ``docs(id, text)``, by the number of the first; all chunks
    of a document that has fewer. ``start`` and ``end`` count code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for block in blocks(batch.column("text")):
                begin, end = chunk_block(block)
                digests = span_hashes(block.data, begin, end)
                chars = block.chars_before()
                lo, hi = np.searchsorted(begin, block.base[:-1]), np.searchsorted(begin, block.base[1:])
                for size in range(1, SHINGLE + 1):
                    n = np.maximum(hi - lo - size + 1, 0) if size == SHINGLE else (hi - lo == size).astype(np.int64)
                    at = ranges(lo, n)
                    doc = np.repeat(np.arange(len(block)), n)
                    origin = chars[block.base[doc]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(block.first, len(block)).take(pa.array(doc)),
                            pa.array((at - lo[doc]).astype(np.int32)),
                            pa.array((chars[begin[at]] - origin).astype(np.int32)),
                            pa.array((chars[end[at + size - 1]] - origin).astype(np.int32)),
                            pa.array(window_hash(digests, at, range(size)).view(np.int64)),
                        ],
                        names=[f.split()[0] for f in SHINGLES.split(", ")],
                    )

    return docs.mapInArrow(run, SHINGLES)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document and passage that a partner holds: ``id_col, start, end`` (code points),
    ``n_chunks`` (repeated digests in a row), ``first_<id_col>`` (the smallest document that holds it), ``kept`` (whether that is this
    one), ``partner_<id_col>`` (the smallest document, for that one the largest) and ``partner_start``.

    The text from ``start`` to ``end`` stands in the partner at ``partner_start``. Passages of different
    partners may overlap. Chunks are cut twice, for the counts and for the join, rather than kept in
    between: they would take about as much room as the texts.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long")).filter("id is not null")
    every = shingles(rows)
    place = F.struct("id", "number", "start")
    holders = every.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    shared = holders.filter("first.id < last.id")
    found = every.join(shared, "digest").select(
        "id", "number", "start", "end", F.col("first.id").alias("first_id"),
        F.when(F.col("first.id") == F.col("id"), F.col("last")).otherwise(F.col("first")).alias("partner"),
    )
    # places in the partner that follow one another like those of the document are one diagonal
    lined = found.select(
        "id", "number", "start", "end", "first_id", F.col("partner.id").alias("partner_id"),
        (F.col("partner.start") - F.col("start")).alias("shift"),
        (F.col("partner.number") - F.col("number")).alias("diagonal"),
    )
    diagonal = ["id", "first_id", "partner_id", "shift", "diagonal"]
    # repeated rows have equal ranks, so they fall into one run
    rank = F.dense_rank().over(Window.partitionBy(*diagonal).orderBy("number"))
    return (
        lined.withColumn("run", F.col("number") - rank)
        .groupBy(*diagonal, "run")
        .agg(
            F.min("start").cast("long").alias("start"),
            F.max("end").cast("long").alias("end"),
            (F.max("number") - F.min("number") + 1).cast("long").alias("n_chunks"),
        )
        .filter(F.col("end") - F.col("start") >= min_chars)
        .select(
            F.col("id").alias(id_col), "start", "end", "n_chunks", F.col("first_id").alias(f"first_{id_col}"),
            (F.col("first_id") == F.col("id")).alias("kept"),
            F.col("partner_id").alias(f"partner_{id_col}"), (F.col("start") + F.col("shift")).alias("partner_start"),
        )
    )


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents, with all their columns, without passages that an earlier document holds."""
    passages = repeated_passages(docs, id_col, text_col, min_chars).filter("not kept")
    spans = fresh(docs, "spans")
    lists = passages.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans))
    joined = docs.join(lists, id_col, "left").select(*docs.columns, spans)
    place, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cut in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if text is not None and cut:
                    left, at = [], 0
                    for span in cut:  # by start; passages of different partners may overlap
                        left.append(text[at : max(at, span["start"])])
                        at = max(at, span["end"])
                    text = "".join([*left, text[at:]])
                texts.append(text)
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, T.StructType(docs.schema.fields))
