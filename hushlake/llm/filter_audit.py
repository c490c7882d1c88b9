"""What each filter removes in every order of the filters: a Gray-code walk over subsets.

One Python pass judges every whole text by four filters (A to D) and takes its digest; the
fifth (E, an exact copy of a smaller id's text) is decided on digests, aggregated before each
shuffle. A document is then one of 32 masks of failed filters, and a part of the corpus is
three vectors of 32 counts: documents, good ones, toxic ones.

The walk goes through the 32 subsets of active filters by toggling one filter at a time. Every
mask cell has a counter of active filters that it fails; a cell leaves the survivors as its
counter rises from 0 and returns as it falls to 0. The 32 states are stored, and each step of
each of the 120 orders is a difference of two of them.

Defined cases: a null text is empty; a null part is the empty string. Repeated rows count each;
rows of one id are no copies of each other, a row without an id neither is a copy nor has any,
and of several ``labels`` rows of an id any may say 1. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushlake.llm.tables import pick
from hushlake.llm.words import blocks, text_buffers

FILTERS = "ABCDE"
STATES = 1 << len(FILTERS)

#: A: fewer words; B: less than this percentage of distinct words; C: more capitals; D: a symbol
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"

_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_document(marks: np.ndarray, base: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[base[1:]] - sums[base[:-1]]


def failed_masks(column: pa.Array) -> np.ndarray:
    """Bits 0 to 3 of each text: filters A to D."""
    found = [np.zeros(0, dtype=np.int64)]
    for block in blocks(column):
        n_words = (block.hi - block.lo).astype(np.int64)
        doc, hashes = block.doc, block.hashes(lower=False)
        order = np.lexsort((hashes, doc))
        d, h = doc[order], hashes[order]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        n_distinct = np.bincount(d[new], minlength=len(block))
        n_chars = _per_document((block.data & 0xC0) != 0x80, block.base)
        fails = (
            n_words < LEAST_WORDS,
            100 * n_distinct < LEAST_DISTINCT * n_words,
            100 * _per_document(_CAPITAL[block.data], block.base) > MOST_CAPITALS * n_chars,
            _per_document(_SYMBOL[block.data], block.base) > 0,
        )
        found.append(sum(f.astype(np.int64) << bit for bit, f in enumerate(fails)))
    return np.concatenate(found)


def _judged(docs: DataFrame) -> DataFrame:
    """``id, part, mask, digest`` of ``docs(id, part, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            data, at = text_buffers(text)
            raw = memoryview(np.ascontiguousarray(data))
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array(failed_masks(text), pa.int64()), pa.array(digests, pa.binary())],
                names=["id", "part", "mask", "digest"],
            )

    return docs.mapInArrow(run, "id long, part string, mask long, digest binary")


def mask_cells(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    quality_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """``part, mask, n, good, toxic``: how many documents of each part fail which filters."""
    rows = pick(docs, id=id_col, part=part_col, text=text_col).select(
        F.col("id").cast("long").alias("id"), F.coalesce("part", F.lit("")).alias("part"), "text"
    )
    marks = pick(labels, id=id_col, quality=quality_col, toxic=toxic_col)
    marks = marks.groupBy(F.col("id").cast("long").alias("id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic"),
    )
    one_each = _judged(rows).groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = one_each.join(marks, "id", "left").fillna(0, ["good", "toxic"])
    # copies meet as counts: of each kind of copy only the smallest id, and how often it stands, goes on
    kinds = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.expr("if(id is null, n, 0)")), F.lit(0)).alias("n_no_id"),
        F.min(F.expr("if(id is null, null, struct(id, n))")).alias("least"),
    )
    first = F.min("least.id").over(Window.partitionBy("digest"))
    split = kinds.withColumn("originals", F.expr("n_no_id") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0))
    both = split.select(
        "part", "good", "toxic",
        F.inline(F.expr("array(struct(mask as mask, originals as n), struct(mask + 16 as mask, n - originals as n))")),
    )
    return both.filter("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.expr("n * good")).alias("good"), F.sum(F.expr("n * toxic")).alias("toxic")
    )


def survivors(cells: np.ndarray) -> np.ndarray:
    """Rows of ``cells`` (32 masks, any columns) summed over masks without an active failure,
    for each of the 32 sets of active filters."""
    states = np.zeros_like(cells)
    counter = np.zeros(STATES, dtype=np.int64)
    masks = np.arange(STATES)
    running = cells.sum(axis=0)
    active = 0
    states[0] = running
    for step in range(1, STATES):
        bit = (step & -step).bit_length() - 1
        fails = (masks >> bit & 1).astype(bool)
        active ^= 1 << bit
        if active >> bit & 1:
            running = running - cells[fails & (counter == 0)].sum(axis=0)
            counter[fails] += 1
        else:
            counter[fails] -= 1
            running = running + cells[fails & (counter == 0)].sum(axis=0)
        states[active] = running
    return states


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def order_steps(cells: np.ndarray) -> list[tuple]:
    """``(filter_order, step, *COUNTS)`` of every step of every order; ``cells`` is 32 x (n, good, toxic)."""
    states = survivors(cells)
    everything = STATES - 1
    steps, shapley = [], [0] * len(FILTERS)
    for order in permutations(range(len(FILTERS))):
        active = 0
        for step, f in enumerate(order, 1):
            lost = states[active] - states[active | 1 << f]
            active |= 1 << f
            shapley[f] += int(lost[0])
            steps.append((order, step, f, active, lost))
    fails = [int(states[0][0] - states[1 << f][0]) for f in range(len(FILTERS))]
    only = [int(states[everything & ~(1 << f)][0] - states[everything][0]) for f in range(len(FILTERS))]
    return [
        ("".join(FILTERS[k] for k in order), step, int(states[active][0]), int(lost[0]), fails[f] - int(lost[0]),
         only[f], int(lost[1]), int(lost[2]), shapley[f])
        for order, step, f, active, lost in steps
    ]


def audit_filters(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``: 600 rows for each part. ``columns`` are those of ``mask_cells``."""
    parts = mask_cells(docs, labels, **columns).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")
    )
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, held in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                cells = np.zeros((STATES, 3), dtype=np.int64)
                for cell in held:
                    cells[cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                columns = list(zip(*order_steps(cells), strict=True))
                types = [pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(columns[0])), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    return parts.mapInArrow(run, schema)
