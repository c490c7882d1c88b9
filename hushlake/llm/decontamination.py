"""Benchmark passages in documents, by spaced seeds.

A seed is a window of words of which a fixed mask ignores some positions, so a changed word
does not hide the window. Seeds of the benchmark and of the documents are joined by hash;
each match proposes a document, an item and a diagonal. The words of both are then compared
along the diagonal: the longest stretch in which at least ``percent`` of the words agree
must reach ``min_words`` words, or ``percent`` of the item if that is shorter. Items that ask
for less than ``LONG_STRETCH`` words have seeds of four words, joined with these items only.

The documents' seeds pass a bitmap of the benchmark's seeds before they leave their task,
so the join gets little more than true matches. The bitmap has a fixed size; a benchmark
with too many seeds for it is joined without it.

Equal texts are one: their seeds are joined once, one of them is compared, and the result goes to
every copy.

Defined cases: null and empty texts match nothing; items of fewer than five words are too short
to tell and match nothing; repeated documents each get their rows; of equally long stretches the
one with more agreeing words counts, then the earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.llm.tables import fresh, pick, written
from hushlake.llm.words import Block, blocks

#: 1: the word counts, 0: it is ignored
MASKS = ("11111", "1101101", "1110011", "1011011", "1100111")
#: All ways for four of five words to agree.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
#: Stretches of so many words and more, of which 80 % agree, always hold a seed of ``MASKS``.
LONG_STRETCH = 13
LEAST_WORDS = 5
BITMAP_BITS = 1 << 24
BITMAP_SEEDS = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def seeds(block: Block) -> Iterator[tuple[str, bool, np.ndarray, np.ndarray]]:
    """For each mask, and whether it is a short one: window starts (word indexes) of the block and their seed hashes."""
    words = block.hashes()
    for number, mask in enumerate(MASKS + SHORT_MASKS):
        n = len(words) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, number + 1, dtype=np.uint64)
        for offset, used in enumerate(mask):
            if used == "1":
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += words[offset : offset + n]
        yield mask, number >= len(MASKS), np.arange(n), _mixed(h)


def _within(block: Block, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The document of each window start, and whether the window ends in it."""
    doc = np.searchsorted(block.hi, at, side="right")
    return doc, at + length <= block.hi[doc]


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(BITMAP_BITS - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def least_stretch(n_words: np.ndarray | int, percent: int, min_words: int) -> np.ndarray | int:
    """The words of a stretch that tells an item of ``n_words``."""
    return np.minimum(min_words, -(-n_words * percent // 100))


def seed_rows(texts: DataFrame, key: str, bitmap: np.ndarray | None, item_rule: tuple[int, int] | None = None) -> DataFrame:
    """``key, position, seed`` of every seed window that the bitmap lets through.

    Benchmark items come with their ``percent`` and ``min_words``: each has the seeds of its length.
    """
    sent = None if bitmap is None else texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sent is None else sent.value
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column("text")):
                n_words = block.hi - block.lo
                for mask, short, at, h in seeds(block):
                    if bits is not None:
                        one, two = _probes(h)
                        ok = np.flatnonzero((bits[one >> 3] >> (one & 7).astype(np.uint8)) & 1)
                        two = two[ok]
                        ok = ok[((bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)]
                        at, h = at[ok], h[ok]
                    if not len(at):
                        continue
                    doc, inside = _within(block, at, len(mask))
                    if item_rule is not None:
                        inside &= (least_stretch(n_words, *item_rule) < LONG_STRETCH)[doc] == short
                        inside &= n_words[doc] >= LEAST_WORDS
                    doc, at, h = doc[inside], at[inside], h[inside]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[block.first + doc]), pa.array(at - block.lo[doc]), pa.array(h.view(np.int64))],
                        names=[key, "position", "seed"],
                    )

    return texts.select(key, "text").mapInArrow(run, f"{key} long, position long, seed long")


def _bitmap(bench_seeds: DataFrame) -> np.ndarray | None:
    found = bench_seeds.select("seed").distinct().limit(BITMAP_SEEDS + 1).toPandas()["seed"].to_numpy()
    if len(found) > BITMAP_SEEDS:
        return None
    bits = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for at in _probes(found.astype(np.int64).view(np.uint64)):
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return bits


def best_stretch(same: np.ndarray, percent: int) -> tuple[int, int]:
    """The longest stretch of which at least ``percent`` of 100 are true."""
    sums = np.concatenate(([0], np.cumsum(np.where(same, 100 - percent, -percent))))
    lowest = np.minimum.accumulate(sums)
    begin = np.searchsorted(-lowest, -sums, side="left")
    end = int(np.argmax(np.arange(len(sums)) - begin))
    return int(begin[end]), end


def verify(words: np.ndarray, item: np.ndarray, diagonals: list[int], percent: int, min_words: int) -> tuple[int, int, int] | None:
    """The longest agreeing stretch (start and end in the document, agreeing words), if long enough."""
    best = None
    for diagonal in diagonals:
        a, b = max(0, -diagonal), min(len(item), len(words) - diagonal)
        if b <= a:
            continue
        same = item[a:b] == words[a + diagonal : b + diagonal]
        begin, end = best_stretch(same, percent)
        if end - begin >= least_stretch(len(item), percent, min_words):
            found = (end - begin, int(same[begin:end].sum()), -(a + begin + diagonal))
            best = max(best, found) if best else found
    return best and (-best[2], best[0] - best[2], best[1])


def _word_lists(column: pa.Array) -> Iterator[np.ndarray]:
    for block in blocks(column):
        words = block.hashes()
        for lo, hi in zip(block.lo, block.hi, strict=True):
            yield words[lo:hi]


def benchmark_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = 80,
    min_words: int = 13,
) -> DataFrame:
    """One row per document and benchmark item found in it: ``id_col, item_col, start_word,
    end_word, n_agreeing, item_words, contaminated`` (always true) and ``text_key``.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("text_key", F.xxhash64("text"))
    items = pick(benchmark, item=item_col, item_text=item_text_col).filter("item_text is not null").distinct()
    items = items.withColumn("item_key", F.xxhash64("item", "item_text"))
    bench = written(
        seed_rows(items.select("item_key", F.col("item_text").alias("text")), "item_key", None, (percent, min_words)),
        "benchmark-seeds",
    )
    hits = seed_rows(rows, "text_key", _bitmap(bench)).distinct()
    matched = hits.join(bench.withColumnRenamed("position", "item_position"), "seed")
    diagonals = matched.select("text_key", "item_key", (F.col("position") - F.col("item_position")).alias("diagonal")).distinct()
    proposed = diagonals.groupBy("text_key", "item_key").agg(F.collect_list("diagonal").alias("diagonals"))
    listed = written(
        proposed.join(items, "item_key")
        .groupBy("text_key")
        .agg(F.collect_list(F.struct("item", "item_text", "diagonals")).alias("proposals")),
        "overlap-candidates",
    )
    copies = written(rows.select("id", "text_key").join(listed.select("text_key"), "text_key"), "overlap-copies")
    one_each = copies.groupBy("text_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
    wanted = one_each.select("text_key", F.col("first.id").alias("first_id")).join(listed, "text_key")
    candidates = rows.join(wanted.withColumnRenamed("text_key", "wanted_key"), F.expr("text_key = wanted_key and id <=> first_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            keys, lists = batch.column("text_key"), batch.column("proposals")
            for n, words in enumerate(_word_lists(batch.column("text"))):
                proposals = lists[n].as_py()
                targets = list(_word_lists(pa.array([p["item_text"] for p in proposals], pa.string())))
                for p, item in zip(proposals, targets, strict=True):
                    found = verify(words, item, p["diagonals"], percent, min_words)
                    if found:
                        row = (keys[n].as_py(), p["item"], *found, len(item))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64()) for v in out],
                names=["text_key", "item", "start_word", "end_word", "n_agreeing", "item_words"],
            )

    found = candidates.select("text", "text_key", "proposals").mapInArrow(
        run, "text_key long, item long, start_word long, end_word long, n_agreeing long, item_words long"
    )
    # rows that stand twice with the same id and text were compared twice
    return copies.join(found.distinct(), "text_key").select(
        F.col("id").alias(id_col), F.col("item").alias(item_col),
        "start_word", "end_word", "n_agreeing", "item_words", F.lit(True).alias("contaminated"), "text_key",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns."""
    found = benchmark_overlaps(docs, benchmark, text_col=text_col, **settings)
    key = fresh(docs, "text_key")
    bad = found.select(F.col("text_key").alias(key)).distinct()
    quoted = F.col("`" + text_col.replace("`", "``") + "`")
    return docs.withColumn(key, F.xxhash64(quoted)).join(bad, key, "left_anti").drop(key)
