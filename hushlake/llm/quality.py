"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

One Python pass measures every text and lets each rule vote good, bad or not at all. Only
the combination of votes matters afterwards: there are ``3 ** len(RULES)`` at most, so their
counts describe a corpus of any size. Expectation-maximisation on these counts estimates,
for good and for bad documents, how often each rule casts each vote, and the share of good
documents; the posterior of a combination is the quality of its documents. Nothing is
rejected because a single rule fails.

Defined cases: a null or empty text has no words; every rule abstains where it cannot tell
(most below ``FEW_WORDS`` words); repeated rows are measured each for itself; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushlake.llm.tables import pick, written
from hushlake.llm.words import Block, blocks, ranges, window_hash

WINDOW = 8
FEW_WORDS = 20
GOOD, BAD, ABSTAIN = 1, 2, 0

_every = np.arange(256)
_SYMBOL = np.isin(_every, np.frombuffer(b"#*$%&|<>", np.uint8))
_LETTER = ((_every >= 65) & (_every <= 90)) | ((_every >= 97) & (_every <= 122)) | (_every >= 0xC0)
_UPPER = (_every >= 65) & (_every <= 90)
_STOP = np.isin(_every, np.frombuffer(b".!?", np.uint8))

#: name, measure, good up to, bad from (rates per word or per letter); a rule votes on texts of FEW_WORDS words
RULES = (
    ("symbols", "symbol_rate", 0.02, 0.10),
    ("repeats", "repeat_rate", 0.05, 0.30),
    ("lines", "dup_line_rate", 0.05, 0.30),
    ("shouting", "upper_rate", 0.15, 0.50),
    ("vocabulary", "same_word_rate", 0.70, 0.90),
    ("sentences", "words_per_stop", 40.0, 120.0),
    ("digits", "digit_rate", 0.10, 0.30),
)


def _per_doc(flags: np.ndarray, base: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[base[1:]] - sums[base[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[back] > 1


def _lines(block: Block, words: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line, per document."""
    breaks = np.flatnonzero(block.data == 10)
    begin = np.sort(np.concatenate((block.base[:-1], breaks + 1)))
    end = np.sort(np.concatenate((breaks, block.base[1:])))
    has_word = np.searchsorted(block.start, begin) < np.searchsorted(block.start, end)
    begin, end = begin[has_word], end[has_word]
    doc = np.searchsorted(block.base, begin, side="right") - 1
    seen: dict[tuple[int, bytes], int] = {}
    dup = np.zeros(len(block), dtype=np.int64)
    raw = block.data.tobytes()
    for d, a, b in zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True):
        key = (d, raw[a:b])
        if key in seen:
            dup[d] += 1
        else:
            seen[key] = 1
    return dup


def measure(block: Block) -> dict[str, np.ndarray]:
    """The base counts and the rates that rules look at, one value per document."""
    base, n = block.base, len(block)
    words = block.hashes(lower=False)
    doc = block.doc
    n_words = block.hi - block.lo
    code_points = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80, dtype=np.int64)))
    chars = code_points[block.end] - code_points[block.start]
    word_chars = np.bincount(doc, chars, minlength=n).astype(np.int64)
    salt = doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    at = block.windows(WINDOW)
    twice = at[_repeated(window_hash(words, at, range(WINDOW), seed=7) + salt[at])] if len(at) else at
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    n_repeat = np.bincount(doc, np.cumsum(covered[:-1]) > 0, minlength=n).astype(np.int64)
    n_dup = _lines(block, words)
    n_symbols = _per_doc(_SYMBOL[block.data], base)
    letters = np.maximum(_per_doc(_LETTER[block.data], base), 1)
    n_lines = _per_doc(block.data == 10, base) + 1
    distinct = np.bincount(doc[np.unique(words + salt, return_index=True)[1]], minlength=n)
    per = np.maximum(n_words, 1)
    stops = _per_doc(_STOP[block.data], base)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "symbol_rate": n_symbols / np.maximum(word_chars, 1),
        "repeat_rate": n_repeat / per,
        "dup_line_rate": n_dup / n_lines,
        "upper_rate": _per_doc(_UPPER[block.data], base) / letters,
        "same_word_rate": 1 - distinct / per,
        "words_per_stop": n_words / np.maximum(stops, 1),
        "digit_rate": _per_doc((block.data >= 48) & (block.data <= 57), base) / np.maximum(word_chars, 1),
    }


def votes(measured: dict[str, np.ndarray]) -> np.ndarray:
    """Every document's votes as one number in base 3."""
    code = np.zeros(len(measured["n_words"]), dtype=np.int64)
    for _, name, good, bad in RULES:
        value = measured[name]
        vote = np.where(value <= good, GOOD, np.where(value >= bad, BAD, ABSTAIN))
        code = code * 3 + np.where(measured["n_words"] >= FEW_WORDS, vote, ABSTAIN)
    return code


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured_documents(docs: DataFrame, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                m = measure(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(block.first, len(block)), *[pa.array(m[c]) for c in COUNTS], pa.array(votes(m))],
                    names=["id", *COUNTS, "votes"],
                )

    return docs.mapInArrow(run, f"id {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + ", votes long")


def vote_posteriors(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior quality of each combination of votes, and each rule's estimated accuracy.

    The start calls a document good by its majority of votes; a pseudo-count that favours
    right votes keeps the two classes apart and rare votes off zero.
    """
    n_rules = len(RULES)
    cast = np.stack([codes // 3 ** (n_rules - 1 - r) % 3 for r in range(n_rules)])
    good = (cast == GOOD).sum(axis=0) + 1.0
    posterior = good / (good + 2.0 * (cast == BAD).sum(axis=0) + 1.0)
    prior = np.zeros((2, 3))
    prior[1], prior[0] = (1.0, 4.0, 1.0), (1.0, 1.0, 4.0)
    table = np.zeros((2, n_rules, 3))
    for _ in range(rounds):
        weights = np.stack((counts * (1 - posterior), counts * posterior))
        for r in range(n_rules):
            for k in (0, 1):
                seen = np.bincount(cast[r], weights[k], minlength=3) + prior[k]
                table[k, r] = seen / seen.sum()
        share = (weights[1].sum() + 1) / (counts.sum() + 2)
        log = [np.log(share if k else 1 - share) + sum(np.log(table[k, r][cast[r]]) for r in range(n_rules)) for k in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            break
        posterior = new
    right = (1 - share) * table[0, :, BAD] + share * table[1, :, GOOD]
    told = right + (1 - share) * table[0, :, GOOD] + share * table[1, :, BAD]
    return posterior, right / told


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document ``id_col``, the base counts, ``base_failed``, ``kept``, ``quality`` and ``votes``.

    ``kept`` is false where the base rule fails, else whether ``quality`` reaches the threshold.
    """
    rows = pick(docs, id=id_col, text=text_col)
    measured = written(measured_documents(rows, rows.schema["id"].dataType.simpleString()), "quality-votes")
    table = measured.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").toPandas()  # 3 ** rules rows at most
    codes = table["votes"].to_numpy(dtype=np.int64)
    posterior, _ = vote_posteriors(codes, table["n"].to_numpy(dtype=float)) if len(codes) else (codes, codes)
    schema = T.StructType([T.StructField("votes", T.LongType()), T.StructField("quality", T.DoubleType())])
    posteriors = docs.sparkSession.createDataFrame(list(zip(codes.tolist(), [float(p) for p in posterior], strict=True)), schema)
    failed = (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.join(F.broadcast(posteriors), "votes").select(
        F.col("id").alias(id_col), *COUNTS, failed.alias("base_failed"),
        (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality", "votes",
    )
