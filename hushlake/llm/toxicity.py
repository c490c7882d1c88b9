"""Toxicity by class-conditional Kneser-Ney models of letters.

Texts become symbols: A-Z and a-z fold to 26 letters, bytes of other letters to five
symbols, everything else to single spaces. Every ``ORDER`` symbols are an event. Spark
counts the events of all labelled training texts per class; the table has at most
``32 ** ORDER`` rows, whatever the corpus holds. Each class keeps its own discounted
counts of the highest order; rare and unseen events back off to Kneser-Ney continuation
counts that both classes share. A text's ratio is the mean log-likelihood ratio over its
distinct events, so that a word repeated a thousand times does not outweigh the rest. The
score is the logistic of this ratio, fitted on a bounded sample of one training fold that its model has not counted.

Defined cases: a null or empty text has ratio 0 and the score of that; rows whose label is
null or missing do not train; several labels of one id count as toxic if one does; without
labels of both classes every ratio is 0 and every score the share of toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushlake.llm.tables import fresh, pick
from hushlake.llm.words import text_buffers

ORDER = 4
SYMBOLS = 32
CELLS = SYMBOLS**ORDER
DISCOUNT = 0.75
#: Events added to the length of every text: a few events are weak evidence.
LENGTH_PRIOR = 60
#: Rows of the calibration fold that fit the two numbers of the logistic.
CALIBRATION_ROWS = 20_000
#: Labels up to this many rows (16 MB) are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 1_000_000

_every = np.arange(256)
_SYMBOL = np.zeros(256, dtype=np.int8)
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[0x80:0xC0] = 27 + _every[0x80:0xC0] % 5
_SYMBOL[0xC0:] = -1


def events(data: np.ndarray) -> np.ndarray:
    """The event code at each symbol of a text, given as UTF-8 bytes."""
    s = _SYMBOL[data]
    s = s[s >= 0]
    if len(s):
        keep = s > 0
        keep[1:] |= s[:-1] > 0
        s = s[keep]
    padded = np.zeros(len(s) + ORDER - 1, dtype=np.int32)
    padded[ORDER - 1 :] = s
    code = np.zeros(len(s), dtype=np.int32)
    for i in range(ORDER):
        code = code * SYMBOLS + padded[i : i + len(s)]
    return code


def _event_lists(column: pa.Array) -> Iterator[np.ndarray]:
    data, at = text_buffers(column)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield events(data[a:b])


def count_events(texts: DataFrame) -> DataFrame:
    """``code, ordinary, toxic, ordinary_cal, toxic_cal`` of ``texts(text, toxic, cal)``."""
    names = ["ordinary", "toxic", "ordinary_cal", "toxic_cal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((4, CELLS), dtype=np.int64)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            cal = batch.column("cal").to_numpy(zero_copy_only=False)
            for codes, t, c in zip(_event_lists(batch.column("text")), toxic, cal, strict=True):
                code, n = np.unique(codes, return_counts=True)
                counts[t][code] += n
                if c:
                    counts[2 + t][code] += n
        seen = np.flatnonzero(counts[:2].any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), *[pa.array(counts[k][seen]) for k in range(4)]], names=["code", *names]
        )

    parts = texts.mapInArrow(run, "code long, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("code").agg(*[F.sum(n).alias(n) for n in names])


def _discounted(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Interpolated probability of the last symbol; contexts never seen take ``lower`` as it is."""
    total = counts.sum(axis=-1, keepdims=True)
    kinds = (counts > 0).sum(axis=-1, keepdims=True)
    seen = total > 0
    safe = np.where(seen, total, 1)
    back = np.where(seen, DISCOUNT * kinds / safe, 1.0)
    return np.where(seen, np.maximum(counts - DISCOUNT, 0) / safe, 0.0) + back * lower


def log_ratios(ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """log P(symbol | context, toxic) - log P(symbol | context, ordinary) of every event code."""
    shape = (SYMBOLS,) * ORDER
    if not ordinary.any() or not toxic.any():
        return np.zeros(CELLS, dtype=np.float32)
    both = (ordinary + toxic).reshape(shape)
    shared = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER):
        longer = both.sum(axis=tuple(range(ORDER - order - 1)))
        shared = _discounted((longer > 0).sum(axis=0), shared)
    p = [_discounted(c.reshape(shape), shared) for c in (ordinary, toxic)]
    return np.log(p[1] / p[0]).astype(np.float32).ravel()


def _mean_ratios(docs: DataFrame, text_col: str, ratios: np.ndarray, names: tuple[str, str]) -> DataFrame:
    """``docs`` with each text's ratio and number of events. The table sent out has ``CELLS`` floats."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            sums, sizes = [], []
            for codes in _event_lists(batch.column(place)):
                kinds = np.unique(codes)
                sums.append(float(table[kinds].sum(dtype=np.float64)))
                sizes.append(len(kinds))
            n = np.array(sizes, dtype=np.int64)
            mean = np.array(sums, dtype=np.float64) / (n + LENGTH_PRIOR)
            columns = [*batch.columns, pa.array(mean), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.LongType())])
    return docs.mapInArrow(run, schema)


def calibrate(ratio: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic of the label, by Newton's method."""
    prior = float(np.clip(label.mean(), 1e-4, 1 - 1e-4)) if len(label) else 1e-4
    if not 0 < label.sum() < len(label) or not ratio.std():
        return 0.0, float(np.log(prior / (1 - prior)))
    scale = 1 / ratio.std()
    x = np.stack([ratio * scale, np.ones(len(ratio))])
    w = np.array([1.0, np.log(prior / (1 - prior))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        gradient = x @ (label - p) - np.array([0.01, 0.0]) * w
        hessian = (x * (p * (1 - p))) @ x.T + np.diag([0.01, 1e-6])
        w = w + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(w[0] * scale), float(w[1])


@dataclass(frozen=True)
class ToxicityModel:
    """Log-ratios of all events, and the logistic over a text's mean ratio."""

    ratios: np.ndarray
    slope: float
    intercept: float

    def score(self, ratio: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(ratio * self.slope + self.intercept)))


def _fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def train_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> ToxicityModel:
    """A model of the labelled documents whose ``crc32(id) % 5`` is not 0."""
    rows = pick(docs, id=id_col, text=text_col)
    fold = _fold(F.col("id"))
    known = (
        pick(labels, id=id_col, toxic=label_col)
        .filter(F.col("toxic").isin(0, 1) & (fold != 0))
        .groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"), F.first(fold == 1).alias("cal"))
    )
    small = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    training = rows.join(F.broadcast(known) if small else known, "id")
    counts = np.zeros((4, CELLS))
    table = count_events(training.select("text", "toxic", "cal")).toPandas()  # at most CELLS rows
    counts[:, table["code"]] = table[["ordinary", "toxic", "ordinary_cal", "toxic_cal"]].to_numpy().T
    chosen = known.filter("cal").orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_ROWS)
    sample = rows.join(F.broadcast(chosen), "id").select("toxic", "text")
    held = _mean_ratios(sample, "text", log_ratios(counts[0] - counts[2], counts[1] - counts[3]), ("ratio", "n"))
    held = held.select("toxic", "ratio").toPandas()
    slope, intercept = calibrate(held["ratio"].to_numpy(), held["toxic"].to_numpy())
    return ToxicityModel(log_ratios(counts[0], counts[1]), slope, intercept)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """``id_col, held_out, score, predicted, log_ratio, n_events`` of every document.

    Rows with ``crc32(id) % 5 == 0`` are held out: their labels are never read. Rows
    without an id are scored and not held out.
    """
    model = train_toxicity(docs, labels, id_col, text_col, label_col)
    scored = _mean_ratios(pick(docs, id=id_col, text=text_col), "text", model.ratios, ("log_ratio", "n_events"))
    score = model.score(F.col("log_ratio"))
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(_fold(F.col("id")) == 0, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        "log_ratio",
        "n_events",
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """The documents, with all their columns, that score below one half."""
    model = train_toxicity(docs, labels, id_col, text_col, label_col)
    names = (fresh(docs, "log_ratio"), fresh(docs, "n_events"))
    scored = _mean_ratios(docs, text_col, model.ratios, names)
    return scored.filter(model.score(F.col(names[0])) < 0.5).drop(*names)
