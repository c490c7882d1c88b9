"""Sequence packing by vector best-fit over three capacities.

Tasks tokenise the documents and cut them into pieces; a piece needs tokens, one document
and ``length ** 2`` attention cost of a sequence. How many pieces there are of each length
is all that packing needs to know, so the plan is made from that histogram (at most
``capacity`` counts, whatever the corpus holds): lengths in falling order, each placed in
the feasible kind of open sequence with the least weighted norm (or the largest weighted
dot product) of its residual vector, many equal sequences at a time. Pieces then find
their place by length and rank; ranks are prefix sums of counts per task, so no task sees
more than its own part.

Defined cases: a null text is empty and packs as its end token; repeated rows are packed
each for itself; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushlake.llm.tables import pick, written
from hushlake.llm.words import cuts, text_buffers


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. The defaults leave tokens as the limit that binds."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"  # or "dot"


@dataclass
class Plan:
    """Steps of the plan: ``count`` pieces of ``length`` from ``rank`` on go, one each, to the
    sequences from ``sequence`` on, at ``offset``. Sorted by length and rank."""

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.length.astype(np.int64) << 40 | self.rank
        step = np.searchsorted(keys, length.astype(np.int64) << 40 | rank, side="right") - 1
        return self.sequence[step] + rank - self.rank[step], self.offset[step]


def plan_packing(counts: dict[int, int], capacity: Capacity) -> Plan:
    """Vector best-fit, lengths falling, over counts of equal pieces."""
    scale = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=float)
    weights = np.array(capacity.weights)
    open_kinds: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    steps: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(kind: tuple[int, int, int], first: int, n: int) -> None:
        if kind[0] > 0 and kind[1] > 0 and kind[2] > 0:
            open_kinds.setdefault(kind, []).append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        need = np.array([length, 1, length * length])
        left, rank = counts[length], 0
        while left:
            best = None
            if open_kinds:
                kinds = np.array(list(open_kinds))
                fits = (kinds >= need).all(axis=1)
                if fits.any():
                    fitting = kinds[fits]
                    if capacity.rule == "dot":
                        value = -((fitting / scale) * (need / scale) * weights).sum(axis=1)
                    else:
                        value = ((((fitting - need) / scale) ** 2) * weights).sum(axis=1)
                    order = np.lexsort((fitting[:, 2], fitting[:, 1], fitting[:, 0], value))
                    best = tuple(int(x) for x in fitting[order[0]])
            if best is None:
                each = int(min(capacity.tokens // length, capacity.documents, capacity.attention // (length * length)))
                if each < 1:
                    raise ValueError(f"a piece of {length} tokens exceeds the capacity")
                n = max(1, left // each)
                put((capacity.tokens, capacity.documents, capacity.attention), sequences, n)
                sequences += n
                continue
            ranges = open_kinds[best]
            first, n = ranges.pop()
            if not ranges:
                del open_kinds[best]
            used = min(n, left)
            if used < n:
                put(best, first + used, n - used)
            steps.append((length, rank, used, first, capacity.tokens - best[0]))
            put((best[0] - length, best[1] - 1, best[2] - length * length), first, used)
            rank, left = rank + used, left - used
    columns = np.array(sorted(steps), dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences)


@cache
def _encoder(ranks_path: str, pattern: str, vocabulary_path: str | None):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    added = {}
    if vocabulary_path is not None:
        with open(vocabulary_path, encoding="utf-8") as vocabulary:
            added = {t["content"]: t["id"] for t in json.load(vocabulary)["added_tokens"]}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


PIECES = "id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def token_pieces(
    docs: DataFrame, capacity: int, end_id: int, ranks_path: str, pattern: str, vocabulary_path: str | None, with_ids: bool
) -> DataFrame:
    """Every piece of ``docs(id, text)``, numbered per task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern, vocabulary_path)
        part = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            texts = batch.column("text")
            _, offsets = text_buffers(texts)
            for row, to in cuts(offsets):
                out: list[list] = [[] for _ in range(8)]
                for doc_id, text in zip(
                    batch.column("id")[row:to].to_pylist(), texts[row:to].to_pylist(), strict=True
                ):
                    ids = np.array([*encoder.encode(text or "", allowed_special="all"), end_id], dtype="<u4")
                    first = len(ids) % capacity or capacity
                    edges = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        raw = ids[a:b].tobytes()
                        row_of = (doc_id, k, a, b - a, zlib.crc32(raw), part, int(ranks[b - a]), raw)
                        for column, value in zip(out, row_of, strict=True):
                            column.append(value)
                        ranks[b - a] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = [*(f.split()[0] for f in PIECES.split(", ")), "ids"]
                n = len(kinds) if with_ids else len(kinds) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(out[:n], kinds[:n], strict=True)], names=names[:n]
                )

    return docs.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: Capacity = Capacity(),
    end_id: int = 2,
    ranks_path: str | None = None,
    pattern: str | None = None,
    with_ids: bool = False,
    vocabulary_path: str | None = None,
) -> DataFrame:
    """One row per piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``.

    ``ranks_path`` and ``pattern`` name a byte-level vocabulary as merge ranks, by default
    the public one of 50,257 ids. ``vocabulary_path`` names the JSON file whose added tokens
    are single ids wherever a text holds them. ``with_ids`` adds the ids as little-endian
    uint32 bytes.
    """
    if ranks_path is None or pattern is None:
        import public_tokenizers

        if ranks_path is None:
            vocabulary_path = vocabulary_path or public_tokenizers.path("byte_bpe_50k.json")
        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    pieces = written(token_pieces(rows, capacity.tokens, end_id, ranks_path, pattern, vocabulary_path, with_ids), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(
        per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"), "n"),
        "piece-ranks",
    )
    totals = starts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row per length
    plan = plan_packing({r["length"]: r["n"] for r in totals}, capacity)
    sent = docs.sparkSession.sparkContext.broadcast(plan)
    ranked = pieces.join(starts.drop("n"), ["part", "length"]).withColumn(
        "rank", F.col("rank_before") + F.col("local_rank")
    )
    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = sent.value.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    schema = "id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids
    placed = ranked.select(*names, "rank").mapInArrow(run, schema + "sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
