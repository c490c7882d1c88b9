"""Near-duplicate documents by b-bit MinHash.

One Python pass makes a signature per document: the minima of ``BANDS * ROWS`` hash
functions over its word shingles, kept as band hashes and as packed low bits of every
minimum. Texts with the same shingle set form one class, so exact copies never meet each
other. Classes that share a band are candidates: inside a bucket their packed signatures
estimate the similarity by bit counts, corrected for chance collisions of low bits, and pairs
whose estimate may reach the threshold are joined, each only where it joins something new.
The components of these links are the candidate clusters, so chance meetings in a band do not
make clusters grow with the corpus. No text is moved for this step.

Clusters are compared in tiles: the classes of a cluster are dealt to groups of bounded
size, and each pair of groups is one task group. There pairs whose estimate may reach the
threshold are confirmed on their full shingle sets. A tile returns only links that join
something new, never all pairs of a group.

Defined cases: a null or empty text has no shingles and is linked with nothing; a text with
fewer words than a shingle is one shingle. A row with a null id is linked with nothing, has
a null component and is kept. Repeated rows share their id and all their results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.llm.components import components
from hushlake.llm.tables import fresh, pick, written
from hushlake.llm.words import blocks, mix, random_words, window_hash

#: At a similarity of 0.8 a pair shares no band with probability (1 - 0.8**5)**36 < 1e-6.
BANDS, ROWS = 36, 5
HASHES = BANDS * ROWS
BITS = 2
SIGNATURE_WORDS = -(-HASHES * BITS // 64)
#: Estimates this many standard deviations below the threshold are still confirmed.
SLACK = 5.0
TILE_CLASSES, TILE_SHINGLES = 256, 400_000
#: Classes of one band bucket whose signatures are compared at once.
BUCKET_TILE = 1024

_FACTORS = (random_words(HASHES, 11) & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_MASKS = (random_words(HASHES, 12) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text, in order."""
    for block in blocks(column):
        words = block.hashes()
        at = block.windows(size)
        shingles = window_hash(words, at, range(size))
        to = np.searchsorted(at, block.hi)
        frm = np.searchsorted(at, block.lo)
        for d in range(len(block)):
            if frm[d] < to[d]:
                yield np.unique(shingles[frm[d] : to[d]])
            elif block.lo[d] < block.hi[d]:
                whole = np.arange(block.lo[d], block.hi[d])
                yield window_hash(words, block.lo[d : d + 1], range(len(whole)), seed=3)
            else:
                yield np.zeros(0, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 512):
        part = low[at : at + 512]
        np.minimum(best, ((part[None, :] ^ _MASKS[:, None]) * _FACTORS[:, None]).min(axis=1), out=best)
    return best


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and the packed low bits of the minima of a set that is not empty."""
    mixed = mix(minima(shingles).astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32)))
    banded = window_hash(mixed, np.arange(0, HASHES, ROWS), range(ROWS), seed=4)
    bits = np.zeros(SIGNATURE_WORDS * 64 // BITS, dtype=np.uint64)
    bits[:HASHES] = mixed & np.uint64((1 << BITS) - 1)
    shifts = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    return banded, np.bitwise_or.reduce(bits.reshape(SIGNATURE_WORDS, -1) << shifts, axis=1)


def agreeing(packed: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many minima agree in their low bits."""
    unlike = packed ^ other
    folded = unlike
    for shift in range(1, BITS):
        folded = folded | (unlike >> np.uint64(shift))
    once = np.uint64(int("".join(["0" * (BITS - 1) + "1"] * (64 // BITS)), 2))
    return HASHES - np.bitwise_count(folded & once).sum(axis=-1, dtype=np.int64)


def estimate(agree: np.ndarray) -> np.ndarray:
    """Similarity from agreeing minima, corrected for chance agreement of low bits."""
    chance = 0.5**BITS
    return (agree / HASHES - chance) / (1 - chance)


def least_agreement(similarity: float) -> float:
    """Agreeing minima below which a pair of that similarity is practically impossible."""
    p = similarity + (1 - similarity) * 0.5**BITS
    return HASHES * p - SLACK * np.sqrt(HASHES * p * (1 - p))


SIGNATURES = "id long, text_key long, n_shingles long, d1 long, d2 long, bands array<long>, packed array<long>"


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """One row per document; ``docs`` has ``id`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, bands, packed, filled = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), shingle):
                n.append(len(s))
                filled.append(len(s) > 0)
                if len(s):
                    order = np.arange(len(s), dtype=np.uint64)
                    digests.append([int(np.sum(mix(s + order)) >> np.uint64(1)), int(np.bitwise_xor.reduce(mix(s)) >> np.uint64(1))])
                    b, p = signature(s)
                    bands.append(b.view(np.int64))
                    packed.append(p.view(np.int64))
                else:
                    digests.append([0, 0])
            ones = np.array(filled, dtype=np.int64)
            d = np.array(digests, dtype=np.int64).reshape(-1, 2)

            def lists(rows: list[np.ndarray], width: int) -> pa.Array:
                at = np.concatenate(([0], np.cumsum(ones * width))).astype(np.int32)
                flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))

            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists(bands, BANDS), lists(packed, SIGNATURE_WORDS)],
                names=["id", "text_key", "n_shingles", "d1", "d2", "bands", "packed"],
            )

    return docs.mapInArrow(run, SIGNATURES)


def likely_links(group: np.ndarray, sizes: np.ndarray, packed: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``x, y`` of one group whose signatures allow a link; groups are sorted.

    Only pairs that join something new are returned: every row stays linked to the row that its
    label names, and pairs of equal labels are left out.
    """
    label = np.arange(len(group))
    least = least_agreement(percent / 100)
    xs, ys = [], []

    def join(x: np.ndarray, y: np.ndarray) -> None:
        new = label[x] != label[y]
        x, y = x[new], y[new]
        fits = 100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])
        x, y = x[fits], y[fits]
        near = agreeing(packed[x], packed[y]) >= least
        xs.append(x[near])
        ys.append(y[near])
        label[y[near]] = label[x[near]]
        while (label[label] != label).any():
            label[:] = label[label]

    # first with the first row of the group, so that a group of near copies becomes a star
    x = np.arange(len(group))
    first = np.searchsorted(group, group)
    join(first[first < x], x[first < x])
    for step in range(1, len(group)):
        x = x[x + step < len(group)]
        x = x[group[x] == group[x + step]]  # the longer groups
        if not len(x):
            break
        join(x, x + step)
    return np.concatenate([np.zeros(0, np.int64), *xs]), np.concatenate([np.zeros(0, np.int64), *ys])


def _bucket_links(grouped: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of ``grouped(place, node, n_shingles, packed)``: likely links within equal places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros((0, SIGNATURE_WORDS), np.uint64)]

        def links(part: list[np.ndarray]) -> pa.RecordBatch:
            x, y = likely_links(part[0], part[2], part[3], percent)
            return pa.RecordBatch.from_arrays([pa.array(part[1][x]), pa.array(part[1][y])], names=["a", "b"])

        for batch in batches:
            place, node, size = (batch.column(c).to_numpy() for c in ("place", "node", "n_shingles"))
            packed = batch.column("packed").flatten().to_numpy().view(np.uint64).reshape(-1, SIGNATURE_WORDS)
            held = [np.concatenate(c) for c in zip(held, (place, node, size, packed), strict=True)]
            # the last place may go on in the next batch
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if whole:
                yield links([c[:whole] for c in held])
                held = [c[whole:] for c in held]
        yield links(held)

    return grouped.select("place", "node", "n_shingles", "packed").mapInArrow(run, "a long, b long")


def _candidate_clusters(classes: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of classes joined by pairs that share a band and whose signatures allow a link.

    A bucket of more classes than ``BUCKET_TILE`` is dealt to tiles that meet pair by pair.
    """
    banded = classes.select("node", F.posexplode("bands").alias("band", "hash")).select(
        "node", F.xxhash64("band", "hash").alias("bucket")
    )
    shared = banded.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET_TILE).cast("int").alias("n_tiles"), F.count(F.lit(1)).alias("n"))
    tiled = (
        banded.join(shared.filter("n > 1").drop("n"), "bucket")
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("n_tiles")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, n_tiles - 1)")))
        .select("node", F.xxhash64("bucket", F.least("tile", "other"), F.greatest("tile", "other")).alias("place"))
    )
    grouped = tiled.join(classes.select("node", "n_shingles", "packed"), "node").repartition("place").sortWithinPartitions("place", "node")
    return components(_bucket_links(grouped, percent), "near-candidates")


class _Sets:
    """Union-find over the rows of a tile."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def tile_links(ids: np.ndarray, side: np.ndarray, packed: np.ndarray, sets: list[np.ndarray], percent: int, within: bool) -> list[tuple[int, int]]:
    """Links between two groups of classes (or within one) that join their components."""
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((ids, side))
    rows = order if within else order[side[order] == 0]
    columns = order if within else order[side[order] == 1]
    least = least_agreement(percent / 100)
    found = []
    for k, x in enumerate(rows):
        others = columns[k + 1 :] if within else columns
        small, large = np.minimum(sizes[x], sizes[others]), np.maximum(sizes[x], sizes[others])
        agree = agreeing(packed[x], packed[others])
        near = np.flatnonzero((agree >= least) & (100 * small >= percent * large))
        found.extend((-int(agree[j]), int(x), int(others[j])) for j in near)
    groups, links = _Sets(len(ids)), []
    for _, x, y in sorted(found):
        if groups.root(x) == groups.root(y):
            continue
        a, b = (sets[x], sets[y]) if sizes[x] <= sizes[y] else (sets[y], sets[x])
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        both = int((b[at] == a).sum())
        if 100 * both >= percent * (len(a) + len(b) - both):
            groups.join(x, y)
            links.append((int(ids[x]), int(ids[y])))
    return links


def _tiles(members: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Confirmed links ``a, b`` among ``members(node, cluster, n_shingles, packed, text)``."""
    load = members.groupBy("cluster").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / TILE_CLASSES, F.sum("n_shingles") / TILE_SHINGLES)).cast("int").alias("n_tiles")
    )
    dealt = members.join(load, "cluster").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("n_tiles")).cast("int"))
    tiled = dealt.select(
        "cluster", "node", "packed", "text", "tile", F.explode(F.expr("sequence(0, n_tiles - 1)")).alias("other")
    ).select(
        "cluster", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"),
        F.expr("cast(tile > other as int)").alias("side"), "node", "packed", "text",
    )

    def run(table: pa.Table) -> pa.Table:
        sets = list(shingle_sets(table.column("text"), shingle))
        packed = np.array(table.column("packed").to_pylist(), dtype=np.int64).view(np.uint64)
        within = table.column("t1")[0].as_py() == table.column("t2")[0].as_py()
        links = tile_links(table.column("node").to_numpy(), table.column("side").to_numpy(), packed, sets, percent, within)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tiled.groupBy("cluster", "t1", "t2").applyInArrow(run, "a long, b long")


def _grouped(rows: DataFrame, percent: int, shingle: int) -> DataFrame:
    """``id, text_key, n_shingles, first`` of ``rows(id, text_key, text)``: ``first`` is the smallest
    ``(id, text_key)`` that a text reaches over links, null where there is nothing to link."""
    signed = written(
        signatures(rows, shingle).withColumn("node", F.xxhash64("n_shingles", "d1", "d2")), "near-signatures"
    )
    keyed = signed.filter("n_shingles > 0 and id is not null")
    # copies are aggregated before the shuffle; one of them stands for the class
    classes = written(
        keyed.groupBy("node").agg(
            F.min("n_shingles").alias("n_shingles"),
            F.min(F.struct("id", "text_key")).alias("least"),
            F.first("bands").alias("bands"),
            F.first("packed").alias("packed"),
        ),
        "near-classes",
    )
    clusters = _candidate_clusters(classes, percent)
    candidates = classes.join(clusters.withColumnRenamed("component", "cluster"), "node").select(
        "node", "cluster", "n_shingles", "packed", "least.id", "least.text_key"
    )
    members = candidates.join(rows, ["id", "text_key"]).drop("id", "text_key")
    linked = components(_tiles(members, percent, shingle), "near-links")
    grouped = classes.select("node", "least").join(linked, "node")
    least = grouped.groupBy("component").agg(F.min("least").alias("first"))
    resolved = grouped.select("node", "component").join(least, "component").select("node", "first").unionByName(
        classes.join(linked, "node", "left_anti").select("node", F.col("least").alias("first"))
    )
    return signed.select("id", "text_key", "n_shingles", "node").join(resolved, "node", "left").select(
        "id", "text_key", "n_shingles", F.expr("case when n_shingles > 0 and id is not null then first end").alias("first")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(docs, id=id_col, text=text_col).select(
        F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("text_key")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 4
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` on their shingle sets;
    ``component_id`` is the smallest id that a document reaches over links.
    """
    return _grouped(_keyed(docs, id_col, text_col), percent, shingle).select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.expr("coalesce(first.id, id)").alias("component_id"),
        F.expr("first is null or id = first.id").alias("kept"),
    )


def keep_representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5
) -> DataFrame:
    """One document of each component, with all its columns: of the smallest id, and of its texts
    that are linked the one of the smallest hash.

    Rows that repeat an id and its text stay once; texts of one id that are not linked all stay,
    and so do rows without an id.
    """
    found = _grouped(_keyed(docs, id_col, text_col), percent, shingle)
    kept = found.filter("id is not null and (first is null or struct(id, text_key) = first)")
    key, wanted = fresh(docs, "text_key"), fresh(docs, "kept_id")
    kept = kept.select(F.col("id").alias(wanted), F.col("text_key").alias(key)).distinct()
    quoted = F.col("`" + id_col.replace("`", "``") + "`")
    keyed = docs.withColumn(key, F.xxhash64(F.col("`" + text_col.replace("`", "``") + "`"))).withColumn(wanted, quoted.cast("long"))
    one_each = keyed.join(kept, [wanted, key], "left_semi").dropDuplicates([wanted, key])
    return one_each.unionByName(keyed.filter(F.col(wanted).isNull())).select(*docs.columns)
