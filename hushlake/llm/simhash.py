"""Near-duplicate documents by SimHash, found through deletion-variant signatures.

One Python pass makes a 64-bit fingerprint of every whole text: XXH64 of every 4-word shingle,
a bit set where more than half of them have it. Texts of one fingerprint are one class.

Two fingerprints that differ in at most 4 bits, cut into 3 segments, differ in at most one bit
of some segment. So each fingerprint is indexed under 64 signatures, one for each bit: its
segment with that bit deleted (a wildcard). Signatures are sorted over the cluster by range,
equal ones lie side by side and are compared where they lie, on all 64 bits.

A signature of many fingerprints, or one that a task's border cuts, is compared apart. Beyond
``TILE`` members it goes through another cut: the bits outside its segment are cut into 3 again,
by the same argument, so each of its fingerprints is indexed under the signature and a variant
of the rest. What is still that large is a cluster of true neighbours; it is dealt to tiles of
bounded size, and pairs of tiles are compared. A comparison gives links that join something,
never all pairs.

Defined cases: a text with fewer words than a shingle is one shingle; a null text or one without
words has fingerprint zero and is linked like any other. A row without an id has its fingerprint
and a null component, and links nothing. Repeated rows share id and results. Empty tables give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.llm.components import components
from hushlake.llm.tables import pick, written
from hushlake.llm.words import LOWER, blocks, ranges

SHINGLE, SEED = 4, 42
MOST_BITS, SEGMENTS = 4, 3
#: fingerprints of a signature that are compared where they lie; in one group; cuts before tiles
BUCKET, TILE, CUTS = 128, 1024, 2
#: shingles hashed at a time
SLICE = 1 << 16

# XXH64's primes (fixed values of its specification)
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _rounded(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turned(acc + lane * _P2, 31) * _P1


def xxh64_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of every byte range of ``data``; ranges may overlap."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    fours = np.ndarray(len(data) + 1, dtype="<u4", buffer=padded, strides=(1,))
    length = end - start
    h = np.full(len(start), np.uint64(seed) + _P5, dtype=np.uint64)
    at = start.copy()
    with np.errstate(over="ignore"):
        wide = np.flatnonzero(length >= 32)
        if len(wide):
            first = np.uint64(seed)
            acc = [np.full(len(wide), x, dtype=np.uint64) for x in (first + _P1 + _P2, first + _P2, first, first - _P1)]
            left = np.arange(len(wide))
            while len(left):
                rows = wide[left]
                for k in range(4):
                    acc[k][left] = _rounded(acc[k][left], eights[at[rows] + 8 * k])
                at[rows] += 32
                left = left[end[rows] - at[rows] >= 32]
            mixed = sum((_turned(a, b) for a, b in zip(acc, (1, 7, 12, 18), strict=True)), np.uint64(0))
            for a in acc:
                mixed = (mixed ^ _rounded(np.zeros(len(wide), dtype=np.uint64), a)) * _P1 + _P4
            h[wide] = mixed
        h += length.astype(np.uint64)
        rows = np.flatnonzero(end - at >= 8)
        while len(rows):
            h[rows] = _turned(h[rows] ^ _rounded(np.zeros(len(rows), dtype=np.uint64), eights[at[rows]]), 27) * _P1 + _P4
            at[rows] += 8
            rows = rows[end[rows] - at[rows] >= 8]
        rows = np.flatnonzero(end - at >= 4)
        h[rows] = _turned(h[rows] ^ fours[at[rows]].astype(np.uint64) * _P1, 23) * _P2 + _P3
        at[rows] += 4
        rows = np.flatnonzero(end > at)
        while len(rows):
            h[rows] = _turned(h[rows] ^ padded[at[rows]].astype(np.uint64) * _P5, 11) * _P1
            at[rows] += 1
            rows = rows[end[rows] > at[rows]]
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


_BITS = np.arange(64, dtype=np.uint64)


def fingerprints(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text, in order."""
    found = [np.zeros(0, dtype=np.uint64)]
    for block in blocks(column):
        n_words = block.hi - block.lo
        # a shingle begins at each word but the last ones; a short text is one shingle
        width = np.minimum(n_words, SHINGLE)
        n_shingles = np.where(n_words > 0, n_words - width + 1, 0)
        doc = np.repeat(np.arange(len(block)), n_shingles)
        first = ranges(block.lo, n_shingles)
        last = first + np.repeat(width, n_shingles) - 1
        set_bits = np.zeros((len(block), 64), dtype=np.int64)
        for a in range(0, len(first), SLICE):
            f, z, d = first[a : a + SLICE], last[a : a + SLICE], doc[a : a + SLICE]
            w0, w1 = f[0], z.max() + 1
            start, size = block.start[w0:w1], block.end[w0:w1] - block.start[w0:w1]
            to = np.cumsum(size + 1) - (size + 1)
            joined = np.full(int(size.sum()) + len(size), 0x20, dtype=np.uint8)
            joined[ranges(to, size)] = LOWER[block.data[ranges(start, size)]]
            h = xxh64_spans(joined, to[f - w0], to[z - w0] + size[z - w0])
            heads = np.flatnonzero(np.diff(d, prepend=-1))
            for bit in range(64):
                set_bits[d[heads], bit] += np.add.reduceat((h >> np.uint64(bit) & np.uint64(1)).astype(np.int64), heads)
        over = 2 * set_bits > n_shingles[:, None]
        found.append((over.astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64))
    return np.concatenate(found)


def _fingerprinted(docs: DataFrame) -> DataFrame:
    """``id, fp`` of ``docs(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints(batch.column("text")).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.int64())], names=["id", "fp"])

    return docs.mapInArrow(run, "id long, fp long")


def segments(bits: list[int]) -> list[list[int]]:
    """Bit numbers cut into ``SEGMENTS`` neighbouring segments."""
    cut = [round(k * len(bits) / SEGMENTS) for k in range(SEGMENTS + 1)]
    return [bits[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def deletion_variants(bits: list[int]) -> list[tuple[int, int, int]]:
    """``(segment, deleted bit, mask)`` of all signatures of some bits."""
    return [
        (k, bit, _signed(sum(1 << b for b in segment if b != bit)))
        for k, segment in enumerate(segments(bits))
        for bit in segment
    ]


def bits_left(cut: tuple[int, ...]) -> list[int]:
    """The bits outside the segments that were chosen cut after cut."""
    bits = list(range(64))
    for k in cut:
        chosen = segments(bits)[k]
        bits = [b for b in bits if b not in chosen]
    return bits


def _variants(cut: tuple[int, ...]) -> Column:
    listed = ", ".join(f"struct({k} as k, {bit} as bit, {mask}L as mask)" if mask != -(1 << 63) else
                       f"struct({k} as k, {bit} as bit, -9223372036854775807L - 1L as mask)" for k, bit, mask in deletion_variants(bits_left(cut)))
    return F.expr(f"array({listed})")


def _indexed(members: DataFrame, depth: int) -> DataFrame:
    """``key, cut, fp``: members (``key, cut, fp``; the first time only ``fp``) under the variants of
    the bits that their cuts left. ``cut`` numbers the chosen segments in base ``SEGMENTS``."""
    if depth == 0:
        each = members.select("fp", F.lit(0).alias("cut"), F.lit(0).cast("long").alias("key"), F.explode(_variants(())).alias("v"))
    else:
        paths = [()]
        for _ in range(depth):
            paths = [(*p, k) for p in paths for k in range(SEGMENTS)]
        lists = F.when(F.lit(False), _variants(paths[0]))
        for number, path in enumerate(paths):
            lists = lists.when(F.col("cut") == number, _variants(path))
        each = members.select("fp", "cut", "key", F.explode(lists).alias("v"))
    return each.select(
        F.xxhash64("key", "v.k", "v.bit", F.col("fp").bitwiseAND(F.col("v.mask"))).alias("key"),
        (F.col("cut") * SEGMENTS + F.col("v.k")).alias("cut"),
        "fp",
    )


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as join what ``a[i] - b[i]`` join: every node to the least of its component."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def run_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of one key; rows are sorted by key."""
    bits = fp.view(np.uint64)
    found_a, found_b = [], []
    at, gap = np.arange(len(key)), 1
    while len(at):
        at = at[at + gap < len(key)]
        at = at[key[at] == key[at + gap]]
        near = at[np.bitwise_count(bits[at] ^ bits[at + gap]) <= MOST_BITS]
        near = near[fp[near] != fp[near + gap]]
        found_a.append(fp[near])
        found_b.append(fp[near + gap])
        gap += 1
    return spanning_links(np.concatenate([*found_a, fp[:0]]), np.concatenate([*found_b, fp[:0]]))


def _compared(indexed: DataFrame) -> DataFrame:
    """``a, b`` links of signatures that lie whole in a task and are no larger than ``BUCKET``; the
    members of the others come with ``key, cut`` and their fingerprint as ``a``."""
    ordered = indexed.repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, 3), dtype=np.int64)
        first = True
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "cut", "fp")], axis=1)
            rows = np.concatenate((kept, rows))
            # the last run may go on in the next batch, but a large one need not wait for it
            edge = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            whole, kept = rows[:edge], rows[edge:]
            if len(whole):
                yield from judged(whole, first, False)
                first = False
            while len(kept) > 2 * BUCKET:
                yield over(kept[: -BUCKET - 1])
                kept = kept[-BUCKET - 1 :]
        if len(kept):
            yield from judged(kept, first, True)

    def judged(rows: np.ndarray, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        key = rows[:, 0]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(heads, len(key)))
        large = size > BUCKET
        large[0] |= first
        large[-1] |= last
        alone = size == 1
        yield over(rows[np.repeat(large, size)])
        near = rows[np.repeat(~large & ~alone, size)]
        a, b = run_links(near[:, 0], np.ascontiguousarray(near[:, 2]))
        yield batch_of(a, b, None, None)

    def over(rows: np.ndarray) -> pa.RecordBatch:
        return batch_of(rows[:, 2], None, rows[:, 0], rows[:, 1])

    def batch_of(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None, cut: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        columns = [pa.array(a, pa.int64()), *(none if x is None else pa.array(x, pa.int64()) for x in (b, key, cut))]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key", "cut"])

    return ordered.mapInArrow(run, "a long, b long, key long, cut long")


def _tile_links(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links of the last large signatures: every pair of tiles of a key is one group."""
    dealt = members.join(sizes, "key").select(
        "key", "fp", F.expr(f"cast(ceil(n / {TILE}) as int)").alias("n_tiles")
    ).withColumn("tile", F.expr("cast(pmod(xxhash64(fp), n_tiles) as int)"))
    tiled = dealt.select("key", "fp", "tile", F.explode(F.expr("sequence(0, n_tiles - 1)")).alias("other")).select(
        "key", "fp", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"),
    )

    def run(table: pa.Table) -> pa.Table:
        fp = np.unique(table.column("fp").to_numpy())
        bits = fp.view(np.uint64)
        a, b = [fp[:0]], [fp[:0]]
        for k in range(len(fp) - 1):
            near = k + 1 + np.flatnonzero(np.bitwise_count(bits[k + 1 :] ^ bits[k]) <= MOST_BITS)
            a.append(np.full(len(near), fp[k]))
            b.append(fp[near])
        a, b = spanning_links(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tiled.groupBy("key", "t1", "t2").applyInArrow(run, "a long, b long")


def near_links(prints: DataFrame) -> DataFrame:
    """``a, b``: links that join all of ``prints(fp)`` (distinct) within ``MOST_BITS`` bits."""
    members, links = prints, None
    for depth in range(CUTS):
        compared = written(_compared(_indexed(members, depth)), "simhash-compared")
        found = compared.filter("b is not null").select("a", "b")
        links = found if links is None else links.unionByName(found)
        over = compared.filter("key is not null").select("key", F.col("cut").cast("int").alias("cut"), F.col("a").alias("fp"))
        sizes = over.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        members = written(over.join(sizes, "key"), "simhash-large")
        # what only a border cut is compared at once
        links = links.unionByName(_tile_links(members.filter(f"n <= {TILE}").drop("n"), sizes.filter(f"n <= {TILE}")))
        members = members.filter(f"n > {TILE}").drop("n")
        if not members.limit(1).count():
            return links
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return links.unionByName(_tile_links(members.select("key", "fp"), sizes))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row of ``docs``: 16 hex digits, and the
    smallest id that is reached over fingerprints within ``MOST_BITS`` bits."""
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    signed = written(_fingerprinted(rows), "simhash-fingerprints")
    classes = written(signed.filter("id is not null").groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    linked = components(near_links(classes.select("fp")), "simhash-links")
    grouped = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    resolved = grouped.select("fp", "component").join(roots, "component").select("fp", "component_id")
    return signed.join(resolved, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.expr("if(id is null, null, component_id)").alias("component_id"),
    )
