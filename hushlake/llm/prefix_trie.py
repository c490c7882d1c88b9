"""The prefix trie of conversations by truncation peeling.

A conversation is a path: one 16-byte digest per turn. Paths with their conversation ids are
sorted over the cluster (range partitions, so a path of any number of conversations, or a first
turn of a third of them, lies in as many tasks as it needs) and cut into chunks of bounded
size. A chunk is peeled from its greatest depth: the conversations that end there join the
nodes that survive from below, equal ones are merged, every node is finished and aggregated as
it is found, its last turn is stripped, and the survivors are regrouped one turn higher.

Only the prefixes of a chunk's first and last path can lie in other chunks too. These few rows
(two paths a chunk) are merged over chunks by digest. What a chunk counted with its own rows
alone is put right by corrections (a child counted by two chunks, a turn saved between them, a
leaf that continues in the next chunk), which rise over the shared prefixes.

Defined cases: null roles and texts are empty; null turns come first, and rows of one turn are
ordered by the digest of role and text, repeated ones included. Rows without a conversation id
belong to no conversation. An empty table has no root and gives no rows. A conversation is one
row of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.llm.tables import pick, written

#: a source conversation is the first of so many; at most HEADS - 1 of its turns are taken
FAMILY, HEADS = 5, 9
DIGEST = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt_conversations(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, path, sizes``: the digests of the rebuilt turns, joined, and the bytes of their texts.

    Conversations of a family meet in one shuffle, as digests: a text never leaves its task.
    """
    said = pick(conversations, conv_id=id_col, turn=turn_col, role=role_col, text=text_col).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    turns = said.select(
        "conv_id",
        F.expr(f"conv_id - conv_id % {FAMILY}").alias("source"),
        F.struct(
            "turn",
            F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"),
            F.octet_length("text").alias("size"),
        ).alias("said"),
    )
    own = turns.repartition("source").groupBy("source", "conv_id").agg(F.sort_array(F.collect_list("said")).alias("own"))
    families = own.groupBy("source").agg(
        F.collect_list(F.struct("conv_id", "own")).alias("members"),
        F.coalesce(
            F.max(F.expr(f"if(conv_id = source, slice(own, 1, {HEADS - 1}), null)")),
            F.expr("cast(array() as array<struct<turn:bigint,digest:string,size:int>>)"),
        ).alias("head"),
    )
    each = families.select("head", F.inline("members")).withColumn(
        "h", F.expr(f"cast(crc32(cast(conv_id as string)) % {HEADS} as int)")
    )
    rebuilt = each.select("conv_id", F.expr("concat(slice(head, 1, h), slice(own, h + 1, size(own)))").alias("r"))
    return rebuilt.select(
        "conv_id", F.expr("unhex(array_join(r.digest, ''))").alias("path"), F.expr("r.size").alias("sizes")
    )


def common_prefixes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Equal leading turns of each path and the one before it; -1 for the first.

    ``data``: digests as rows of two numbers; ``at``: where each path begins, and the end.
    """
    out = np.full(len(at) - 1, -1, dtype=np.int64)
    length = np.diff(at)
    low = np.minimum(length[1:], length[:-1])
    left = np.arange(1, len(out))
    out[1:] = low
    depth = 0
    while len(left):
        left = left[low[left - 1] > depth]
        same = (data[at[left] + depth] == data[at[left - 1] + depth]).all(axis=1)
        out[left[~same]] = depth
        left = left[same]
        depth += 1
    return out


def peel(length: np.ndarray, shared: np.ndarray, least: np.ndarray, count: np.ndarray, size_of: Callable) -> dict[str, np.ndarray]:
    """All nodes of sorted distinct paths, deepest first.

    ``length`` of each path, ``shared`` turns with the path before it, smallest member ``least``
    and ``count`` of conversations that end there; ``size_of(rows, depth)`` gives the text bytes
    of turn ``depth``. Returns columns of nodes: ``row`` (the first path below the node), ``depth``,
    ``parent`` (its index), ``ends`` (the path that ends here), whether it lies on the
    ``first_path`` or ``last_path``, and the aggregates.
    """
    by_length = np.argsort(-length, kind="stable")
    deepest = int(length.max())
    starts = np.searchsorted(-length[by_length], -np.arange(deepest, -2, -1))
    none = np.zeros(0, dtype=np.int64)
    alive = {k: none for k in ("row", "least", "n", "leaves", "saved", "node")}
    made: list[dict[str, np.ndarray]] = []
    total = 0
    for k, depth in enumerate(range(deepest, -1, -1)):
        ended = by_length[starts[k] : starts[k + 1]]
        zero = np.zeros(len(ended), dtype=np.int64)
        joined = {
            "row": np.concatenate((alive["row"], ended)), "least": np.concatenate((alive["least"], least[ended])),
            "n": np.concatenate((alive["n"], count[ended])), "leaves": np.concatenate((alive["leaves"], zero)),
            "saved": np.concatenate((alive["saved"], zero)), "node": np.concatenate((alive["node"], zero - 1)),
        }
        order = np.argsort(joined["row"], kind="stable")
        joined = {c: v[order] for c, v in joined.items()}
        head = np.flatnonzero(shared[joined["row"]] < depth)
        child = joined["node"] >= 0
        row = joined["row"][head]
        n = np.add.reduceat(joined["n"], head)
        children = np.add.reduceat(child.astype(np.int64), head)
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
        ends_here = np.full(len(head), -1, dtype=np.int64)
        ends_here[group[~child]] = joined["row"][~child]
        alive = {
            "row": row, "least": np.minimum.reduceat(joined["least"], head), "n": n,
            "leaves": np.add.reduceat(joined["leaves"], head) + (children == 0),
            "saved": np.add.reduceat(joined["saved"], head) + (n - 1) * (size_of(row, depth) if depth else 0),
            "node": total + np.arange(len(head)),
        }
        made.append({**alive, "depth": np.full(len(head), depth), "children": children, "ends": ends_here, "parent": np.full(len(head), -1)})
        # children know their parent now: nodes are numbered in the order in which they are made
        if k:
            made[-2]["parent"][joined["node"][child] - made[-2]["node"][0]] = total + group[child]
        total += len(head)
    nodes = {c: np.concatenate([m[c] for m in made]) for c in made[0]}
    # turns that all paths after a row share with it
    after = np.append(np.minimum.accumulate(shared[::-1])[::-1][1:], np.iinfo(np.int64).max)
    nodes["first_path"] = nodes["row"] == 0
    nodes["last_path"] = after[nodes["row"]] >= nodes["depth"]
    return nodes


NODES = (
    "chunk long, node_key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, bytes long, ends string, own_leaf long"
)


def _prefix_keys(path: bytes) -> list[bytes]:
    """A digest of every prefix of a path, the empty one first."""
    state, keys = hashlib.blake2b(digest_size=DIGEST), []
    keys.append(state.digest())
    for at in range(0, len(path), DIGEST):
        state.update(path[at : at + DIGEST])
        keys.append(state.copy().digest())
    return keys


def _peeled(sorted_paths: DataFrame) -> DataFrame:
    """The nodes of every chunk (an Arrow batch) of ``conv_id, path, sizes`` in path order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(b for b in batches if len(b)):
            yield peel_chunk(batch, (part << 32) + number)

    return sorted_paths.mapInArrow(run, NODES)


def peel_chunk(batch: pa.RecordBatch, chunk: int) -> pa.RecordBatch:
    conv = batch.column("conv_id").to_numpy()
    path, sizes = batch.column("path"), batch.column("sizes")
    raw = np.frombuffer(path.buffers()[2], np.uint8) if path.buffers()[2] else np.zeros(0, np.uint8)
    at = np.frombuffer(path.buffers()[1], np.int32)[path.offset : path.offset + len(path) + 1].astype(np.int64)
    data = np.ascontiguousarray(raw[at[0] : at[-1]]).view(np.uint64).reshape(-1, 2)
    at = (at - at[0]) // DIGEST
    flat = sizes.flatten().to_numpy()
    shared = common_prefixes(data, at)
    length = np.diff(at)
    same = np.zeros(len(conv), dtype=bool)
    same[1:] = (shared[1:] == length[1:]) & (length[1:] == length[:-1])
    head = np.flatnonzero(~same)
    run_end = np.append(head[1:], len(conv))
    nodes = peel(
        length[head], shared[head], np.minimum.reduceat(conv, head), run_end - head,
        lambda rows, depth: flat[at[head[rows]] + depth - 1].astype(np.int64),
    )
    spine = nodes["first_path"] | nodes["last_path"]
    keys = {True: _prefix_keys(path[0].as_py()), False: _prefix_keys(path[len(path) - 1].as_py())}

    def key(node: int) -> bytes:
        return keys[bool(nodes["first_path"][node])][nodes["depth"][node]]

    n = len(nodes["row"])
    node_key, parent_key, ends, sha = [None] * n, [None] * n, [None] * n, [NO_ENDS] * n
    for node in np.flatnonzero(nodes["ends"] >= 0).tolist():
        row = int(nodes["ends"][node])
        joined = ",".join(map(str, conv[head[row] : run_end[row]].tolist()))
        if spine[node]:
            ends[node], sha[node] = joined, None
        else:
            sha[node] = hashlib.sha256(joined.encode()).hexdigest()
    for node in np.flatnonzero(spine).tolist():
        node_key[node] = key(node)
    parent = nodes["parent"]
    parent_conv = np.where(parent >= 0, nodes["least"][parent], 0)
    unknown = np.where(parent >= 0, spine[parent], True)
    for node in np.flatnonzero(unknown & (parent >= 0)).tolist():
        parent_key[node] = key(int(parent[node]))
    depth = nodes["depth"]
    here = np.zeros(n, dtype=np.int64)
    deep = depth > 0
    here[deep] = flat[at[head[nodes["row"][deep]]] + depth[deep] - 1]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, chunk)), pa.array(node_key, pa.binary()), pa.array(parent_key, pa.binary()), pa.array(depth),
            pa.array(nodes["least"]), pa.array(parent_conv, mask=unknown), pa.array(nodes["n"]), pa.array(nodes["children"]),
            pa.array(nodes["leaves"]), pa.array(nodes["saved"]), pa.array(sha, pa.string()), pa.array(here),
            pa.array(ends, pa.string()), pa.array((nodes["children"] == 0).astype(np.int64)),
        ],
        names=[c.split()[0] for c in NODES.split(", ")],
    )


def _ends_digests(pieces: DataFrame) -> DataFrame:
    """``node_key, sha`` of id lists that are cut over chunks, streamed in chunk order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, digests = [], []
            for key, text in zip(batch.column("node_key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if key != now:
                    if state is not None:
                        keys.append(now)
                        digests.append(state.hexdigest())
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["node_key", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["node_key", "sha"])

    ordered = pieces.repartition("node_key").sortWithinPartitions("node_key", "chunk")
    return ordered.mapInArrow(run, "node_key binary, sha string")


def _merged(spine: DataFrame) -> DataFrame:
    """One row per prefix that chunks may share, with whole aggregates of its subtree."""
    pieces = spine.filter("ends is not null").select("node_key", "chunk", "ends")
    met = spine.groupBy("node_key").agg(
        F.count(F.lit(1)).alias("k"), F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"),
        F.first("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "own_leaf")],
    )
    met = written(met.join(_ends_digests(pieces), "node_key", "left"), "trie-shared")
    # what several chunks counted each for itself
    twice = met.filter("k > 1")
    fixes = _subtree_sums(twice.select(
        "node_key", "parent_key", F.expr("if(n_children = 0, 1, 0) - own_leaf").alias("leaves"), F.expr("(k - 1) * bytes").alias("saved")
    ))
    children = twice.filter("parent_key is not null").groupBy(F.col("parent_key").alias("node_key")).agg(F.sum(F.expr("k - 1")).alias("children"))
    fixed = met.join(fixes, "node_key", "left").join(children, "node_key", "left").fillna(0, ["leaves", "saved", "children"])
    return fixed.withColumn("n_leaves", F.expr("n_leaves + leaves")).withColumn(
        "saved_tokens", F.expr("saved_tokens + saved")
    ).withColumn("n_children", F.expr("n_children - children"))


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """``node_key, leaves, saved`` of ``nodes`` (with ``parent_key``) summed over subtrees.

    Each round doubles the distance that sums have risen, so a path of n prefixes takes log n.
    """
    now = written(nodes.withColumnRenamed("parent_key", "above"), "trie-corrections")
    while now.filter("above is not null").limit(1).count():
        risen = now.filter("above is not null").groupBy(F.col("above").alias("node_key")).agg(
            F.sum("leaves").alias("l"), F.sum("saved").alias("s")
        )
        higher = now.select(F.col("node_key").alias("above"), F.col("above").alias("next"))
        now = written(
            now.join(risen, "node_key", "left").join(higher, "above", "left").select(
                "node_key", F.col("next").alias("above"), F.expr("leaves + coalesce(l, 0)").alias("leaves"),
                F.expr("saved + coalesce(s, 0)").alias("saved"),
            ),
            "trie-corrections",
        )
    return now.drop("above")


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (``RESULT``); ``columns`` are those
    of ``rebuilt_conversations``."""
    paths = written(rebuilt_conversations(conversations, **columns), "trie-paths")
    ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    nodes = written(_peeled(ordered), "trie-nodes")
    spine = nodes.filter("node_key is not null")
    shared = written(_merged(spine), "trie-merged")
    # a child looks for its parent within its own chunk, so no key has more rows than a chunk
    least = spine.select("chunk", "node_key").join(shared.select("node_key", F.col("conv_id").alias("p")), "node_key")
    orphans = nodes.filter("node_key is null and parent_key is not null").join(
        least.withColumnRenamed("node_key", "parent_key"), ["chunk", "parent_key"]
    )
    plain = nodes.filter("node_key is null and parent_key is null")
    parents = shared.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    top = shared.withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS))).join(parents, "parent_key", "left")
    return plain.select(*RESULT).unionByName(orphans.withColumn("parent_conv_id", F.col("p")).select(*RESULT)).unionByName(top.select(*RESULT))

