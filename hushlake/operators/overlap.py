"""Overlap resolution: longer span first, then earlier, then higher confidence.

Sorted by start, hits fall into components of overlapping spans. Components do
not affect each other, so the greedy choice runs inside each one; most hold a
single hit. Touching spans do not overlap.
"""

from __future__ import annotations

from hushlake.functions.arrays import empty_array, fold_emit, let, struct
from hushlake.operators.hits import HIT


def _greedy(component: str) -> str:
    order = struct(neg_length="gh.start - gh.end", at="gh.start", tie="gh.rank", hit="gh")
    return f"""CASE WHEN size({component}) <= 1 THEN {component} ELSE
        sort_array(aggregate(
            sort_array(transform({component}, gh -> {order})),
            {empty_array(HIT)},
            (kept, g) -> CASE
                WHEN exists(kept, k -> g.hit.start < k.end AND g.hit.end > k.start) THEN kept
                ELSE concat(kept, array(g.hit)) END)) END"""


def resolve_overlaps(hits: str) -> str:
    """Disjoint hits ordered by start."""

    def number(st: str, h: str) -> str:
        return f"(CASE WHEN {h}.start < {st}.reach THEN {st}.id ELSE {st}.id + 1 END)"

    def step(st: str, h: str) -> str:
        reach = f"CASE WHEN {h}.start < {st}.reach THEN greatest({st}.reach, {h}.end) ELSE {h}.end END"
        return struct(reach=reach, id=number(st, h))

    # every hit learns the number of its component; components are then slices
    numbered = fold_emit(
        "ordered", struct(reach="-1", id="0"), step, lambda st, h: f"array({number(st, h)})", "int"
    )
    heads = "filter(sequence(1, size(ids)), hp -> hp = 1 OR get(ids, hp - 1) <> get(ids, hp - 2))"
    part = "slice(ordered, hd, coalesce(get(heads, hi + 1), size(ordered) + 1) - hd)"
    chosen = f"flatten(transform(heads, (hd, hi) -> {let('part', part, _greedy('part'))}))"
    grouped = let("ids", f"{numbered}.out", let("heads", heads, chosen))
    # most texts have no overlap at all, which one pass over two integers shows
    disjoint = """aggregate(ordered, 0, (reach, oh) ->
        CASE WHEN reach < 0 OR oh.start < reach THEN -1 ELSE oh.end END) >= 0"""
    resolved = let(
        "ordered", f"sort_array({hits})", f"CASE WHEN {disjoint} THEN ordered ELSE {grouped} END"
    )
    return f"CASE WHEN size({hits}) <= 1 THEN {hits} ELSE {resolved} END"
