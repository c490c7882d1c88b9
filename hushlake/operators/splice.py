"""Rebuild a text from the gaps between hits and the placeholders."""

from __future__ import annotations

from hushlake.functions.arrays import CHUNK, chunk_ids, chunk_of, let, struct


def splice(text: str, marks: str) -> str:
    """``marks`` is ``array<struct<start,end,placeholder,...>>``, disjoint and
    ordered. Cutting by code point scans from the front of the string, so the
    text is first cut into pieces of ``CHUNK`` marks and then inside each."""

    def end_before(i: str) -> str:
        return f"coalesce(get({marks}, {i} - 1).end, 0)"

    last = end_before(f"least((sc + 1) * {CHUNK}, size({marks}))")
    first = end_before(f"(sc * {CHUNK})")
    cut = struct(base=first, text=f"substring({text}, {first} + 1, {last} - {first})")
    gap_from = end_before(f"(sc * {CHUNK} + si)")
    piece = let(
        "sp",
        cut,
        f"""array_join(transform({chunk_of(marks, "sc")}, (sm, si) -> concat(
            substring(sp.text, {gap_from} - sp.base + 1, sm.start - {gap_from}),
            sm.placeholder)), '')""",
    )
    tail = f"substring({text}, {end_before(f'size({marks})')} + 1)"
    return f"""CASE WHEN size({marks}) < 1 THEN {text} ELSE concat(
        array_join(transform({chunk_ids(f"size({marks})")}, sc -> {piece}), ''), {tail}) END"""
