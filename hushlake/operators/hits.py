"""Find all matches of the selected rules, with offsets (no shuffle).

A rule is run once over the text: every match is wrapped in a marker
the text does not hold, the result is split at the marker, and offsets are the
running lengths of the parts. Offsets are code points, half open, in the text as
given.

A hit is ``struct(start, end, rank, rule, value)``; ``rule`` indexes the list of
selected rules, ``rank`` is its place among hits of equal span. Hits hold raw
values: they are internal and must be dropped before anything is written.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from hushlake.functions.arrays import empty_array, fold_emit, let, literal, struct
from hushlake.rules import DIGIT_RUN, VALIDATORS, Rule, tie_ranks

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HIT = "struct<start:int,end:int,rank:int,rule:int,value:string>"

_MARK = "decode(unhex('E000'), 'UTF-16BE')"
_MARK_END = "decode(unhex('E001'), 'UTF-16BE')"


def marker_for(text: str) -> str:
    """A string that ``text`` does not contain and that stays apart when put beside it.

    Nearly always the one private-use character. A text that holds this gets a longer
    run of it than it has, closed by a second character: whatever stands before the
    marker, only its own last characters complete it. So every text has a marker.
    """
    runs = f"regexp_extract_all({text}, concat({_MARK}, '+', {_MARK_END}), 0)"
    longest = f"coalesce(array_max(transform({runs}, mr -> length(mr))), 1)"
    other = f"concat(repeat({_MARK}, {longest}), {_MARK_END})"
    return f"CASE WHEN NOT contains({text}, {_MARK}) THEN {_MARK} ELSE {other} END"


def gate(rule: Rule, text: str, has_digits: str) -> str:
    """A cheap test that is true for every text the rule matches."""
    tests = []
    if rule.any_of:
        either = " OR ".join(f"contains({text}, {literal(s)})" for s in rule.any_of)
        tests.append(f"({either})")
    if rule.needs_digits:
        tests.append(has_digits)
    return " AND ".join(tests) or "true"


def rule_parts(text: str, mark: str, rule: Rule) -> str:
    """The text cut at the matches of one rule: gap, match, gap, ..., gap."""
    wrapped = (
        f"concat({mark}, '$0', {mark})"
        if rule.group == 0
        else f"concat('$1', {mark}, '$2', {mark})"
    )
    return f"split(regexp_replace({text}, {literal(rule.pattern)}, {wrapped}), {mark}, -1)"


def spans(cut: str) -> str:
    """Hits of one ``struct(rule, rank, parts)`` with parts by ``rule_parts``."""

    def start(pos: str, i: str) -> str:
        return f"({pos} + length(get({cut}.parts, {i} - 1)))"

    def end(pos: str, i: str) -> str:
        return f"({start(pos, i)} + length(get({cut}.parts, {i})))"

    def hit(pos: str, i: str) -> str:
        return struct(
            start=start(pos, i),
            end=end(pos, i),
            rank=f"{cut}.rank",
            rule=f"{cut}.rule",
            value=f"get({cut}.parts, {i})",
        )

    folded = fold_emit(
        f"sequence(1, size({cut}.parts) - 2, 2)",
        "0",
        end,
        lambda pos, i: f"array({hit(pos, i)})",
        HIT,
    )
    return f"{folded}.out"


def passes_validator(hit: str, rules: list[Rule]) -> str:
    """A match that fails its check is spent: there is no shorter second try."""
    checks = [
        f"WHEN {i} THEN {VALIDATORS[r.validator](f'{hit}.value')}"
        for i, r in enumerate(rules)
        if r.validator
    ]
    return f"CASE {hit}.rule {' '.join(checks)} ELSE true END"


CUT = "struct<rule:int,rank:int,parts:array<string>>"
_CUTS_ARROW = pa.list_(
    pa.struct([("rule", pa.int32()), ("rank", pa.int32()), ("parts", pa.list_(pa.string()))])
)


def _cut(text: str | None, patterns: list[tuple[int, int, re.Pattern]]) -> list[dict] | None:
    if text is None:
        return None
    cuts = []
    for rule, rank, pattern in patterns:
        edges = [0, *(edge for m in pattern.finditer(text) for edge in m.span()), len(text)]
        if len(edges) > 2:
            parts = [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            cuts.append({"rule": rule, "rank": rank, "parts": parts})
    return cuts


def python_cuts(text: Column, rules: list[Rule], leaves: bool = False) -> Column | None:
    """Texts cut by the rules that only Python can run, for ``all_hits``; None without such
    rules. With ``leaves`` the column is an array of texts, and so is the result."""
    ranks = tie_ranks(rules)
    wanted = [(i, ranks[i], r.pattern) for i, r in enumerate(rules) if r.engine == "python"]
    if not wanted:
        return None

    def run(texts: pa.Array) -> pa.Array:
        patterns = [(i, rank, re.compile(p)) for i, rank, p in wanted]
        if not leaves:
            return pa.array([_cut(t, patterns) for t in texts.to_pylist()], _CUTS_ARROW)
        rows = [None if row is None else [_cut(t, patterns) for t in row] for row in texts.to_pylist()]
        return pa.array(rows, pa.list_(_CUTS_ARROW))

    return F.arrow_udf(run, f"array<array<{CUT}>>" if leaves else f"array<{CUT}>")(text)


def all_hits(text: str, rules: list[Rule], python: str | None = None) -> str:
    """Validated hits of all rules, in collection order; empty for null text.

    ``python`` names the ``python_cuts`` of the text, where there are such rules.
    """
    if not rules:
        return empty_array(HIT)
    if python is None and any(r.engine == "python" for r in rules):
        raise ValueError("a custom rule runs in Python: add python_cuts of the text")
    ranks = tie_ranks(rules)
    has_digits = (
        f"{text} RLIKE {literal(DIGIT_RUN)}" if any(r.needs_digits for r in rules) else "false"
    )
    cuts = ",\n".join(
        struct(
            rule=str(i),
            rank=str(ranks[i]),
            parts=f"CASE WHEN {gate(rule, text, 'ctx.digits')} "
            f"THEN {rule_parts(text, 'ctx.mark', rule)} END",
        )
        for i, rule in enumerate(rules)
        if rule.engine == "jvm"
    )
    context = struct(digits=has_digits, mark=marker_for(text))
    found = let("ctx", context, f"cast(array({cuts}) as array<{CUT}>)")
    if python is not None:
        found = f"array_sort(concat({found}, coalesce({python}, {empty_array(CUT)})), (ca, cb) -> ca.rule - cb.rule)"
    matched = f"filter({found}, cut -> size(cut.parts) > 1)"
    hits = f"flatten(transform({matched}, cut -> {spans('cut')}))"
    grouped = ", ".join(str(i) for i, r in enumerate(rules) if r.group == 2)
    if grouped:
        hits = f"filter({hits}, eh -> eh.value <> '' OR eh.rule NOT IN ({grouped}))"
    if any(r.validator for r in rules):
        hits = f"filter({hits}, vh -> {passes_validator('vh', rules)})"
    return f"CASE WHEN {text} IS NULL OR {text} = '' THEN {empty_array(HIT)} ELSE {hits} END"
