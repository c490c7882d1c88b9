"""JSON texts as tokens, in the JVM: scan, test, take the strings out and write them back.

Escaped backslashes and quotes are masked first, so the quotes that are left cut a text into
what stands outside and inside of its strings. Outside, literals become one letter and white
space goes: a skeleton of one character per token.

A skeleton is tested as a string, without a stack: patterns without repeated groups remove members,
list items and innermost containers everywhere at once. Where containers hold each other in a row,
what opens them is compared, as a whole, with what closes them. Each such round removes all
chains that end innermost, which at least halves those that are left, so depth has no limit
and a text takes a number of passes that grows with its logarithm. Depths of single tokens are
running sums, made where they are written: in documents that are indented.

Numbers and literals stay as they are written, repeated keys stay both. Output has two spaces a
level, as a JSON printer writes it; beyond ``DEEP`` levels it is one line.
"""

from __future__ import annotations

from hushlake.functions.arrays import empty_array, fold_emit, let, literal, struct
from hushlake.operators.hits import marker_for

#: levels beyond which indentation, which grows with the square of the depth, is left out
DEEP = 900

_SELF = r"(?:true|false|null|NaN|-?Infinity|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
_LITERAL = rf"(?<![\w.+-]){_SELF}(?![\w.+-])"
_PAIR = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
#: ``outside`` is the text without white space and with empty strings
SCANNED = "struct<ok:boolean,deep:boolean,outside:string,strings:array<string>,is_key:array<boolean>>"
_SPACE = r"[ \t\n\r]+"
#: a rank counts the strings before a token in its upper half, literals in the lower
_STRING_BEFORE = 1 << 32


def _swap(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {literal(pattern)}, {literal(by)})"


def _running(numbers: str) -> str:
    """Exclusive running sums of an array of bigints.

    Sums of short runs are folded; within a run each element adds those before it, which
    costs less than appending one by one.
    """
    run = 16
    sums = f"transform(sequence(0, (size(un) - 1) div {run}), uk -> aggregate(slice(un, cast(uk * {run} + 1 as int), {run}), 0L, (ua, ux) -> ua + ux))"
    before = fold_emit("us", "0L", lambda st, n: f"{st} + {n}", lambda st, n: f"array({st})", "bigint") + ".out"
    inside = f"aggregate(slice(un, cast((ui div {run}) * {run} + 1 as int), cast(ui % {run} as int)), get(ub, cast(ui div {run} as int)), (ua, ux) -> ua + ux)"
    sized = let("us", sums, let("ub", before, f"transform(un, (ut, ui) -> {inside})"))
    return let("un", numbers, f"CASE WHEN size(un) > 0 THEN {sized} ELSE {empty_array('bigint')} END")


def _depths(chars: str) -> str:
    """How many containers are open before each token."""
    return _running(f"transform({chars}, dc -> CASE WHEN dc IN ('{{', '[') THEN 1L WHEN dc IN ('}}', ']') THEN -1L ELSE 0L END)")


def _ranks(chars: str) -> str:
    return _running(f"transform({chars}, kc -> CASE kc WHEN '\"' THEN {_STRING_BEFORE}L WHEN 'v' THEN 1L ELSE 0L END)")


def _deep(line: str) -> str:
    """Whether a skeleton has more than ``DEEP`` levels: exact, but single tokens are counted near the limit only."""
    step = lambda c: f"CASE WHEN {c} IN ('{{', '[') THEN 1 ELSE -1 END"
    each = f"aggregate(split(dc, ''), {struct(d='ds.d', m='ds.d')}, (dt, dx) -> {struct(d=f'dt.d + {step("dx")}', m=f'greatest(dt.m, dt.d + {step("dx")})')})"
    opened = "length(translate(dc, ']}', ''))"
    state = struct(d=f"ds.d + 2 * {opened} - length(dc)", deep=f"ds.deep OR ds.d + {opened} > {DEEP} AND {each}.m > {DEEP}")
    chunks = f"regexp_extract_all({_swap(line, r'[^{}\[\]]+')}, '.{{1,64}}', 0)"
    found = f"aggregate({chunks}, {struct(d='0', deep='false')}, (ds, dc) -> {state}).deep"
    return f"(length({line}) - length(translate({line}, '{{[', '')) > {DEEP} AND {found})"


def _raked(line: str) -> str:
    """A reduced skeleton with its innermost containers as values: ``k`` is a key, ``m`` a member, ``r`` stands in front of all."""
    members = _swap(f"replace(replace({line}, 'kv', 'm'), 'rv', 'R')", ",(?<=m,)m")
    return _swap(_swap(members, ",(?<=v,)v"), r"\[v?\]|\{m?\}", "v")


def _contracted(line: str) -> str:
    """The same for whole chains of containers that hold each other."""
    # before and after a container, values of a list and members of an object make no difference
    alone = _swap(_swap(line, r"v,(?<=\[v,)(?=[\[{])|m,(?<=\{m,)(?=k[\[{])"), r",(?<=[\]}],)(?:v(?=\])|m(?=\}))")
    chain = literal(r"(?<![\[O])[\[O]++v[\]}]++")
    n = "least(length(ca), length(cb))"
    fits = f"right(ca, {n}) = reverse(translate(left(cb, {n}), ']}}', '[O'))"
    rest = f"if({fits}, concat(left(ca, length(ca) - {n}), 'v', right(cb, length(cb) - {n})), '!')"
    rest = let("ca", "substring_index(cp, 'v', 1)", let("cb", "substring_index(cp, 'v', -1)", rest))
    chains = f"concat(transform(regexp_extract_all(co, {chain}, 0), cp -> {rest}), array(''))"
    joined = f"array_join(zip_with(split(co, {chain}, -1), {chains}, (cx, cy) -> concat(cx, cy)), '')"
    return f"replace({let('co', f"replace({alone}, '{{k', 'O')", joined)}, 'O', '{{k')"


def _well_formed(line: str) -> str:
    """Whether the containers of a skeleton are all whole and rightly filled."""
    first = f"""replace(replace(concat('r', {line}), '":', 'k'), '"', 'v')"""
    for _ in range(2):
        first = _raked(first)
    step = f"CASE WHEN length(wl) < 2 OR contains(wl, '!') THEN wl ELSE {_raked(_contracted(_raked('wl')))} END"
    rounds = f"sequence(0, cast(log2(length({line}) + 1) as int) + 3)"
    return f"aggregate({rounds}, {first}, (wl, wi) -> {step}) = 'R'"


def _strings_ok(inside: str) -> str:
    """Whether strings (with masked quotes and backslashes) hold valid escapes only."""
    plain = _swap("sj", r"\\(?:[/bfnrt]|u[0-9a-fA-F]{4})")
    lone = f"{_swap('sj', _PAIR)} RLIKE {literal(r'\\u[dD][89a-fA-F]')}"
    return let(
        "sj",
        f"array_join({inside}, ' ')",
        f"NOT sj RLIKE {literal(r'[\x00-\x1f]')} AND (NOT contains(sj, {literal(chr(92))}) OR "
        f"(NOT contains({plain}, {literal(chr(92))}) AND NOT {lone}))",
    )


def scan(text: str) -> str:
    """``SCANNED`` of a JSON text; null for null. ``strings`` are decoded, in order, keys too."""
    back, quote = literal(chr(92)), literal(chr(92) + '"')
    twice = literal(chr(92) * 2)
    masked = f"replace(replace({text}, {twice}, concat(jm, 'b')), {quote}, concat(jm, 'q'))"
    outside = "array_join(transform(sequence(0, size(jp) - 1, 2), ji -> get(jp, ji)), '\"')"
    inside = f"if(size(jp) > 1, transform(sequence(1, size(jp) - 1, 2), ji -> get(jp, ji)), {empty_array('string')})"
    skeleton = _swap(_swap("jk", _LITERAL, "v"), _SPACE)
    raw = f"replace(replace(array_join(js, '\",\"'), concat(jm, 'q'), {quote}), concat(jm, 'b'), {twice})"
    decoded = f"""CASE WHEN size(js) = 0 OR NOT contains({text}, {back}) THEN js
        ELSE from_json(concat('["', {raw}, '"]'), 'array<string>') END"""
    good = f"""size(jp) % 2 = 1 AND jl <> '' AND NOT contains(jk, 'v') AND NOT jl RLIKE {literal(r'[^{}\[\],:v"]')}
        AND {_strings_ok('js')}"""
    # a text that fails these tests is no JSON, whatever its tokens
    found = struct(
        ok=f"coalesce({_well_formed('jl')} AND size(jd) = size(js), false)", deep=_deep("jl"), outside=_swap("jk", _SPACE), strings="jd",
        is_key="transform(regexp_extract_all(jl, '\":?', 0), jq -> jq = '\":')",
    )
    nothing = ", ".join(f"'{c.split(':')[0]}', NULL" for c in SCANNED[len("struct<ok:boolean,") : -1].split(","))
    none = f"cast(named_struct('ok', false, {nothing}) AS {SCANNED})"
    body = let("jd", decoded, f"cast({found} AS {SCANNED})")
    body = f"CASE WHEN {good} THEN {body} ELSE {none} END"
    for name, value in (("jl", skeleton), ("js", inside), ("jk", outside), ("jp", f"split({masked}, '\"', -1)"), ("jm", marker_for(text))):
        body = let(name, value, body)
    return f"CASE WHEN {text} IS NOT NULL THEN {body} END"


def values(scanned: str) -> str:
    """The strings that are no keys, in order."""
    return f"filter({scanned}.strings, (xs, xi) -> NOT get({scanned}.is_key, xi))"


def escaped(text: str) -> str:
    """A string as it stands between quotes: only what must be escaped is."""
    out = f"replace(replace({text}, {literal(chr(92))}, {literal(chr(92) * 2)}), '\"', {literal(chr(92) + chr(34))})"
    for code, letter in ((10, "n"), (13, "r"), (9, "t"), (8, "b"), (12, "f")):
        out = f"replace({out}, char({code}), {literal(chr(92) + letter)})"
    others = f"""aggregate(sequence(0, 31), {out}, (eo, en) ->
        replace(eo, char(en), concat({literal(chr(92) + 'u00')}, lower(lpad(hex(en), 2, '0')))))"""
    return f"CASE WHEN {text} RLIKE {literal(r'[\x00-\x1f]')} THEN {others} ELSE {out} END"


def render(scanned: str, replaced: str) -> str:
    """The document with its values, in the order of ``values``, replaced."""
    place = _running(f"transform({scanned}.is_key, rk -> if(rk, 0L, 1L))")
    text = f"if(get({scanned}.is_key, wi), ws, get({replaced}, cast(get(rr, wi) as int)))"
    written = f"transform({scanned}.strings, (ws, wi) -> {escaped('wx').join(('get(transform(array(' + text + '), wx -> ', '), 0)'))})"
    line = "concat(char(10), repeat(' ', cast(2 * ({}) as int)))"
    here = "get(rd, ri)"
    token = f"""CASE rt
        WHEN '"' THEN concat('"', get(rw, cast(get(rk, ri) div {_STRING_BEFORE} as int)), '"')
        WHEN 'v' THEN get(rl, cast(get(rk, ri) % {_STRING_BEFORE} as int))
        WHEN ':' THEN ': '
        WHEN ',' THEN concat(',', {line.format(here)})
        WHEN '{{' THEN if(get(rc, ri + 1) = '}}', '{{', concat('{{', {line.format(here + ' + 1')}))
        WHEN '[' THEN if(get(rc, ri + 1) = ']', '[', concat('[', {line.format(here + ' + 1')}))
        WHEN '}}' THEN if(get(rc, ri - 1) = '{{', '}}', concat({line.format(here + ' - 1')}, '}}'))
        ELSE if(get(rc, ri - 1) = '[', ']', concat({line.format(here + ' - 1')}, ']')) END"""
    tokens = f"array_join(transform(rc, (rt, ri) -> {token}), '')"
    for name, value in (
        ("rl", f"regexp_extract_all({scanned}.outside, {literal(_LITERAL)}, 0)"), ("rk", _ranks("rc")), ("rd", _depths("rc")),
        ("rc", f"split({_swap(f'{scanned}.outside', _LITERAL, 'v')}, '')"),
    ):
        tokens = let(name, value, tokens)
    pieces = f"""split(replace(replace({scanned}.outside, ',', ', '), ':', ': '), '"', -1)"""
    one_line = f"""array_join(transform({pieces}, (rp, ri) -> if(ri < size(rw), concat(rp, '"', get(rw, ri), '"'), rp)), '')"""
    body = f"CASE WHEN {scanned}.deep THEN {one_line} ELSE {tokens} END"
    return let("rr", place, let("rw", written, body))
