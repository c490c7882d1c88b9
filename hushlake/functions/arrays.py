"""Small building blocks over Spark's higher-order array functions.

Expressions are SQL text: a pipeline of a few hundred nodes is parsed in one
call, and the lambdas read as they would in a query. Arguments are SQL text too.

The folds are chunked. Appending to a growing array copies it, so a plain
``aggregate`` that appends once per element is quadratic. Appending inside
chunks of ``CHUNK`` elements, and appending whole chunks to the outer array,
keeps a row with many thousands of hits affordable.
"""

from __future__ import annotations

from collections.abc import Callable

CHUNK = 256


def literal(value: str | int | float | bool | None) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    text = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def literal_array(values: list, element_type: str) -> str:
    return f"cast(array({', '.join(literal(v) for v in values)}) as array<{element_type}>)"


def let(var: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``var`` in ``body``.

    Catalyst does not share subexpressions inside lambdas or CASE branches; a
    one-element ``transform`` binds the value to a lambda variable instead.
    """
    return f"get(transform(array({value}), {var} -> {body}), 0)"


def empty_array(element_type: str) -> str:
    return f"cast(array() as array<{element_type}>)"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def chunk_ids(n: str) -> str:
    """0 .. number of chunks - 1 for ``n`` elements (one chunk when empty)."""
    return f"sequence(0, cast((greatest({n}, 1) - 1) div {CHUNK} as int))"


def chunk_of(items: str, chunk: str) -> str:
    return f"slice({items}, {chunk} * {CHUNK} + 1, {CHUNK})"


def fold_emit(
    items: str,
    init: str,
    step: Callable[[str, str], str],
    emit: Callable[[str, str], str],
    emit_type: str,
) -> str:
    """Running fold that also emits elements.

    ``step(state, x)`` gives the next state, ``emit(state, x)`` an array of
    elements to append, seen from the state *before* ``x``. The result is a
    struct ``(st, out)``: the last state and everything emitted, in order.
    """

    def run(part: str, state: str) -> str:
        return f"""aggregate(
            {part},
            named_struct('st', {state}, 'out', {empty_array(emit_type)}),
            (fin, fx) -> named_struct(
                'st', {step("fin.st", "fx")},
                'out', concat(fin.out, {emit("fin.st", "fx")})))"""

    merged = "named_struct('st', fdone.st, 'out', concat(facc.out, array(fdone.out)))"
    in_chunks = f"""aggregate(
        {chunk_ids("size(fitems)")},
        named_struct('st', {init}, 'out', {empty_array(f"array<{emit_type}>")}),
        (facc, fchunk) -> {let("fdone", run(chunk_of("fitems", "fchunk"), "facc.st"), merged)},
        facc -> named_struct('st', facc.st, 'out', flatten(facc.out)))"""
    # bound once: a lambda would evaluate the operand again for every chunk
    return let(
        "fitems",
        items,
        f"CASE WHEN size(fitems) <= {CHUNK} THEN {run('fitems', init)} ELSE {in_chunks} END",
    )


def prefix_sums(sizes: str) -> str:
    """Exclusive running sums of an int array."""
    folded = fold_emit(
        sizes, "0", lambda st, n: f"{st} + {n}", lambda st, n: f"array({st})", "int"
    )
    return f"{folded}.out"
