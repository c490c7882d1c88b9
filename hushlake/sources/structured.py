"""Parsing and re-serialising of structured documents in Arrow UDFs.

Python only turns a document into its string leaves and back. Finding, numbering
and replacing happen in Spark between the two. A document that cannot be parsed
gives null, and the caller treats it as plain text.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Warnings for documents that are processed as plain text.
FALLBACK_WARNINGS = {
    "json": "Malformed JSON; sanitized as plain text",
    "yaml": "Malformed YAML; sanitized as plain text",
    "xml": "Malformed XML; sanitized as plain text",
    "csv": "Malformed CSV; sanitized as plain text",
}
YAML_MISSING_WARNING = "PyYAML missing; sanitized YAML as plain text"

Visit = Callable[[str, str, str], str]
"""``visit(path, kind, value)`` sees a leaf and returns what takes its place."""


def yaml_available() -> bool:
    try:
        import yaml  # noqa: F401
    except ImportError:
        return False
    return True


def rewrite(content_type: str, text: str, visit: Visit) -> str:
    """Parse, pass every leaf through ``visit`` in visit order, serialise."""
    tree = _walked(content_type, text, visit)
    if content_type == "yaml" and isinstance(tree, (dict, list)) and (printed := _print_plain_yaml(text, tree)) is not None:
        return printed
    return _printed(content_type, tree)


def _walked(content_type: str, text: str, visit: Visit) -> Any:
    """The parsed document with every leaf passed through ``visit`` in visit order."""
    if content_type == "json":
        return _rewrite_in_place(_load_json(text), visit)
    if content_type == "yaml":
        return _rewrite_tree(_load_yaml(text), visit)
    if content_type == "xml":
        root = ElementTree.fromstring(text)
        _rewrite_elements(root, visit)
        return root
    if content_type == "csv":
        return _rewrite_csv(text, visit)
    raise ValueError(content_type)


#: What keeps a YAML text from libyaml, which reads and writes four to seven times faster than Python and is
#: another implementation: flow style, tags, anchors, block scalars, directives, tabs and
#: characters beyond ASCII, and depths at which its recursion may need more stack than there is.
_NOT_PLAIN_YAML = re.compile(r"[^\n\x20-\x7e]|[%|>?!{}\[\]&*`]|^[ \-]{200}", re.MULTILINE)
#: What keeps its output from being used: quotes, escapes, empty keys, and lines that may have been folded.
_NOT_PLAIN_OUTPUT = re.compile(r"[^\n\x20-\x7e]|[\"\\]|'':|^.{79}", re.MULTILINE)


def _plain_yaml(text: str) -> bool:
    """Whether libyaml is there and reads the text as Python does (tested on random texts)."""
    import yaml

    return yaml.__with_libyaml__ and not _NOT_PLAIN_YAML.search(text)


def _load_yaml(text: str) -> Any:
    import yaml

    if _plain_yaml(text):
        return yaml.load(text, Loader=yaml.CSafeLoader)
    with _deep():
        return yaml.safe_load(text)


def _print_plain_yaml(text: str, tree: Any) -> str | None:
    """The tree of a plain text as libyaml prints it; None where Python may print it otherwise."""
    import yaml

    if not _plain_yaml(text):
        return None
    printed = yaml.dump(tree, Dumper=yaml.CSafeDumper, sort_keys=False, allow_unicode=True)
    return None if _NOT_PLAIN_OUTPUT.search(printed) else printed


def _printed(content_type: str, tree: Any) -> str:
    if content_type == "json":
        return _dump_json(tree)
    if content_type == "yaml":
        import yaml

        with _deep():
            return yaml.safe_dump(tree, sort_keys=False, allow_unicode=True)
    if content_type == "xml":
        with _deep():
            return ElementTree.tostring(tree, encoding="unicode")
    out = io.StringIO()
    csv.writer(out).writerows(tree)
    return out.getvalue()


@contextmanager
def _deep() -> Iterator[None]:
    """Room for libraries that recurse in Python."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 500_000))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def _rewrite_tree(root: Any, visit: Visit) -> Any:
    """A copy with every string visited, in document order, at any depth.

    A container that several places share (an anchor) is walked once, at its first
    place, and shared again in the copy: the work follows the document, whatever its
    aliases would expand to.
    """
    top: list[Any] = [None]
    copies: dict[int, Any] = {}
    todo: list[tuple[Any, str, Any, Any]] = [(root, "$", top, 0)]
    while todo:
        node, path, holder, place = todo.pop()
        if isinstance(node, str):
            holder[place] = visit(path, "string", node)
        elif not isinstance(node, (dict, list)):
            holder[place] = node
        elif id(node) in copies:
            holder[place] = copies[id(node)]
        elif isinstance(node, dict):
            holder[place] = copies[id(node)] = dict.fromkeys(node)
            todo += [(v, f"{path}.{k}", holder[place], k) for k, v in reversed(node.items())]
        else:
            holder[place] = copies[id(node)] = [None] * len(node)
            todo += [(node[i], f"{path}[{i}]", holder[place], i) for i in reversed(range(len(node)))]
    return top[0]


def _rewrite_in_place(root: Any, visit: Visit) -> Any:
    """The same for a tree that shares nothing, without a copy of it."""
    top = [root]
    todo: list[tuple[Any, str, Iterator]] = [(top, "", iter((0,)))]
    while todo:
        node, path, places = todo[-1]
        for place in places:
            value = node[place]
            if not isinstance(value, (str, dict, list)):
                continue
            at = "$" if node is top else f"{path}.{place}" if isinstance(node, dict) else f"{path}[{place}]"
            if isinstance(value, str):
                node[place] = visit(at, "string", value)
            else:
                todo.append((value, at, iter(value if isinstance(value, dict) else range(len(value)))))
                break
        else:
            todo.pop()
    return top[0]


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r'true|false|null|NaN|-?Infinity|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?')


def _load_json(text: str) -> Any:
    try:
        return json.loads(text)
    except RecursionError:
        return _load_deep_json(text)


def _load_deep_json(text: str) -> Any:
    """As ``json.loads``, with open containers on a list instead of the call stack."""
    opened: list[Any] = []
    keys: list[str] = []
    at = _SPACE.match(text).end()

    def fail() -> ValueError:
        return ValueError(f"unexpected JSON at {at}")

    def read_key() -> None:
        nonlocal at
        if text[at : at + 1] != '"':
            raise fail()
        key, at = json.decoder.scanstring(text, at + 1)
        at = _SPACE.match(text, at).end()
        if text[at : at + 1] != ":":
            raise fail()
        at = _SPACE.match(text, at + 1).end()
        keys.append(key)

    while True:
        mark = text[at : at + 1]
        if mark and mark in "{[":
            opened.append({} if mark == "{" else [])
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != "}]"["{[".index(mark)]:
                if mark == "{":
                    read_key()
                continue
            value, at = opened.pop(), at + 1
        elif mark == '"':
            value, at = json.decoder.scanstring(text, at + 1)
        elif found := _SCALAR.match(text, at):
            value, at = json.loads(found[0]), found.end()
        else:
            raise fail()
        while True:  # the value is complete: put it where it belongs
            at = _SPACE.match(text, at).end()
            if not opened:
                if at < len(text):
                    raise fail()
                return value
            holder = opened[-1]
            if isinstance(holder, dict):
                holder[keys.pop()] = value
            else:
                holder.append(value)
            mark = text[at : at + 1]
            if mark == ",":
                at = _SPACE.match(text, at + 1).end()
                if isinstance(holder, dict):
                    read_key()
                break
            if mark != ("}" if isinstance(holder, dict) else "]"):
                raise fail()
            value, at = opened.pop(), at + 1


def _dump_json(tree: Any) -> str:
    try:
        return json.dumps(tree, indent=2, ensure_ascii=False)
    except RecursionError:
        return "".join(_dump_deep_json(tree))


def _dump_deep_json(tree: Any) -> Iterator[str]:
    """A document nested deeper than ``json.dumps`` goes, on one line: indentation would
    grow with the square of the depth."""
    todo: list[Any] = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, _Literal):
            yield node
        elif isinstance(node, dict):
            pairs = [(_Literal((", " if n else "") + json.dumps(k, ensure_ascii=False) + ": "), v) for n, (k, v) in enumerate(node.items())]
            yield "{"
            todo += [_Literal("}"), *(part for k, v in reversed(pairs) for part in (v, k))]
        elif isinstance(node, list):
            yield "["
            todo += [_Literal("]"), *(part for n in reversed(range(len(node))) for part in (node[n], _Literal(", " if n else "")))]
        else:
            yield json.dumps(node, ensure_ascii=False)


class _Literal(str):
    """Output as it is."""


def _rewrite_elements(root: Any, visit: Visit) -> None:
    """Own text, then the tail, then attributes, then children."""
    todo: list[tuple[str, Iterator]] = [("", iter(((None, root),)))]
    while todo:
        above, children = todo[-1]
        if (found := next(children, None)) is None:
            todo.pop()
            continue
        i, element = found
        path = f"{above}/{element.tag}" if i is None else f"{above}/{element.tag}[{i}]"
        for kind in ("text", "tail"):
            if held := getattr(element, kind):
                setattr(element, kind, visit(path, kind, held))
        for name in element.keys():
            element.set(name, visit(f"{path}/@{name}", "attribute", element.get(name)))
        todo.append((path, enumerate(element)))


def _rewrite_csv(text: str, visit: Visit) -> list[list[str]]:
    csv.field_size_limit(sys.maxsize)
    return [
        [visit(f"r{r}c{c}", "cell", cell) for c, cell in enumerate(row)]
        for r, row in enumerate(csv.reader(io.StringIO(text)))
    ]


def leaves_of(content_type: str | None, text: str | None) -> list[tuple[str, str, str]] | None:
    """``(path, kind, value)`` of every leaf, or None if parsing fails."""
    if content_type is None or text is None:
        return None
    found: list[tuple[str, str, str]] = []

    def collect(path: str, kind: str, value: str) -> str:
        found.append((path, kind, value))
        return value

    try:
        tree = _walked(content_type, text, collect)
        for _, _, value in found:
            value.encode("utf-8")
        if content_type == "json" and "\\u" in text:
            _dump_json(tree).encode("utf-8")  # keys too may hold halves of characters
    except (Exception, RecursionError):
        return None
    return found


def with_leaves(content_type: str, text: str, leaves: Iterator[str]) -> str:
    return rewrite(content_type, text, lambda path, kind, value: next(leaves))


#: how a slot's text is escaped where it stands
_SLOTS = {"string": "json", "text": "xml", "tail": "xml", "attribute": "attribute", "cell": "csv"}


#: leaves that are Python objects at a time
RUN = 10_000
_LEAF = pa.struct([(n, pa.string()) for n in ("path", "kind", "value")])


def _found_leaves(content_type: str, text: str) -> pa.StructArray:
    """``path, kind, value`` of every leaf, in Arrow's form. Raises what parsing raises."""
    runs: list[pa.Array] = []
    held: list[tuple[str, str, str]] = []

    def flush() -> None:
        columns = list(zip(*held, strict=True)) or [()] * 3
        runs.append(pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], fields=list(_LEAF)))
        held.clear()

    def collect(path: str, kind: str, value: str) -> str:
        held.append((path, kind, value))
        if len(held) == RUN:
            flush()
        return value

    tree = _walked(content_type, text, collect)
    flush()
    if content_type == "json" and "\\u" in text:
        _dump_json(tree).encode("utf-8")  # keys too may hold halves of characters
    return pa.concat_arrays(runs)


def pieces_of(content_type: str | None, text: str | None) -> pa.StructArray | None:
    """The printed document cut at its leaves, in the order of the print: what stands before each
    leaf, its place in visit order, path, kind and value; last what stands after them. None if parsing fails, and for YAML, where
    the form of a value depends on its text."""
    if content_type not in ("json", "xml", "csv") or text is None:
        return None
    try:
        found = _found_leaves(content_type, text)
    except (Exception, RecursionError):
        return None
    for n in range(len(text) + 2):
        places = iter(range(len(found)))
        printed = rewrite(content_type, text, lambda path, kind, value: f"\ue000{n}:{next(places)}\ue001")  # noqa: B023
        mark = re.compile(f"\ue000{n}:([0-9]+)\ue001")
        # a text that holds such marks itself is cut with others
        if sum(1 for _ in mark.finditer(printed)) == len(found):
            break
    alone = set()
    if content_type == "csv":
        rows = Counter(path.split("c")[0] for path in map(str, found.field("path")))
        alone = {row for row, cells in rows.items() if cells == 1}

    def run(before: list[str], at: list[int | None]) -> pa.StructArray:
        leaves = found.take(pa.array(at, pa.int32()))
        path, kind, value = (leaves.field(name) for name in ("path", "kind", "value"))
        slots = [
            None if k is None else "only" if alone and p.split("c")[0] in alone else _SLOTS[k]
            for p, k in zip(path.to_pylist() if alone else [None] * len(at), kind.to_pylist(), strict=True)
        ]
        place = pa.array([len(found) if p is None else p for p in at], pa.int32())
        columns = [place, pa.array(before, pa.string()), pa.array(slots, pa.string()), path, kind, value]
        return pa.StructArray.from_arrays(columns, fields=list(_PIECES.value_type))

    runs: list[pa.Array] = []
    before: list[str] = []
    at: list[int | None] = []
    end = 0
    for m in mark.finditer(printed):
        before.append(printed[end : m.start()])
        at.append(int(m[1]))
        end = m.end()
        if len(at) == RUN:
            runs.append(run(before, at))
            before, at = [], []
    return pa.concat_arrays([*runs, run([*before, printed[end:]], [*at, None])])


_LEAVES = pa.list_(pa.string())


def _parse(content_type: pa.Array, text: pa.Array) -> pa.Array:

    def values(kind, doc):
        found = leaves_of(kind, doc)
        return None if found is None else [value for _, _, value in found]

    pairs = zip(content_type.to_pylist(), text.to_pylist(), strict=True)
    return pa.array([values(k, t) for k, t in pairs], type=_LEAVES)


def _render(content_type: pa.Array, text: pa.Array, leaves: pa.Array) -> pa.Array:
    rows = zip(content_type.to_pylist(), text.to_pylist(), leaves.to_pylist(), strict=True)
    return pa.array(
        [
            None if None in (k, t, new) else with_leaves(k, t, iter(new))
            for k, t, new in rows
        ],
        type=pa.string(),
    )


_LEAF_ROWS = pa.list_(
    pa.struct([("path", pa.string()), ("kind", pa.string()), ("value", pa.string())])
)


def _rows(content_type: pa.Array, text: pa.Array) -> pa.Array:

    def rows(kind, doc):
        found = leaves_of(kind, doc)
        if found is None:
            return None
        return [{"path": p, "kind": k, "value": v} for p, k, v in found]

    pairs = zip(content_type.to_pylist(), text.to_pylist(), strict=True)
    return pa.array([rows(k, t) for k, t in pairs], type=_LEAF_ROWS)


_PIECES = pa.list_(pa.struct([("place", pa.int32()), *[(n, pa.string()) for n in ("before", "slot", "path", "kind", "value")]]))


def _pieces(content_type: pa.Array, text: pa.Array) -> pa.Array:
    """``pieces_of`` one document after the other."""
    ends, parts = [0], [pa.array([], _PIECES.value_type)]
    good: list[bool] = []
    for kind, doc in zip(content_type, text, strict=True):
        found = pieces_of(kind.as_py(), doc.as_py())
        good.append(found is not None)
        if found is not None:
            parts.append(found)
        ends.append(ends[-1] + (0 if found is None else len(found)))
    values = pa.concat_arrays(parts)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=_PIECES, mask=pa.array([not g for g in good], pa.bool_()))


def leaf_pieces(content_type: Column, text: Column) -> Column:
    """``pieces_of`` each document; null for null, malformed and YAML documents."""
    return F.arrow_udf(_pieces, "array<struct<place:int,before:string,slot:string,path:string,kind:string,value:string>>")(content_type, text)


def parse_leaves(content_type: Column, text: Column) -> Column:
    """String leaves in visit order; null for null or malformed documents."""
    return F.arrow_udf(_parse, "array<string>")(content_type, text)


def render_leaves(content_type: Column, text: Column, leaves: Column) -> Column:
    """The document with its leaves replaced; null where any input is null."""
    return F.arrow_udf(_render, "string")(content_type, text, leaves)


def leaf_rows(content_type: Column, text: Column) -> Column:
    """Leaves with their place in the document, for the leaf table."""
    rows = "array<struct<path:string,kind:string,value:string>>"
    return F.arrow_udf(_rows, rows)(content_type, text)
