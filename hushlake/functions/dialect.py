"""Regular expressions: Python meaning, Java engine.

Python's ``str`` patterns use Unicode classes. Java's ``(?U)`` classes are close
but not equal (combining marks, joiners, superscripts, U+001C-1F), so the
classes are spelled out here and used by every built-in rule.
"""

from __future__ import annotations

import re
import unicodedata

WORD_CHARS = r"a-zA-Z0-9_\p{L}\p{N}"
WORD = f"[{WORD_CHARS}]"
DIGIT = r"\p{Nd}"
SPACE_CHARS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE = f"[{SPACE_CHARS}]"
NOT_AFTER_WORD = f"(?<!{WORD})"
NOT_BEFORE_WORD = f"(?!{WORD})"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# Java may find an empty match between the two halves of one character.
_WHOLE_CHARACTER = r"(?![\x{dc00}-\x{dfff}])"

_OUTSIDE = {
    "w": WORD, "W": f"[^{WORD_CHARS}]",
    "d": DIGIT, "D": r"\P{Nd}",
    "s": SPACE, "S": f"[^{SPACE_CHARS}]",
    "b": BOUNDARY, "B": f"(?!{BOUNDARY})",
    "A": r"\A", "Z": r"\z",
}
_IN_CLASS = {
    "w": WORD_CHARS, "W": f"[^{WORD_CHARS}]",
    "d": DIGIT, "D": r"\P{Nd}",
    "s": SPACE_CHARS, "S": f"[^{SPACE_CHARS}]",
    "b": r"\x08",
}
#: The end of a group that may repeat without a bound, or very often.
_LONG_GROUP = r"\)(?:[*+]|\{\d*,(?:\d{3,})?\}|\{\d{3,}\})"
_SAME = {"n": r"\n", "r": r"\r", "t": r"\t", "f": r"\f", "a": r"\x07", "v": r"\x0b"}


class UnsupportedPatternError(ValueError):
    """A pattern that Python accepts and the JVM cannot express, or not run safely.

    Such a rule runs in Python: a silently missing rule would leak.
    """


def python_pattern_to_java(pattern: str) -> str | None:
    """The same pattern for java.util.regex; None if Python rejects it."""
    try:
        compiled = re.compile(pattern)
    except re.error:
        return None
    if compiled.flags & (re.VERBOSE | re.ASCII):
        raise UnsupportedPatternError("verbose and ASCII patterns are not supported")
    names = {name: f"g{i}x" for name, i in compiled.groupindex.items()}
    # d: only \n ends a line, as in Python; u: Unicode case folding
    return f"(?du){_WHOLE_CHARACTER}(?:{_Translation(pattern, names).run()})"


class _Translation:
    """One left-to-right pass over an already valid Python pattern."""

    def __init__(self, pattern: str, names: dict[str, str]):
        self.src, self.names, self.pos = pattern, names, 0

    def take(self, regex: str) -> re.Match[str] | None:
        match = re.compile(regex).match(self.src, self.pos)
        if match:
            self.pos = match.end()
        return match

    def run(self) -> str:
        out = []
        while self.pos < len(self.src):
            if self.take(r"\(\?#[^)]*\)"):
                continue
            if m := self.take(r"\(\?P<(\w+)>"):
                out.append(f"(?<{self.names[m[1]]}>")
            elif m := self.take(r"\(\?P=(\w+)\)"):
                out.append(rf"\k<{self.names[m[1]]}>")
            elif self.take(r"\(\?\("):
                raise UnsupportedPatternError("conditional groups are not supported")
            elif m := self.take(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?([:)])"):
                out.append(self.flags(m[1], m[2], m[3]))
            elif self.take(r"\["):
                out.append(self.char_class())
            elif self.take(r"\\"):
                out.append(self.escape(_OUTSIDE))
            elif m := self.take(r"\{(\d*),?(\d*)\}"):
                out.append(self.repeat(m))
            elif self.take(_LONG_GROUP):
                raise UnsupportedPatternError("the JVM's stack grows with every turn of a repeated group")
            else:
                ch = self.src[self.pos]
                self.pos += 1
                out.append("\\" + ch if ch in "{}" else ch)
        return "".join(out)

    @staticmethod
    def flags(on: str, off: str | None, close: str) -> str:
        if set(on + (off or "")) & set("aLx"):
            raise UnsupportedPatternError("inline flags a, L and x are not supported")
        on = on.replace("u", "")
        minus = f"-{off}" if off else ""
        if close == ")":
            return f"(?{on})" if on else ""
        return f"(?{on}{minus}:"

    @staticmethod
    def repeat(m: re.Match[str]) -> str:
        low, high, text = m[1], m[2], m[0]
        if not low and not high and "," not in text:
            return r"\{\}"
        if "," not in text:
            return text
        return "{%s,%s}" % (low or "0", high)

    def char_class(self) -> str:
        out = ["["]
        if self.take(r"\^"):
            out.append("^")
        first = True
        while True:
            if self.take(r"\]"):
                if not first:
                    return "".join(out) + "]"
                out.append(r"\]")
            elif self.take(r"\\"):
                out.append(self.escape(_IN_CLASS))
            else:
                ch = self.src[self.pos]
                self.pos += 1
                # Java reads [ and && inside a class as set operators
                out.append("\\" + ch if ch in "[&^" else ch)
            first = False

    def escape(self, table: dict[str, str]) -> str:
        in_class = table is _IN_CLASS
        if m := self.take(r"x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})"):
            return r"\x{%s}" % next(g for g in m.groups() if g).lstrip("0").rjust(1, "0")
        if m := self.take(r"N\{([^}]+)\}"):
            return r"\x{%x}" % ord(unicodedata.lookup(m[1]))
        if m := self.take(r"0[0-7]{0,2}|[0-3][0-7]{2}" + ("|[0-7]{1,3}" if in_class else "")):
            return r"\x{%x}" % int(m[0], 8)
        if m := self.take(r"[1-9][0-9]?"):
            # a digit that follows must not join the group number in Java
            return rf"(?:\{m[0]})"
        ch = self.src[self.pos]
        self.pos += 1
        if ch in table:
            return table[ch]
        return _SAME.get(ch, "\\" + ch)
