"""Tokens of C and C++ text."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, number, text, op, directive
    text: str
    line: int
    col: int
    start: int
    stop: int


# What operators and punctuation look like, longest first within each length.
OPERATORS = [
    "<<=", ">>=", "...", "->*", "::", "->", "++", "--", "<<", ">>", "<=", ">=", "==", "!=", "&&", "||", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", ".*",
    "+", "-", "*", "/", "%", "&", "|", "^", "!", "~", "<", ">", "=", "?", ":", ";", ",", ".", "(", ")", "[", "]", "{", "}",
]

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<directive>\#[ \t]*(?:ifdef|ifndef|if|else|elif|endif)\b(?:\\\n|[^\n])*)"
    r"|(?P<text>L?\"(?:[^\"\\\n]|\\.)*\"?|L?'(?:[^'\\\n]|\\.)*'?)"
    r"|(?P<word>[A-Za-z_~][A-Za-z0-9_]*)"
    r"|(?P<number>(?:0[xX][0-9a-fA-F]+|[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)[uUlLfF]*)"
    r"|(?P<op>" + "|".join(map(re.escape, OPERATORS)) + r")",
    re.DOTALL,
)


def tokens(text: str) -> list[Token]:
    """The tokens in order; comments, blanks and characters that begin no token are skipped."""
    out, line, line_start = [], 1, 0
    make = tuple.__new__
    for m in _TOKEN.finditer(text):
        kind, found, (at, end) = m.lastgroup, m.group(), m.span()
        if kind != "skip":
            out.append(make(Token, (kind, found, line, at - line_start, at, end - 1)))
        if "\n" in found:
            line += found.count("\n")
            line_start = at + found.rindex("\n") + 1
    return out


def without_else_arms(toks: list[Token]) -> list[Token]:
    """Tokens without directives, and without what stands in their ``#else`` and ``#elif`` arms."""
    out: list[Token] = []
    dropped: list[bool] = []
    for t in toks:
        if t.kind != "directive":
            if not any(dropped):
                out.append(t)
            continue
        word = t.text.lstrip("#").split()[0]
        if word.startswith("if"):
            dropped.append(False)
        elif word == "endif":
            if dropped:
                dropped.pop()
        elif dropped:
            dropped[-1] = True
    return out
