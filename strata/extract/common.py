"""Facts of one source file, whatever its language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class ParseError(ValueError):
    """A file that can't be analysed; none of its facts are used."""


@dataclass
class Function:
    qualified_name: str
    name: str
    start_line: int
    end_line: int
    cc: int
    sloc: int
    role: str
    tokens: list[str]
    token_lines: list[int]
    shape: list[str]
    shape_lines: list[int]


@dataclass
class Facts:
    language: str
    functions: list[Function] = field(default_factory=list)
    lints: list[tuple[str, list[str], str, str, int]] = field(default_factory=list)  # kind, lints, target digest, target kind, line
    unsafe: list[tuple[str, str, int]] = field(default_factory=list)  # pattern, digest, line
    dependencies: list[tuple] = field(default_factory=list)


@dataclass(frozen=True)
class Token:
    kind: str  # word, number, string, mark
    text: str
    line: int

    @property
    def leaf(self) -> str:
        """The token as clone detection sees it."""
        if self.kind in ("number", "string"):
            return "LIT"
        return self.text


def lex(text: str, pattern: re.Pattern) -> tuple[list[Token], set[int]]:
    """Tokens without comments, and the lines that hold any.

    ``pattern`` has groups named after token kinds, ``comment`` and ``space``. A
    character that nothing matches is an error.
    """
    out, lines, at, line = [], set(), 0, 1
    while at < len(text):
        m = pattern.match(text, at)
        if m is None or m.end() == at:
            raise ParseError(f"{line}: unexpected character {text[at]!r}")
        kind, body = m.lastgroup, m[0]
        if kind not in ("space", "comment"):
            out.append(Token(kind, body, line))
            lines.update(range(line, line + body.count("\n") + 1))
        line += body.count("\n")
        at = m.end()
    return out, lines


def brackets(tokens: list[Token]) -> dict[int, int]:
    """The closing bracket's index for each opening one; unbalanced ones are an error."""
    pairs, stack, match = {")": "(", "]": "[", "}": "{"}, [], {}
    for i, t in enumerate(tokens):
        if t.kind != "mark":
            continue
        if t.text in "([{":
            stack.append(i)
        elif t.text in pairs:
            if not stack or tokens[stack[-1]].text != pairs[t.text]:
                raise ParseError(f"{t.line}: unbalanced {t.text}")
            match[stack.pop()] = i
    if stack:
        raise ParseError(f"{tokens[stack[-1]].line}: unclosed {tokens[stack[-1]].text}")
    return match


def shape_stream(tokens: list[Token], keywords: frozenset[str]) -> tuple[list[str], list[int]]:
    """Brackets as opened and closed nodes, keywords and marks as leaves, the rest by kind."""
    out, lines = [], []
    for t in tokens:
        if t.text in ("(", "[", "{"):
            item = f"N:{t.text}"
        elif t.text in (")", "]", "}"):
            item = f"/N:{t.text}"
        elif t.kind == "word":
            item = f"L:{t.text}" if t.text in keywords else "L:ID"
        else:
            item = "L:LIT" if t.leaf == "LIT" else f"L:{t.text}"
        out.append(item)
        lines.append(t.line)
    return out, lines


def is_test(path: str, scopes: list[str], name: str) -> bool:
    parts = path.split("/")
    return (
        any(s in ("test", "tests") for s in scopes)
        or "tests" in parts
        or bool(re.search(r"test\.[a-z]+$", parts[-1]))
        or name.startswith("test_")
        or name.endswith("_test")
    )
