"""Functions of Python sources, by the standard library's parser."""

from __future__ import annotations

import ast
import io
import keyword
import tokenize

from strata.extract.common import Facts, Function, ParseError, is_test

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SKIPPED = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER}


def _last_part(node: ast.expr) -> str:
    target = node.func if isinstance(node, ast.Call) else node
    return target.attr if isinstance(target, ast.Attribute) else target.id if isinstance(target, ast.Name) else ""


def _descriptor(node) -> str | None:
    for decorator in node.decorator_list:
        part = _last_part(decorator)
        if part in ("property", "getter", "setter", "deleter"):
            return part
    return None


def _own(node: ast.AST):
    """A node's descendants, without nested functions."""
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, _DEFS):
            yield child
            yield from _own(child)


def complexity(node: ast.AST) -> int:
    total = 1
    for n in _own(node):
        if isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)):
            total += 1
        elif isinstance(n, ast.comprehension):
            total += 1 + len(n.ifs)
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
        elif isinstance(n, ast.match_case):
            total += (not _wildcard(n.pattern)) + (n.guard is not None)
    return total


def _wildcard(pattern: ast.pattern) -> bool:
    """Whether a case begins with a bare ``_``, alone or first of a sequence without brackets."""
    if isinstance(pattern, ast.MatchSequence) and pattern.patterns:
        first = pattern.patterns[0]
        return (pattern.lineno, pattern.col_offset) == (first.lineno, first.col_offset) and _wildcard(first)
    return isinstance(pattern, ast.MatchAs) and pattern.pattern is None and pattern.name is None


def _shape(node: ast.AST, out: list[str], lines: list[int], line: int) -> None:
    line = getattr(node, "lineno", line)
    name = type(node).__name__
    children = [c for c in ast.iter_child_nodes(node) if not isinstance(c, (*_DEFS, ast.expr_context))]
    if not children:
        out.append("L:ID" if isinstance(node, (ast.Name, ast.arg)) else "L:LIT" if isinstance(node, ast.Constant) else f"L:{name}")
        lines.append(line)
        return
    out.append(f"N:{name}")
    lines.append(line)
    for c in children:
        _shape(c, out, lines, line)
    out.append(f"/N:{name}")
    lines.append(line)


def extract(path: str, text: str) -> Facts:
    """Every ``def``, nested ones and methods too, in source order; overload stubs are left out."""
    try:
        tree = ast.parse(text)
        tokens = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type not in _SKIPPED]
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError) as error:
        raise ParseError(str(error)) from None
    facts = Facts("python")

    def leaf(t: tokenize.TokenInfo) -> str:
        if t.type == tokenize.NAME:
            if t.string in ("True", "False", "None"):
                return "LIT"
            return t.string if keyword.iskeyword(t.string) else "ID"
        return t.string if t.type == tokenize.OP else "LIT"

    def record(node, scopes: list[str]) -> None:
        nested = [(n.lineno if not n.decorator_list else n.decorator_list[0].lineno, n.end_lineno) for n in ast.walk(node) if isinstance(n, _DEFS) and n is not node]
        own = [
            t for t in tokens
            if node.lineno <= t.start[0] <= node.end_lineno and not any(a <= t.start[0] <= b for a, b in nested)
        ]
        code = {line for t in own for line in range(t.start[0], t.end[0] + 1)}
        kind = _descriptor(node)
        name = f"{node.name}@{kind}" if kind else node.name
        cc = complexity(node)
        role = "test" if is_test(path, scopes, node.name) else "accessor" if kind and cc == 1 else "general"
        shape, shape_lines = [], []
        _shape(node, shape, shape_lines, node.lineno)
        facts.functions.append(
            Function(".".join([*scopes, name]), node.name, node.lineno, node.end_lineno, cc, len(code), role, [leaf(t) for t in own], [t.start[0] for t in own], shape, shape_lines)
        )

    def walk(node: ast.AST, scopes: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, _DEFS):
                if not any(_last_part(d) == "overload" for d in child.decorator_list):
                    record(child, scopes)
                    walk(child, [*scopes, child.name])
            elif isinstance(child, ast.ClassDef):
                walk(child, [*scopes, child.name])
            else:
                walk(child, scopes)

    walk(tree, [])
    return facts
