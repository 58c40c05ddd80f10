"""Functions of Rust and TypeScript sources, by lexers and bracket matching.

A grammar is out of reach without its library: names, ranges, tokens, complexity
and roles follow from tokens; structural streams are nested brackets and keywords.
"""

from __future__ import annotations

import hashlib
import re

from strata.extract.common import Facts, Function, ParseError, Token, brackets, is_test, lex, shape_stream

RUST = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<string>b?r(?P<_h>\#*)"(?:.|\n)*?"(?P=_h)|b?"(?:\\(?:.|\n)|[^"\\])*"|b?'(?:\\(?:[^u]|u\{[0-9a-fA-F_]+\})[0-9a-fA-F]?|[^'\\\n])')"""
    r"""|(?P<number>[0-9][0-9A-Za-z_]*(?:\.[0-9][0-9A-Za-z_]*)?)|(?P<word>'?[^\W\d]\w*)|(?P<mark>=>|->|::|&&|\|\||\.\.=?|[-+*/%^!&|=<>]=|<<|>>|[^\w\s"])"""
)
TYPESCRIPT = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<string>"(?:\\(?:.|\n)|[^"\\\n])*"|'(?:\\(?:.|\n)|[^'\\\n])*'|`(?:\\(?:.|\n)|[^`\\])*`)"""
    r"""|(?P<number>[0-9][0-9A-Za-z_]*(?:\.[0-9]+)?)|(?P<word>[^\W\d][\w$]*|[$][\w$]*)|(?P<mark>=>|&&=?|\|\|=?|\?\?=?|\?\.|===?|!==?|\.\.\.|[^\w\s])"""
)
RUST_WORDS = frozenset("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type unsafe use where while".split())
TS_WORDS = frozenset("async await break case catch class const continue default delete do else export extends finally for function if import in instanceof interface let new of return static super switch this throw try typeof var void while yield".split())
_FLOW = {"if", "for", "while", "loop", "match"}
_LINT = re.compile(r"^(?P<inner>!?)\[\s*(?P<body>(?:cfg_attr\s*\(.*?,\s*)?(?P<kind>allow|expect)\s*\((?P<lints>[^()]*)\)\s*\)?)\s*\]$", re.S)


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def _leaf(t: Token, words: frozenset[str], names: frozenset[str]) -> str:
    if t.kind == "word":
        if t.text in ("true", "false", "null", "undefined"):
            return "LIT"
        return t.text if t.text in words and t.text not in names else "ID"
    return t.leaf


def _lines_of(tokens: list[Token]) -> set[int]:
    return {n for t in tokens for n in range(t.line, t.line + t.text.count("\n") + 1)}


def _end(t: Token) -> int:
    return t.line + t.text.count("\n")


def rust_complexity(tokens: list[Token]) -> int:
    """One, and one for each branch: if, loops, ``?``, ``&&``, ``||`` and match arms but a bare ``_``.

    The ``if`` of a match guard belongs to its arm. Of a macro's arguments, which
    have no syntax of their own, only ``&&`` and ``||`` count.
    """
    total, macros = 1, _macro_arguments(tokens)
    for i, t in enumerate(tokens):
        before = tokens[i - 1].text if i else ""
        if t.kind == "mark" and t.text in ("&&", "||"):
            total += not (t.text == "||" and before in ("(", ",", "=", "move", "{", "=>", "return"))  # a closure without arguments
        elif i in macros:
            continue
        elif t.kind == "word" and t.text in ("while", "loop") or t.text == "for" and before not in (">", "<") and not _is_impl_for(tokens, i):
            total += 1
        elif t.kind == "word" and t.text == "if":
            total += not _is_guard(tokens, i)
        elif t.kind == "mark" and t.text == "?":
            total += 1
        elif t.text == "=>":
            bare = before == "_" and tokens[i - 2].text in ("{", ",", "}") if i > 1 else False
            total += not bare
    return total


def _macro_arguments(tokens: list[Token]) -> set[int]:
    """Places inside the brackets of macro calls."""
    out: set[int] = set()
    for i in range(len(tokens) - 2):
        called = tokens[i].kind == "word" and tokens[i].text not in RUST_WORDS and tokens[i + 1].text == "!"
        if called and i not in out and tokens[i + 2].text in ("(", "[", "{"):
            out.update(range(i + 3, _close_of(tokens, i + 2)))
    return out


def _close_of(tokens: list[Token], i: int) -> int:
    """The place of the bracket that closes the one at ``i``, or the end."""
    depth = 0
    for k in range(i, len(tokens)):
        depth += (tokens[k].text in ("(", "[", "{")) - (tokens[k].text in (")", "]", "}"))
        if not depth:
            return k
    return len(tokens)


def _is_guard(tokens: list[Token], i: int) -> bool:
    """Whether the ``if`` at ``i`` comes to an arrow before it comes to a block."""
    k = i + 1
    while k < len(tokens):
        if tokens[k].text in ("{", ";", "}"):
            return False
        if tokens[k].text == "=>":
            return True
        k = _close_of(tokens, k) + 1 if tokens[k].text in ("(", "[") else k + 1
    return False


def _builds(tokens: list[Token]) -> bool:
    """Whether a struct or tuple expression stands among ``tokens``; calls, patterns, and macro arguments are none."""
    macros = _macro_arguments(tokens)
    for i, t in enumerate(tokens):
        if i in macros or t.text not in ("(", "{"):
            continue
        end = _close_of(tokens, i)
        after = end + 1
        while after < len(tokens) and tokens[after].text in (")", "]"):
            after += 1
        if after < len(tokens) and tokens[after].text in ("=>", "=", "in", "|", "if"):
            continue  # a pattern
        before = tokens[i - 1] if i else None
        if t.text == "{":
            k = i - 1
            while k > 1 and tokens[k - 1].text == "::":
                k -= 2
            lead = tokens[k - 1].text if k > 0 else ""
            if before and before.kind == "word" and before.text[:1].isupper() and lead not in ("if", "while", "match", "in", "==", "!=", "<", ">", "<=", ">=", "&&", "||", "!"):
                return True
        elif before is None or before.text in ("=", "(", ",", "{", "}", ";", "=>", "[", "return", "break", "&", "=="):
            k, comma = i + 1, False
            while k < end:
                comma |= tokens[k].text == ","
                k = _close_of(tokens, k) + 1 if tokens[k].text in ("(", "[", "{") else k + 1
            if comma:
                return True
    return False


def _is_impl_for(tokens: list[Token], i: int) -> bool:
    return i + 1 < len(tokens) and tokens[i + 1].text == "<"


def _rust_role(path: str, scopes: list[str], name: str, cc: int, body: list[Token]) -> str:
    if is_test(path, scopes, name):
        return "test"
    texts = [t.text for t in body]
    reads = "." in texts or "[" in texts
    if cc <= 1 and reads and not _FLOW & set(texts) and "let" not in texts:
        return "accessor"
    if cc <= 3 and (name == "new" or name.startswith(("new_", "from_", "with_")) or _builds(body)):
        return "constructor"
    return "general"


def extract_rust(path: str, text: str) -> Facts:
    """Functions outside of others; lint suppressions and unsafe surface anywhere.

    Nested functions have no record of their own, and count neither tokens nor
    branches of the outer one, but their lines do.
    """
    tokens, _ = lex(text, RUST)
    match = brackets(tokens)
    facts = Facts("rust")

    def body_at(i: int, stop: int) -> int | None:
        while i < stop:
            if tokens[i].text == "{":
                return i
            if tokens[i].text == ";":
                return None
            i = match[i] + 1 if i in match else i + 1
        return None

    def scope_name(i: int, brace: int) -> str:
        own = tokens[i + 1 : brace]
        if tokens[i].text in ("mod", "trait"):
            return own[0].text
        at = max((k for k, t in enumerate(own) if t.text == "for"), default=None)
        named = own[at + 1 :] if at is not None else own
        depth, words = 0, []
        for t in named:
            depth += (t.text == "<") - (t.text == ">")
            if t.text == "where":
                break
            if depth == 0 and t.kind == "word" and not t.text.startswith("'"):
                words.append(t.text)
        return words[-1] if words else "?"

    def nested(low: int, high: int) -> list[tuple[int, int]]:
        out, i = [], low
        while i < high:
            if tokens[i].text == "fn" and i + 1 < high and tokens[i + 1].kind == "word":
                brace = body_at(i + 2, high)
                if brace is not None:
                    out.append((i, match[brace]))
                    i = match[brace]
            i += 1
        return out

    def record(i: int, brace: int, scopes: list[str]) -> None:
        end = match[brace]
        inner = nested(brace + 1, end)
        own = [t for k, t in enumerate(tokens[i : end + 1], i) if not any(a <= k <= b for a, b in inner)]
        name = tokens[i + 1].text
        cc = rust_complexity([t for k, t in enumerate(tokens[brace : end + 1], brace) if not any(a <= k <= b for a, b in inner)])
        shape, lines = shape_stream(own, RUST_WORDS)
        leaves = [_leaf(t, RUST_WORDS, frozenset({"self", "super", "crate"})) for t in own]
        role = _rust_role(path, scopes, name, cc, tokens[brace + 1 : end])
        facts.functions.append(
            Function("::".join([*scopes, name]), name, tokens[i].line, _end(tokens[end]), cc, len(_lines_of(tokens[i : end + 1])), role, leaves, [t.line for t in own], shape, lines)
        )

    def walk(low: int, high: int, scopes: list[str]) -> None:
        i = low
        while i < high:
            t = tokens[i]
            if t.text == "fn" and i + 1 < high and tokens[i + 1].kind == "word":
                brace = body_at(i + 2, high)
                if brace is not None:
                    record(i, brace, scopes)
                    i = match[brace] + 1
                    continue
            elif t.text in ("mod", "trait", "impl") and t.kind == "word":
                brace = body_at(i + 1, high)
                if brace is not None:
                    walk(brace + 1, match[brace], [*scopes, scope_name(i, brace)])
                    i = match[brace] + 1
                    continue
            i += 1

    def item_after(i: int) -> tuple[str, list[str]]:
        while i < len(tokens) and tokens[i].text == "#" and i + 1 in match:
            i = match[i + 1] + 1
        stop = i
        while stop < len(tokens) and tokens[stop].text != ";":
            if tokens[stop].text == "{":
                stop = match[stop]
                break
            stop = match.get(stop, stop) + 1
        own = tokens[i : stop + 1]
        kind = next((t.text for t in own if t.text in RUST_WORDS - {"pub", "async", "unsafe", "const", "crate", "extern"}), "item")
        return kind, [t.leaf for t in own]

    for i, t in enumerate(tokens):
        if t.text == "#" and i + 1 < len(tokens):
            start = i + 1 + (tokens[i + 1].text == "!")
            if start in match:
                raw = "".join(("!" if start == i + 2 else "", *(x.text + (" " if x.kind == "word" else "") for x in tokens[start : match[start] + 1])))
                if m := _LINT.match(raw):
                    lints = sorted({re.sub(r"\s", "", x) for x in m["lints"].split(",") if x.strip()})
                    kind, target = ("file", ["file"]) if m["inner"] else item_after(match[start] + 1)
                    facts.lints.append((m["kind"], lints, _digest(target), kind, t.line))
        elif t.text == "unsafe" and i + 1 < len(tokens):
            word = tokens[i + 1].text
            kind = {"{": "block", "fn": "function", "trait": "trait", "impl": "impl", "extern": "extern"}.get(word)
            if kind:
                _, target = item_after(i) if kind != "block" else ("", [x.leaf for x in tokens[i : match[i + 1] + 1]])
                facts.unsafe.append((f"unsafe-{kind}", _digest(target), t.line))
    walk(0, len(tokens), [])
    return facts


def ts_complexity(tokens: list[Token]) -> int:
    words = sum(t.kind == "word" and t.text in ("if", "for", "while", "do", "catch", "case") for t in tokens)
    marks = sum(t.kind == "mark" and t.text in ("&&", "||", "??") for t in tokens)
    ternaries = sum(t.text == "?" and i + 1 < len(tokens) and tokens[i + 1].text not in (":", ")", ",", ";", "=", "(") for i, t in enumerate(tokens))
    double = sum(t.text == "do" for t in tokens)  # its while is the same loop
    return 1 + words + marks + ternaries - double


def extract_typescript(path: str, text: str) -> Facts:
    """Function declarations and methods with a body, nested ones too; overloads without a body are left out."""
    tokens, _ = lex(text, TYPESCRIPT)
    match = brackets(tokens)
    facts = Facts("typescript")
    found: list[tuple[int, int, str, list[str]]] = []

    def body_after(i: int, stop: int) -> int | None:
        """The body's brace after a parameter list, past a return type."""
        depth_type = tokens[i].text == ":" if i < stop else False
        while i < stop:
            if tokens[i].text == "{":
                after = match[i] + 1
                if depth_type and after < stop and tokens[after].text == "{":
                    i = after
                    continue
                return i
            if tokens[i].text in (";", "}", "=", ","):
                return None
            i = match[i] + 1 if i in match else i + 1
        return None

    def walk(low: int, high: int, scopes: list[str], in_class: bool) -> None:
        i = low
        while i < high:
            t = tokens[i]
            if t.text == "class" and t.kind == "word":
                brace = next((k for k in range(i + 1, high) if tokens[k].text == "{"), None)
                if brace is None:
                    raise ParseError(f"{t.line}: class without a body")
                named = tokens[i + 1].kind == "word" and tokens[i + 1].text not in ("extends", "implements")
                walk(brace + 1, match[brace], [*scopes, tokens[i + 1].text] if named else scopes, True)
                i = match[brace] + 1
                continue
            start = None
            if t.text == "function" and i + 1 < high:
                at = i + 1 + (tokens[i + 1].text == "*")
                if at < high and tokens[at].kind == "word":
                    start, name = at, tokens[at].text
            elif in_class and t.kind == "word" and i + 1 < high and tokens[i + 1].text in ("(", "<"):
                start, name = i, t.text
                if i > low and tokens[i - 1].text in ("get", "set"):
                    name = f"{tokens[i - 1].text} {name}"
            if start is not None:
                opening = next((k for k in range(start + 1, high) if tokens[k].text == "("), None)
                brace = body_after(match[opening] + 1, high) if opening is not None else None
                if brace is not None:
                    found.append((i, match[brace], name, scopes))
                    walk(brace + 1, match[brace], [*scopes, name], False)
                    i = match[brace] + 1
                    continue
            if in_class and i in match:
                walk(i + 1, match[i], scopes, False)
                i = match[i] + 1
                continue
            i += 1

    walk(0, len(tokens), [], False)
    for low, high, name, scopes in sorted(found, key=lambda x: x[0]):
        inner = [(a, b) for a, b, _, _ in found if low < a and b <= high]
        own = [t for k, t in enumerate(tokens[low : high + 1], low) if not any(a <= k <= b for a, b in inner)]
        cc = ts_complexity(own)
        texts = {t.text for t in own}
        accessor = cc <= 1 and not {"if", "for", "while", "switch", "const", "let", "var"} & texts and ("." in texts or name.startswith(("get ", "set ")))
        if is_test(path, scopes, name) or name.startswith("test"):
            role = "test"
        elif accessor:
            role = "accessor"
        elif cc <= 3 and (name == "constructor" or re.match(r"(new|from|with|create)(?=[A-Z_]|$)", name)):
            role = "constructor"
        else:
            role = "general"
        shape, lines = shape_stream(own, TS_WORDS)
        leaves = [_leaf(t, TS_WORDS, frozenset({"this", "super"})) for t in own]
        facts.functions.append(
            Function("::".join([*scopes, name]), name, tokens[low].line, _end(tokens[high]), cc, len(_lines_of(own)), role, leaves, [t.line for t in own], shape, lines)
        )
    return facts
