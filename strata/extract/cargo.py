"""Dependency edges of Cargo manifests."""

from __future__ import annotations

import re
import tomllib

from strata.extract.common import Facts, ParseError

_TABLES = ("dependencies", "build-dependencies")


def _line(text: str, table: str, key: str) -> int:
    """The line of ``key`` in ``[table]``, or of its own ``[table.key]``; 1 if neither is found."""
    current = ""
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if header := re.match(r"\[([^\[\]]+)\]", line):
            current = re.sub(r"[\s\"']", "", header[1])
            if current == f"{table}.{key}":
                return number
        elif current == re.sub(r"[\"']", "", table) and re.match(rf"[\"']?{re.escape(key)}[\"']?\s*[.=]", line):
            return number
    return 1


def _edge(text: str, table: str, key: str, value: object) -> tuple:
    spec = {"version": value} if isinstance(value, str) else value
    if not isinstance(spec, dict):
        raise ParseError(f"dependency {key} is neither a text nor a table")
    if spec.get("workspace") is True:
        kind, source = "workspace", None
    elif "git" in spec:
        rest = "".join(f"#{k}={spec[k]}" for k in ("branch", "tag", "rev") if k in spec)
        kind, source = "git", str(spec["git"]).strip().rstrip("/") + rest
    elif "path" in spec:
        kind, source = "path", str(spec["path"]).strip().rstrip("/")
    else:
        kind, source = "registry", spec.get("registry")
    features = sorted({str(f) for f in spec.get("features", [])})
    default = spec.get("default-features", spec.get("default_features", True)) is True
    return table, key, str(spec.get("package", key)), kind, source, default, features, spec.get("version"), _line(text, table, key)


def extract(path: str, text: str) -> Facts:
    """Normal and build dependencies, also those of targets; those for development aren't part of the surface."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ParseError(str(error)) from None
    facts = Facts("cargo")
    places = [("", data)] + [(f"target.{name}.", own) for name, own in data.get("target", {}).items() if isinstance(own, dict)]
    for prefix, own in places:
        for table in _TABLES:
            for key, value in own.get(table, {}).items():
                facts.dependencies.append(_edge(text, prefix + table, key, value))
    return facts
