"""Gate policy: limits and severities of the rules, and justified exceptions."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import os
import re
import tomllib
from dataclasses import dataclass, field

SHINGLE_WIDTH = 5
SEVERITIES = ("off", "warn", "error")
#: Rule ids of findings, by the policy section that governs them.
RULES = {
    "function_mass": "function-mass",
    "near_clone": "near-clone",
    "lint_suppression": "lint-suppression-growth",
    "unsafe_surface": "unsafe-surface-growth",
    "dependency_surface": "dependency-surface-growth",
    "structural_erosion": "structural-erosion",
}


class PolicyError(ValueError):
    """A policy that can't be read or holds a value out of range."""


@dataclass(frozen=True)
class Rule:
    severity: str = "warn"


@dataclass(frozen=True)
class FunctionMass(Rule):
    new_function_limit: float = 80.0
    delta_limit: float = 20.0


@dataclass(frozen=True)
class NearClone(Rule):
    minimum_sloc: int = 8
    minimum_tokens: int = 40
    similarity_threshold: float = 0.85
    max_candidates: int = 64
    detect_blocks: bool = True
    block_max_candidates: int = 256
    block_max_families: int = 3
    block_minimum_tokens: int | None = None

    @property
    def block_tokens(self) -> int:
        return self.block_minimum_tokens if self.block_minimum_tokens is not None else 3 * self.minimum_tokens

    @property
    def block_run(self) -> int:
        """Windows that a block of the least size spans."""
        return self.block_tokens - (SHINGLE_WIDTH - 1)


@dataclass(frozen=True)
class StructuralErosion(Rule):
    erosion_limit: float = 0.50
    delta_limit: float = 0.08
    mass_growth_limit: float = 0.08
    complexity_cutoff: int = 10
    top_contributors: int = 3


@dataclass(frozen=True)
class Suppression:
    rule: str
    path: str
    reason: str
    line: int | None = None


@dataclass(frozen=True)
class Policy:
    version: int = 1
    function_mass: FunctionMass = field(default_factory=FunctionMass)
    near_clone: NearClone = field(default_factory=NearClone)
    lint_suppression: Rule = field(default_factory=Rule)
    unsafe_surface: Rule = field(default_factory=Rule)
    dependency_surface: Rule = field(default_factory=Rule)
    structural_erosion: StructuralErosion = field(default_factory=StructuralErosion)
    suppressions: tuple[Suppression, ...] = ()

    def severities(self) -> dict[str, str]:
        """Severity by rule id."""
        return {rule_id: getattr(self, section).severity for section, rule_id in RULES.items()}

    def fingerprint(self) -> str:
        """A digest of every value, whatever their order in the file."""
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()

    def with_rule(self, section: str, **values) -> Policy:
        changed = dataclasses.replace(self, **{section: dataclasses.replace(getattr(self, section), **values)})
        validate(changed)
        return changed


def is_relative_path(path: str) -> bool:
    """Whether a path is relative and ``/``-separated, without empty, ``.`` or ``..`` segments."""
    return bool(path) and "\\" not in path and all(part not in ("", ".", "..") for part in path.split("/"))


def _section(kind: type, values: object, name: str):
    if not isinstance(values, dict):
        raise PolicyError(f"{name} must be a table")
    known = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise PolicyError(f"{name} has unknown keys: {', '.join(unknown)}")
    clean = {}
    for key, value in values.items():
        wanted = str(known[key].type)
        if wanted == "float" and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        kinds = {"float": float, "int": int, "int | None": int, "bool": bool, "str": str}[wanted]
        if not isinstance(value, kinds) or (kinds is int and isinstance(value, bool)):
            raise PolicyError(f"{name}.{key} must be of type {wanted}")
        clean[key] = value
    try:
        return kind(**clean)
    except TypeError as error:
        raise PolicyError(f"{name}: {error}") from None


def parse_policy(text: str | bytes) -> Policy:
    """A validated policy from TOML; blank text gives the defaults."""
    try:
        data = tomllib.loads(text.decode() if isinstance(text, bytes) else text)
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as error:
        raise PolicyError(f"policy is not valid TOML: {error}") from None
    if unknown := sorted(set(data) - {"version", "rules", "suppressions"}):
        raise PolicyError(f"policy has unknown keys: {', '.join(unknown)}")
    rules = data.get("rules", {})
    if unknown := sorted(set(rules) - set(RULES)):
        raise PolicyError(f"rules has unknown keys: {', '.join(unknown)}")
    sections = {f.name: f.default_factory for f in dataclasses.fields(Policy) if f.name in RULES}
    policy = Policy(
        version=data.get("version", 1),
        suppressions=tuple(_section(Suppression, s, "suppressions") for s in data.get("suppressions", [])),
        **{name: _section(kind, rules.get(name, {}), f"rules.{name}") for name, kind in sections.items()},
    )
    validate(policy)
    return policy


def load_policy(path: str) -> Policy:
    """The policy in a file; defaults if there is none."""
    if not os.path.exists(path):
        return Policy()
    with open(path, "rb") as file:
        return parse_policy(file.read())


def validate(policy: Policy) -> None:
    """Raise :class:`PolicyError` unless every value is in range."""

    def need(sound: bool, what: str) -> None:
        if not sound:
            raise PolicyError(what)

    need(policy.version == 1, f"unsupported policy version {policy.version}")
    for section, rule_id in RULES.items():
        need(getattr(policy, section).severity in SEVERITIES, f"severity of {rule_id} must be one of {', '.join(SEVERITIES)}")
    mass, clone, erosion = policy.function_mass, policy.near_clone, policy.structural_erosion
    for value in (mass.new_function_limit, mass.delta_limit, erosion.delta_limit, erosion.mass_growth_limit):
        need(math.isfinite(value) and value >= 0, "limits must be finite and not negative")
    need(0 <= clone.similarity_threshold <= 1 and 0 <= erosion.erosion_limit <= 1, "ratios must lie between 0 and 1")
    positive = (clone.minimum_sloc, clone.max_candidates, clone.block_max_candidates, clone.block_max_families)
    need(all(v > 0 for v in positive), "near-clone limits must be positive")
    need(clone.minimum_tokens > SHINGLE_WIDTH and clone.block_tokens > SHINGLE_WIDTH, "token limits must exceed one shingle window")
    need(1 <= erosion.top_contributors <= 10, "top_contributors must lie between 1 and 10")
    need(erosion.complexity_cutoff >= 0, "complexity_cutoff must not be negative")
    for s in policy.suppressions:
        need(s.rule in RULES.values(), f"suppression of unknown rule {s.rule}")
        need(is_relative_path(s.path), f"suppression path {s.path} must be relative")
        need(s.line is None or s.line > 0, "suppression line must be positive")
        need(bool(s.reason.strip()), "suppression needs a reason")


def render_policy(policy: Policy) -> str:
    """The policy as TOML that :func:`parse_policy` reads back."""

    def scalar(value: object) -> str:
        return json.dumps(value)

    lines = [f"version = {policy.version}"]
    for section in RULES:
        lines += ["", f"[rules.{section}]"]
        lines += [f"{k} = {scalar(v)}" for k, v in dataclasses.asdict(getattr(policy, section)).items() if v is not None]
    for s in policy.suppressions:
        lines += ["", "[[suppressions]]", *(f"{k} = {scalar(v)}" for k, v in dataclasses.asdict(s).items() if v is not None)]
    return "\n".join(lines) + "\n"


def write_policy_file(path: str, force: bool = False) -> None:
    """Write the default policy; an existing file stays unless ``force``."""
    with open(path, "w" if force else "x", encoding="utf-8") as file:
        file.write(render_policy(Policy()))


def is_object_id(text: str) -> bool:
    """Whether a text is a full commit id: 40 or 64 hexadecimal digits."""
    return re.fullmatch(r"[0-9a-fA-F]{40}|[0-9a-fA-F]{64}", text) is not None
