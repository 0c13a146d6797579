"""Rules from inline expressions, files and dicts."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

from assaykit.errors import RuleError
from assaykit.model import Action, Rule, RuleType, Severity, Target

_INLINE = re.compile(r"\s*([A-Za-z_]\w*)\s*\((.*)\)", re.DOTALL)
_ESCAPES = {r"\\": "\\", r"\n": "\n", r"\t": "\t", r"\r": "\r"}
#: Keys of a rule in a file that are parameters, and what they are called here.
_PARAMETERS = {
    "min": "min", "max": "max", "min_value": "min", "max_value": "max",
    "min_length": "min_length", "max_length": "max_length", "exact_length": "exact_length",
    "values": "allowed_values", "allowed_values": "allowed_values", "extract_domain": "extract_domain",
    "pattern": "pattern", "regex_pattern": "pattern",
    "format": "format_pattern", "format_pattern": "format_pattern",
    "filter_condition": "filter_condition", "filter": "filter_condition",
    "columns": "columns", "strict_mode": "strict_mode", "case_insensitive": "case_insensitive",
    "validation_type": "validation_type", "max_digits": "max_digits", "precision": "precision", "scale": "scale",
}


def _unquoted(text: str) -> str:
    return text.strip().strip("\"'")


def enum_value(text: str) -> int | float | str:
    """A whole number, a number or a text, whichever it reads as first."""
    text = _unquoted(text)
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def _numbers(values: list[str], kind: type, what: str) -> list[Any]:
    try:
        return [None if v.strip() == "" else kind(v) for v in values]
    except ValueError as e:
        raise RuleError(f"{what} needs numbers, not {', '.join(values)}") from e


def parse_inline(expression: str, table: str, database: str | None = None) -> Rule:
    """``not_null(id)``, ``length(name,2,50)``, ``range(age,0,120)``, ``enum(status,a,b)``, ``regex(email,…)``, …"""
    m = _INLINE.match(expression)
    if not m:
        raise RuleError(f"not a rule: {expression!r}")
    try:
        kind = RuleType(m[1].upper())
    except ValueError as e:
        raise RuleError(f"unknown rule type {m[1]!r} in {expression!r}") from e
    if kind == RuleType.SCHEMA:
        raise RuleError("SCHEMA rules come from contracts")
    column, comma, rest = m[2].partition(",")
    column = _unquoted(column)
    if not column:
        raise RuleError(f"no column in {expression!r}")
    parts = [p.strip() for p in rest.split(",")] if comma else []
    p: dict[str, Any] = {}
    if kind == RuleType.LENGTH:
        given = _numbers(parts, int, "length")
        if not given or len(given) > 2:
            raise RuleError(f"length takes one or two lengths: {expression!r}")
        p = dict(zip(("min_length", "max_length"), given, strict=False))
        if any(v is not None and v < 0 for v in given):
            raise RuleError(f"lengths must not be negative: {expression!r}")
    elif kind == RuleType.RANGE:
        given = _numbers(parts, float, "range")
        if not given or len(given) > 2:
            raise RuleError(f"range takes one or two bounds: {expression!r}")
        p = dict(zip(("min", "max"), given, strict=False))
    elif kind == RuleType.ENUM:
        p = {"allowed_values": [enum_value(v) for v in parts if v]}
    elif kind == RuleType.REGEX:
        if not comma:
            raise RuleError(f"regex takes a column and a pattern: {expression!r}")
        p = {"pattern": re.sub(r"\\[\\ntr]", lambda e: _ESCAPES[e[0]], _unquoted(rest)) if "\\\\" in rest or any(e in rest for e in (r"\n", r"\t", r"\r")) else _unquoted(rest)}
    elif kind == RuleType.DATE_FORMAT:
        fmt = _unquoted(rest)
        p = {"format_pattern": fmt, "format": fmt}
    return Rule(kind, Target(table, column, database), {k: v for k, v in p.items() if v is not None}, description=expression.strip())


def rule_parameters(given: dict[str, Any]) -> dict[str, Any]:
    """Parameters at the top level and under ``parameters``; those at the top level win."""
    out: dict[str, Any] = {}
    for source in (given.get("parameters") or {}, given.get("params") or {}, given):
        out |= {_PARAMETERS[k]: v for k, v in source.items() if k in _PARAMETERS and v is not None}
    return out


def rule_from_dict(given: dict[str, Any], table: str | None = None, database: str | None = None) -> Rule:
    """A rule with ``type``, ``column`` or ``target`` (text, or an object with entities or names), and parameters."""
    if not isinstance(given, dict):
        raise RuleError(f"a rule is an object, not {given!r}")
    name = str(given.get("type") or given.get("rule_type") or "").upper()
    if name not in RuleType.__members__:
        raise RuleError(f"unknown rule type {given.get('type')!r}")
    return Rule(
        RuleType(name),
        _target(given, table, database),
        rule_parameters(given),
        name=str(given.get("name") or given.get("rule_name") or ""),
        **({"id": str(given["id"])} if given.get("id") else {}),
        severity=Severity.of(given.get("severity")),
        action=Action(str(given.get("action", "ALERT")).upper()) if str(given.get("action", "ALERT")).upper() in Action.__members__ else Action.ALERT,
        threshold=float(given.get("threshold") or 0.0),
        is_active=bool(given.get("is_active", True)),
        description=str(given.get("description") or ""),
    )


def _target(given: dict[str, Any], table: str | None, database: str | None) -> Target:
    target = given.get("target")
    if isinstance(target, str):
        return Target.parse(target)
    names = dict(given)
    if isinstance(target, dict):
        names |= (target.get("entities") or [target])[0]
    own = names.get("table") or names.get("table_name") or table
    if not own:
        raise RuleError(f"no table for rule {given.get('name') or given.get('type')!r}")
    return Target(own, names.get("column") or names.get("column_name") or None, names.get("database") or database)


def merge_parameters(*given: dict[str, Any] | None) -> dict[str, Any]:
    """Later ones win; what is None doesn't count."""
    out: dict[str, Any] = {}
    for g in given:
        out |= {k: v for k, v in (g or {}).items() if v is not None}
    return out


def read_rules(path: str | Path, table: str, database: str | None = None) -> list[Rule]:
    """A JSON file with ``{"rules": [...]}`` or a bare list."""
    with open(path, encoding="utf-8") as f:
        try:
            content = json.load(f)
        except json.JSONDecodeError as e:
            raise RuleError(f"{path} is not JSON: {e}") from e
    rules = content.get("rules") if isinstance(content, dict) else content
    if not isinstance(rules, list) or not rules:
        raise RuleError(f"{path} has no list of rules")
    return [rule_from_dict(r, table, database) for r in rules]


def parse_rules(table: str, inline: list[str] | tuple[str, ...] = (), file: str | Path | None = None, database: str | None = None) -> list[Rule]:
    found = [parse_inline(r, table, database) for r in inline] + (read_rules(file, table, database) if file else [])
    if not found:
        raise RuleError("no rules given")
    return found
