"""Contracts: JSON that declares tables' fields; they become SCHEMA rules and row rules."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from assaykit.errors import ContractError, RuleError
from assaykit.model import Report, Rule, RuleType, Target
from assaykit.plans.types import parse_type

#: Keys of a field; others are warned about.
FIELD_KEYS = {"field", "type", "required", "enum", "min", "max", "max_length", "precision", "scale", "desired_type", "nullable", "description"}
TABLE_KEYS = {"rules", "strict_mode", "case_insensitive", "table", "description"}


@dataclass
class TableContract:
    name: str
    fields: list[dict[str, Any]]
    strict: bool = False
    case_insensitive: bool = False


@dataclass
class Contract:
    tables: list[TableContract]
    warnings: list[str] = field(default_factory=list)

    @property
    def fields(self) -> int:
        return sum(len(t.fields) for t in self.tables)


def read_contract(path: str | Path, table: str | None = None) -> Contract:
    with open(path, encoding="utf-8") as f:
        try:
            return parse_contract(json.load(f), table)
        except json.JSONDecodeError as e:
            raise ContractError(f"{path} is not JSON: {e}") from e


def parse_contract(payload: Any, table: str | None = None) -> Contract:
    """``{"rules": [...]}`` for one table, or ``{table: {"rules": [...], "strict_mode":, "case_insensitive":}}``."""
    if not isinstance(payload, dict) or not payload:
        raise ContractError("a contract is a JSON object")
    warnings: list[str] = []
    named = {table or payload.get("table") or "data": payload} if "rules" in payload else payload
    tables = []
    for name, body in named.items():
        if not isinstance(body, dict) or not isinstance(body.get("rules"), list):
            raise ContractError(f"table {name} needs a list of rules")
        warnings += [f"{name}: unknown key {k!r}" for k in body if k not in TABLE_KEYS]
        for key in ("strict_mode", "case_insensitive"):
            if not isinstance(body.get(key, False), bool):
                raise ContractError(f"{name}: {key} must be true or false")
        for f in body["rules"]:
            _check_field(name, f)
            warnings += [f"{name}.{f['field']}: unknown key {k!r}" for k in f if k not in FIELD_KEYS]
        tables.append(TableContract(str(name), body["rules"], body.get("strict_mode", False), body.get("case_insensitive", False)))
    return Contract(tables, warnings)


def _check_field(table: str, f: Any) -> None:
    where = f"{table}.{f.get('field')}" if isinstance(f, dict) else table

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ContractError(f"{where}: {what}")

    need(isinstance(f, dict), "a rule is an object")
    need(isinstance(f.get("field"), str) and f["field"].strip() != "", "needs the name of a field")
    need(isinstance(f.get("required", False), bool), "required must be true or false")
    need("enum" not in f or (isinstance(f["enum"], list) and bool(f["enum"])), "enum must be a list of values")
    for k in ("min", "max"):
        need(k not in f or (isinstance(f[k], (int, float)) and not isinstance(f[k], bool)), f"{k} must be a number")
    for k in ("type", "desired_type"):
        if k in f:
            try:
                info = parse_type(f[k])
            except RuleError as e:
                raise ContractError(f"{where}: {e}") from e
            if k == "type":
                kind = info.type
                need("max_length" not in f or kind == "STRING", "max_length is for strings")
                need(not {"precision", "scale"} & set(f) or kind == "FLOAT", "precision and scale are for floats")


def declared(f: dict[str, Any]) -> dict[str, Any]:
    """What a SCHEMA rule expects of a field."""
    info = parse_type(f["type"]) if "type" in f else None
    found = {"expected_type": info.type if info else None}
    for k in ("max_length", "precision", "scale"):
        value = f.get(k, getattr(info, k) if info else None)
        if value is not None:
            found[k] = value
    return found


def decompose(contract: Contract) -> tuple[list[Rule], list[Rule], dict[tuple[str, str], Any]]:
    """(a SCHEMA rule per table, row rules, desired types by table and field)."""
    schema_rules: list[Rule] = []
    row_rules: list[Rule] = []
    desired: dict[tuple[str, str], Any] = {}
    for t in contract.tables:
        columns = {f["field"]: declared(f) for f in t.fields if "type" in f}
        if columns:
            schema_rules.append(Rule(RuleType.SCHEMA, Target(t.name), {"columns": columns, "strict_mode": t.strict, "case_insensitive": t.case_insensitive}, name=f"schema_{t.name}"))
        for f in t.fields:
            target, name = Target(t.name, f["field"]), f["field"]
            if f.get("required"):
                row_rules.append(Rule(RuleType.NOT_NULL, target, name=f"not_null_{name}"))
            if "min" in f or "max" in f:
                row_rules.append(Rule(RuleType.RANGE, target, {k: f[k] for k in ("min", "max") if k in f}, name=f"range_{name}"))
            if "enum" in f:
                row_rules.append(Rule(RuleType.ENUM, target, {"allowed_values": f["enum"]}, name=f"enum_{name}"))
            if "desired_type" in f:
                desired[t.name, name] = f["desired_type"]
    return schema_rules, row_rules, desired


def skip_map(schema_report: Report, rules: list[Rule]) -> dict[str, str]:
    """Reasons to skip row rules, by their ids: no table, or no such field. A type that differs is no reason."""
    gone_tables, gone_fields = set(), set()
    for r in schema_report:
        details = r.details.get("schema_details", {})
        if not details.get("table_exists", True):
            gone_tables.add(r.rule.table)
        gone_fields |= {(r.rule.table, c["column"]) for c in details.get("field_results", []) if c["failure_code"] == "FIELD_MISSING"}
    out = {}
    for rule in rules:
        if rule.table in gone_tables:
            out[rule.id] = "TABLE_NOT_EXISTS"
        elif (rule.table, rule.column) in gone_fields:
            out[rule.id] = "FIELD_MISSING"
    return out
