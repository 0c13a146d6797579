"""The SCHEMA rule: declared columns against a table's schema. No job is run."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from assaykit.model import Result, Rule, Status
from assaykit.plans.types import from_spark


@dataclass
class FieldCheck:
    column: str
    existence: str
    type: str
    failure_code: str  # NONE, FIELD_MISSING, TYPE_MISMATCH or METADATA_MISMATCH
    native: dict[str, Any] = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)

    def to_dict(self) -> dict[str, Any]:
        return {"column": self.column, "existence": self.existence, "type": self.type, "failure_code": self.failure_code, "native_type": self.native.get("type"), "native_metadata": {k: v for k, v in self.native.items() if k != "type"}, "problems": self.problems}


def check_fields(schema: T.StructType, columns: dict[str, dict[str, Any]], *, strict: bool = False, case_insensitive: bool = False) -> tuple[list[FieldCheck], list[str]]:
    """(a check for each declared column, the undeclared columns if strict). Metadata must be equal where declared."""
    key = str.lower if case_insensitive else str
    there = {key(f.name): f for f in schema.fields}
    checks = []
    for name, want in columns.items():
        field_ = there.get(key(name))
        if field_ is None:
            checks.append(FieldCheck(name, "FAILED", "SKIPPED", "FIELD_MISSING"))
            continue
        native = from_spark(field_)
        if native.type != str(want["expected_type"]).upper():
            checks.append(FieldCheck(name, "PASSED", "FAILED", "TYPE_MISMATCH", native.to_dict(), [f"type is {native.type or field_.dataType.simpleString()}"]))
            continue
        wrong = [f"{k} is {getattr(native, k)}, not {want[k]}" for k in ("max_length", "precision", "scale") if want.get(k) is not None and getattr(native, k) != want[k]]
        checks.append(FieldCheck(name, "PASSED", "FAILED" if wrong else "PASSED", "METADATA_MISMATCH" if wrong else "NONE", native.to_dict(), wrong))
    declared = {key(c) for c in columns}
    return checks, sorted(f.name for f in schema.fields if key(f.name) not in declared) if strict else []


def run_schema_rule(rule: Rule, schema: T.StructType | None) -> Result:
    """total_records counts the declared columns; a table that is missing (None) fails all of them."""
    p = rule.parameters
    if schema is None:
        checks = [FieldCheck(c, "FAILED", "SKIPPED", "FIELD_MISSING") for c in p["columns"]]
        extras, exists = [], False
    else:
        checks, extras = check_fields(schema, p["columns"], strict=bool(p.get("strict_mode")), case_insensitive=bool(p.get("case_insensitive")))
        exists = True
    failed = sum(c.failure_code != "NONE" for c in checks) + len(extras)
    details = {"schema_details": {"field_results": [c.to_dict() for c in checks], "extras": extras, "table_exists": exists}}
    result = Result.counted(rule, len(checks), failed, details=details)
    if not exists:
        result.status, result.message = Status.FAILED, f"table {rule.table} not found"
    return result
