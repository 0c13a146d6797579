"""Whether a column's values can become a desired type, and the rule that has to be checked where that is open."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from assaykit.errors import ContractError
from assaykit.functions import formats
from assaykit.model import Rule, RuleType, Target
from assaykit.plans.types import CANONICAL, TypeInfo, parse_type

COMPATIBLE, INCOMPATIBLE, CONFLICTING = "COMPATIBLE", "INCOMPATIBLE", "CONFLICTING"

#: For each native type the desired types that need nothing (C) or a check (I); the rest conflicts.
MATRIX = {
    "STRING": {"STRING": "C", "INTEGER": "I", "FLOAT": "I", "DATE": "I", "DATETIME": "I"},
    "INTEGER": {"STRING": "C", "INTEGER": "C", "FLOAT": "C", "DATE": "I", "DATETIME": "I"},
    "FLOAT": {"STRING": "C", "INTEGER": "I", "FLOAT": "C"},
    "BOOLEAN": {"BOOLEAN": "C"},
    "DATE": {"STRING": "C", "DATE": "C", "DATETIME": "C"},
    "DATETIME": {"STRING": "C", "DATE": "C", "DATETIME": "C"},
}


@dataclass(frozen=True)
class Compatibility:
    """kind: LENGTH, REGEX or DATE_FORMAT where a check is needed, with its parameters."""

    native: str | None
    desired: str
    verdict: str
    kind: str | None = None
    parameters: dict[str, Any] | None = None
    reason: str = ""


def _check(native: TypeInfo, desired: TypeInfo) -> tuple[str, dict[str, Any]] | None:
    """The check that this pair needs beyond its types, or None."""
    n, d = native.type, desired.type
    if d == "STRING" and desired.max_length is not None:
        if n == "STRING" and native.max_length is not None and native.max_length <= desired.max_length:
            return None
        return "LENGTH", {"validation_type": "string_length", "max_length": desired.max_length, "pattern": formats.at_most_characters(desired.max_length)}
    if d == "INTEGER" and n == "INTEGER" and desired.max_digits is not None:
        return "REGEX", {"validation_type": "integer_digits", "max_digits": desired.max_digits, "pattern": formats.integer_digits(desired.max_digits)}
    if d == "FLOAT" and desired.precision is not None and desired.scale is not None:
        if n == "FLOAT" or n == "STRING":
            return "REGEX", {"validation_type": "float_precision", "precision": desired.precision, "scale": desired.scale, "pattern": formats.float_digits(desired.precision, desired.scale)}
        if n == "INTEGER" and desired.precision > desired.scale:
            whole = desired.precision - desired.scale
            return "REGEX", {"validation_type": "integer_digits", "max_digits": whole, "pattern": formats.integer_digits(whole)}
    return None


def analyse(native: TypeInfo, desired: TypeInfo) -> Compatibility:
    cell = MATRIX.get(native.type or "", {}).get(desired.type or "", "X")
    if cell == "X":
        return Compatibility(native.type, desired.type, CONFLICTING, reason=f"{native.type} can't become {desired.type}")
    extra = _check(native, desired)
    if extra:
        return Compatibility(native.type, desired.type, INCOMPATIBLE, *extra, reason="the values' size has to be checked")
    if cell == "C":
        return Compatibility(native.type, desired.type, COMPATIBLE)
    if desired.type in ("DATE", "DATETIME"):
        fmt = desired.format or ("YYYYMMDD" if native.type == "INTEGER" else "YYYY-MM-DD")
        return Compatibility(native.type, desired.type, INCOMPATIBLE, "DATE_FORMAT", {"format_pattern": fmt}, "the values' format has to be checked")
    if native.type == "FLOAT":  # to INTEGER
        if desired.max_digits is not None:
            what = {"validation_type": "integer_digits", "max_digits": desired.max_digits, "pattern": rf"^-?[0-9]{{1,{desired.max_digits}}}\.0*$"}
        else:
            what = {"validation_type": "integer_like_float", "pattern": formats.integer_like_float()}
    elif desired.type == "INTEGER" and desired.max_digits is not None:  # from STRING
        what = {"validation_type": "integer_text", "max_digits": desired.max_digits, "pattern": formats.integer_digits(desired.max_digits)}
    else:  # STRING to INTEGER or FLOAT
        what = {"pattern": formats.basic_integer() if desired.type == "INTEGER" else formats.basic_float()}
    return Compatibility(native.type, desired.type, INCOMPATIBLE, "REGEX", what, "the values' form has to be checked")


def matrix_rows() -> list[tuple[str, str, str, str | None]]:
    """(native, desired, verdict, kind of check) for every pair of canonical types."""
    found = ((n, d, analyse(TypeInfo(n), TypeInfo(d))) for n in CANONICAL for d in CANONICAL)
    return [(n, d, c.verdict, c.kind) for n, d, c in found]


def desired_rule(table: str, column: str, native: TypeInfo, desired: str | dict[str, Any], database: str | None = None) -> Rule | None:
    """The rule that shows whether the column's values fit; None if they surely do. Raises if they surely don't."""
    want = parse_type(desired)
    found = analyse(native, want)
    if found.verdict == CONFLICTING:
        raise ContractError(f"{table}.{column}: {found.reason}", table=table, column=column)
    if found.verdict == COMPATIBLE:
        return None
    kind = {"LENGTH": "length", "REGEX": "regex", "DATE_FORMAT": "date"}[found.kind]
    rule_type = RuleType.DATE_FORMAT if found.kind == "DATE_FORMAT" else RuleType.REGEX
    return Rule(rule_type, Target(table, column, database), dict(found.parameters), name=f"desired_type_{kind}_{column}", description=f"values of {column} as {desired}")
