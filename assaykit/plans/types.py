"""The six canonical types, Spark's and vendors' types in their terms, and the mini-language of desired types."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from assaykit.errors import RuleError

CANONICAL = ("STRING", "INTEGER", "FLOAT", "BOOLEAN", "DATE", "DATETIME")

#: vendors' base types.
VENDOR = {
    "STRING": "CHAR CHARACTER NCHAR NVARCHAR VARCHAR VARCHAR2 TEXT CLOB STRING",
    "INTEGER": "INT INTEGER BIGINT SMALLINT MEDIUMINT TINYINT",
    "FLOAT": "FLOAT DOUBLE REAL DECIMAL NUMERIC",
    "BOOLEAN": "BOOLEAN BOOL BIT",
    "DATE": "DATE",
    "DATETIME": "DATETIME DATETIME2",
}
_BASE = {name: kind for kind, names in VENDOR.items() for name in names.split()}

#: Names of the mini-language.
ALIASES = {"string": "STRING", "str": "STRING", "integer": "INTEGER", "int": "INTEGER", "float": "FLOAT", "boolean": "BOOLEAN", "bool": "BOOLEAN", "date": "DATE", "datetime": "DATETIME"}


@dataclass(frozen=True)
class TypeInfo:
    """type is None for what none of the canonical types covers."""

    type: str | None
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    max_digits: int | None = None
    format: str | None = None

    def to_dict(self) -> dict[str, Any]:
        return {k: v for k, v in self.__dict__.items() if v is not None}


def from_vendor(text: str) -> TypeInfo:
    """varchar(20), DECIMAL(10,2), TIMESTAMP WITH TIME ZONE, … as a canonical type with its metadata."""
    m = re.match(r"\s*([A-Z_]+\d?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", text.upper())
    if not m:
        return TypeInfo(None)
    base, first, second = m[1], m[2] and int(m[2]), m[3] and int(m[3])
    kind = "DATETIME" if base.startswith("TIMESTAMP") else _BASE.get(base)
    if kind == "STRING":
        return TypeInfo(kind, max_length=first)
    if kind == "FLOAT":
        return TypeInfo(kind, precision=first, scale=second)
    return TypeInfo(kind)


def from_spark(field: T.StructField) -> TypeInfo:
    kind = field.dataType
    if isinstance(kind, (T.CharType, T.VarcharType)):
        return TypeInfo("STRING", max_length=kind.length)
    if isinstance(kind, T.StringType):
        raw = (field.metadata or {}).get("__CHAR_VARCHAR_TYPE_STRING")
        return from_vendor(raw) if raw else TypeInfo("STRING")
    if isinstance(kind, T.IntegralType):
        return TypeInfo("INTEGER")
    if isinstance(kind, T.DecimalType):
        return TypeInfo("FLOAT", precision=kind.precision, scale=kind.scale)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return TypeInfo("FLOAT")
    if isinstance(kind, T.BooleanType):
        return TypeInfo("BOOLEAN")
    if isinstance(kind, T.DateType):
        return TypeInfo("DATE")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return TypeInfo("DATETIME")
    return TypeInfo(None)


#: What a name may be followed by: whole numbers, or one quoted text.
_CALL = re.compile(r"""(\w+)\s*(?:\((.*)\))?""", re.DOTALL)
_NUMBER = re.compile(r"-?\d+")
_QUOTED = re.compile(r"""(['"])((?:(?!\1).)*)\1""", re.DOTALL)
#: For each type the metadata that its arguments are.
_ARGUMENTS = {"STRING": ("max_length",), "INTEGER": ("max_digits",), "FLOAT": ("precision", "scale"), "DATE": ("format",), "DATETIME": ("format",)}


def _argument(text: str) -> int | str | None:
    text = text.strip()
    if _NUMBER.fullmatch(text):
        return int(text)
    m = _QUOTED.fullmatch(text)
    return m[2] if m else None


def _parse_call(text: str) -> TypeInfo | None:
    """``name`` or ``name(arguments)``; None for anything else."""
    m = _CALL.fullmatch(text)
    kind = ALIASES.get(m[1].lower()) if m else None
    if kind is None or m[2] is None:
        return TypeInfo(kind) if kind else None
    keys = _ARGUMENTS.get(kind, ())
    values = [_argument(v) for v in ([m[2]] if keys == ("format",) else m[2].split(","))]
    wanted = str if keys == ("format",) else int
    if len(values) != len(keys) or not all(isinstance(v, wanted) for v in values):
        return None
    return TypeInfo(kind, **dict(zip(keys, values, strict=True)))


def parse_type(given: str | dict[str, Any]) -> TypeInfo:
    """``string(20)``, ``integer(4)``, ``float(5,2)``, ``date('YYYY-MM-DD')``, a bare name, or a dict with those keys."""
    if isinstance(given, dict):
        name = str(given.get("type", "")).strip().lower()
        if name not in ALIASES:
            raise RuleError(f"unknown type {given.get('type')!r}")
        known = {k: given[k] for k in ("max_length", "precision", "scale", "max_digits", "format") if given.get(k) is not None}
        info = TypeInfo(ALIASES[name], **known)
    elif isinstance(given, str):
        info = _parse_call(given.strip())
        if info is None:
            raise RuleError(f"unknown type {given!r}")
    else:
        raise RuleError(f"a type is a text or a dict, not {given!r}")
    return _consistent(info, given)


def _consistent(info: TypeInfo, given: Any) -> TypeInfo:
    def need(ok: bool, what: str) -> None:
        if not ok:
            raise RuleError(f"{what}: {given!r}")

    for key, kinds in (("max_length", ("STRING",)), ("max_digits", ("INTEGER",)), ("precision", ("FLOAT",)), ("scale", ("FLOAT",)), ("format", ("DATE", "DATETIME"))):
        need(getattr(info, key) is None or info.type in kinds, f"{key} doesn't go with {info.type}")
    need(info.max_length is None or (isinstance(info.max_length, int) and info.max_length > 0), "the length must be positive")
    need(info.max_digits is None or (isinstance(info.max_digits, int) and info.max_digits > 0), "the digits must be positive")
    need(info.precision is None or (isinstance(info.precision, int) and info.precision > 0), "the precision must be positive")
    need(info.scale is None or (isinstance(info.scale, int) and info.scale >= 0), "the scale must not be negative")
    need(info.scale is None or info.precision is None or info.scale <= info.precision, "the scale is above the precision")
    need(info.format is None or bool(info.format), "the format is empty")
    return info


def detailed(given: str | dict[str, Any]) -> dict[str, Any]:
    """The dict form of a type."""
    info = parse_type(given).to_dict()
    return {"type": info.pop("type").lower(), **info}


def desired_metadata(given: str | dict[str, Any]) -> dict[str, Any]:
    """The dict form with each key prefixed by ``desired_``."""
    return {f"desired_{k}": v for k, v in parse_type(given).to_dict().items()}
