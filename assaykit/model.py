"""Rules, results and reports: plain objects on the driver; rows of data never pass through them but as samples."""

from __future__ import annotations

import json
import math
import re
import uuid
from dataclasses import asdict, dataclass, field
from enum import StrEnum
from typing import Any

from assaykit.errors import RuleError


class RuleType(StrEnum):
    NOT_NULL = "NOT_NULL"
    UNIQUE = "UNIQUE"
    RANGE = "RANGE"
    LENGTH = "LENGTH"
    ENUM = "ENUM"
    REGEX = "REGEX"
    DATE_FORMAT = "DATE_FORMAT"
    SCHEMA = "SCHEMA"

    @property
    def merges(self) -> bool:
        """Whether the rule is a predicate on a row, so that it joins a table's one scan."""
        return self not in (RuleType.UNIQUE, RuleType.SCHEMA)


class Status(StrEnum):
    PENDING = "PENDING"
    RUNNING = "RUNNING"
    PASSED = "PASSED"
    FAILED = "FAILED"
    WARNING = "WARNING"
    ERROR = "ERROR"
    CANCELLED = "CANCELLED"
    SKIPPED = "SKIPPED"

    def may_become(self, other: Status) -> bool:
        return other in _TRANSITIONS.get(self, ())

    @property
    def final(self) -> bool:
        return self not in _TRANSITIONS


_TRANSITIONS = {
    Status.PENDING: (Status.RUNNING, Status.CANCELLED, Status.SKIPPED, Status.ERROR),
    Status.RUNNING: (Status.PASSED, Status.FAILED, Status.WARNING, Status.ERROR, Status.CANCELLED),
}


class Severity(StrEnum):
    LOW = "LOW"
    MEDIUM = "MEDIUM"
    HIGH = "HIGH"
    CRITICAL = "CRITICAL"

    @property
    def priority(self) -> int:
        return list(Severity).index(self) + 1

    @classmethod
    def of(cls, value: Any) -> Severity:
        """MEDIUM for what isn't a severity."""
        try:
            return cls(str(value).upper())
        except ValueError:
            return cls.MEDIUM


class Action(StrEnum):
    LOG = "LOG"
    ALERT = "ALERT"
    BLOCK = "BLOCK"
    QUARANTINE = "QUARANTINE"
    CORRECT = "CORRECT"
    IGNORE = "IGNORE"


class Category(StrEnum):
    COMPLETENESS = "COMPLETENESS"
    ACCURACY = "ACCURACY"
    CONSISTENCY = "CONSISTENCY"
    VALIDITY = "VALIDITY"
    UNIQUENESS = "UNIQUENESS"
    TIMELINESS = "TIMELINESS"
    CUSTOM = "CUSTOM"


class SourceKind(StrEnum):
    SQLITE = "sqlite"
    MYSQL = "mysql"
    POSTGRESQL = "postgresql"
    ORACLE = "oracle"
    MSSQL = "mssql"
    CSV = "csv"
    PARQUET = "parquet"
    JSON = "json"
    EXCEL = "excel"
    HIVE = "hive"
    SPARK = "spark"
    HDFS = "hdfs"


CATEGORY_OF = {
    RuleType.NOT_NULL: Category.COMPLETENESS,
    RuleType.LENGTH: Category.VALIDITY,
    RuleType.UNIQUE: Category.UNIQUENESS,
    RuleType.RANGE: Category.VALIDITY,
    RuleType.ENUM: Category.VALIDITY,
    RuleType.REGEX: Category.VALIDITY,
    RuleType.DATE_FORMAT: Category.VALIDITY,
    RuleType.SCHEMA: Category.VALIDITY,
}

#: What messages call the failing rows of a type.
_FOUND = {
    RuleType.NOT_NULL: "null records",
    RuleType.UNIQUE: "duplicate records",
    RuleType.LENGTH: "length mismatch records",
    RuleType.RANGE: "out-of-range records",
    RuleType.ENUM: "illegal enum value records",
    RuleType.REGEX: "format mismatch records",
    RuleType.DATE_FORMAT: "date format anomaly records",
}


@dataclass(frozen=True)
class Target:
    table: str
    column: str | None = None
    database: str | None = None

    @classmethod
    def parse(cls, text: str) -> Target:
        """``table.column`` or ``database.table.column``."""
        parts = text.split(".")
        if len(parts) not in (2, 3) or not all(parts):
            raise RuleError(f"not a target: {text!r}; expected [database.]table.column")
        return cls(parts[-2], parts[-1], parts[0] if len(parts) == 3 else None)

    def __str__(self) -> str:
        return ".".join(p for p in (self.database, self.table, self.column) if p)


@dataclass(frozen=True)
class Rule:
    """One rule on a table. Parameters are checked when it is made; see validate_parameters()."""

    type: RuleType
    target: Target
    parameters: dict[str, Any] = field(default_factory=dict)
    name: str = ""
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    severity: Severity = Severity.MEDIUM
    action: Action = Action.ALERT
    threshold: float = 0.0
    is_active: bool = True
    description: str = ""

    def __post_init__(self):
        object.__setattr__(self, "type", RuleType(self.type))
        if not self.name:
            object.__setattr__(self, "name", f"{self.type.lower()}_{self.target.column or self.target.table}")
        validate_parameters(self)

    @property
    def column(self) -> str | None:
        return self.target.column

    @property
    def table(self) -> str:
        return self.target.table

    @property
    def filter(self) -> str | None:
        return self.parameters.get("filter_condition") or None

    @property
    def category(self) -> Category:
        return CATEGORY_OF[self.type]

    def bound(self, end: str) -> float | None:
        """The lower ("min") or upper ("max") bound; 0 is a bound."""
        for key in (end, f"{end}_value"):
            if self.parameters.get(key) is not None:
                return self.parameters[key]
        return None

    @property
    def pattern(self) -> str | None:
        return self.parameters.get("format_pattern") or self.parameters.get("format") if self.type == RuleType.DATE_FORMAT else self.parameters.get("pattern")

    def to_dict(self) -> dict[str, Any]:
        return {
            "id": self.id,
            "name": self.name,
            "type": str(self.type),
            "target": {"database": self.target.database, "table": self.target.table, "column": self.target.column},
            "parameters": dict(self.parameters),
            "severity": str(self.severity),
            "action": str(self.action),
            "threshold": self.threshold,
            "is_active": self.is_active,
            "description": self.description,
            "category": str(self.category),
        }

    def message(self, failed: int) -> str:
        if self.type == RuleType.SCHEMA:
            return "SCHEMA check passed" if not failed else f"SCHEMA check completed, found {failed} column problems"
        return f"{self.type} check passed" if not failed else f"{self.type} check completed, found {failed} {_FOUND[self.type]}"


def _number(rule: Rule, value: Any, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or math.isnan(value):
        raise RuleError(f"{rule.type} needs a number as {what}, not {value!r}", rule=rule.name)
    return value


def _whole(rule: Rule, value: Any, what: str, low: int = 0, high: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < low or (high is not None and value > high):
        raise RuleError(f"{what} must be a whole number of at least {low}" + (f" and at most {high}" if high else "") + f", not {value!r}", rule=rule.name)
    return value


def validate_parameters(rule: Rule) -> None:
    """Raises RuleError for a rule that could not be carried out as written."""
    p = rule.parameters
    if rule.type != RuleType.SCHEMA and not rule.column:
        raise RuleError(f"{rule.type} needs a column", rule=rule.name)
    if rule.type == RuleType.RANGE:
        low, high = rule.bound("min"), rule.bound("max")
        if low is None and high is None:
            raise RuleError("RANGE needs min or max", rule=rule.name)
        given = [_number(rule, v, n) for v, n in ((low, "min"), (high, "max")) if v is not None]
        if len(given) == 2 and given[0] > given[1]:
            raise RuleError(f"RANGE has min {low} above max {high}", rule=rule.name)
    elif rule.type == RuleType.LENGTH:
        given = [k for k in ("min_length", "max_length", "exact_length") if p.get(k) is not None]
        if not given:
            raise RuleError("LENGTH needs min_length, max_length or exact_length", rule=rule.name)
        for k in given:
            _whole(rule, p[k], k)
        if {"min_length", "max_length"} <= set(given) and p["min_length"] > p["max_length"]:
            raise RuleError("LENGTH has min_length above max_length", rule=rule.name)
    elif rule.type == RuleType.ENUM:
        if not isinstance(p.get("allowed_values"), (list, tuple)) or not p["allowed_values"]:
            raise RuleError("ENUM needs a list of allowed_values", rule=rule.name)
    elif rule.type == RuleType.REGEX:
        if not p.get("validation_type"):
            if not isinstance(p.get("pattern"), str) or not p["pattern"]:
                raise RuleError("REGEX needs a pattern", rule=rule.name)
            try:
                re.compile(p["pattern"])
            except re.error as e:
                raise RuleError(f"REGEX has an invalid pattern {p['pattern']!r}: {e}", rule=rule.name) from e
    elif rule.type == RuleType.DATE_FORMAT:
        if not isinstance(rule.pattern, str) or not rule.pattern:
            raise RuleError("DATE_FORMAT needs a format_pattern", rule=rule.name)
    elif rule.type == RuleType.SCHEMA:
        from assaykit.plans.types import CANONICAL

        columns = p.get("columns")
        if not isinstance(columns, dict) or not columns:
            raise RuleError("SCHEMA needs columns", rule=rule.name)
        for column, want in columns.items():
            kind = str(want.get("expected_type", "")).upper()
            if kind not in CANONICAL:
                raise RuleError(f"SCHEMA has an unknown expected_type {want.get('expected_type')!r} for {column}", rule=rule.name)
            if want.get("max_length") is not None:
                if kind != "STRING":
                    raise RuleError(f"max_length is for STRING only: {column}", rule=rule.name)
                _whole(rule, want["max_length"], "max_length", 1, 1_000_000)
            for k, low, high in (("precision", 1, 65), ("scale", 0, 30)):
                if want.get(k) is not None:
                    if kind != "FLOAT":
                        raise RuleError(f"{k} is for FLOAT only: {column}", rule=rule.name)
                    _whole(rule, want[k], k, low, high)
            if want.get("precision") is not None and want.get("scale") is not None and want["scale"] > want["precision"]:
                raise RuleError(f"scale is above precision: {column}", rule=rule.name)


@dataclass
class Result:
    """What one rule found. SKIPPED results carry a skip_reason, ERROR results an error_message."""

    rule: Rule
    status: Status
    total_records: int = 0
    failed_records: int = 0
    message: str = ""
    error_message: str | None = None
    sample_data: list[dict[str, Any]] | None = None
    execution_time: float = 0.0
    skip_reason: str | None = None
    details: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def counted(cls, rule: Rule, total: int, failed: int, **more: Any) -> Result:
        return cls(rule, Status.FAILED if failed else Status.PASSED, total, failed, rule.message(failed), **more)

    @classmethod
    def error(cls, rule: Rule, why: str) -> Result:
        return cls(rule, Status.ERROR, message=why, error_message=why)

    @classmethod
    def skipped(cls, rule: Rule, reason: str) -> Result:
        return cls(rule, Status.SKIPPED, message=f"skipped: {reason}", skip_reason=reason)

    @property
    def success_rate(self) -> float:
        """1 for an empty table."""
        return 1.0 if not self.total_records else (self.total_records - self.failed_records) / self.total_records

    @property
    def error_rate(self) -> float:
        return 0.0 if not self.total_records else self.failed_records / self.total_records

    def summary(self) -> str:
        return f"{self.rule.name}: {self.status}, {self.failed_records} of {self.total_records} records failed"

    def to_dict(self) -> dict[str, Any]:
        return {
            "rule_id": self.rule.id,
            "rule_name": self.rule.name,
            "rule_type": str(self.rule.type),
            "table": self.rule.table,
            "column": self.rule.column,
            "status": str(self.status),
            "total_records": self.total_records,
            "failed_records": self.failed_records,
            "execution_time": self.execution_time,
            "message": self.message,
            "error_message": self.error_message,
            "sample_data": self.sample_data,
            "skip_reason": self.skip_reason,
            "dataset_metrics": [{"entity_name": self.rule.table, "total_records": self.total_records, "failed_records": self.failed_records, "processing_time": self.execution_time}],
            "execution_plan": self.details or None,
        }


RESULT_SCHEMA = (
    "rule_id string, rule_name string, rule_type string, `table` string, `column` string, status string, total_records long, "
    "failed_records long, message string, error_message string, skip_reason string, sample_data array<string>"
)


@dataclass
class Report:
    results: list[Result]
    seconds: float = 0.0

    def __iter__(self):
        return iter(self.results)

    def __len__(self):
        return len(self.results)

    def __getitem__(self, key: str) -> Result:
        """By the rule's id or name."""
        for r in self.results:
            if key in (r.rule.id, r.rule.name):
                return r
        raise KeyError(key)

    def of_status(self, *status: Status) -> list[Result]:
        return [r for r in self.results if r.status in status]

    @property
    def passed(self) -> bool:
        return not self.of_status(Status.FAILED, Status.ERROR)

    def to_df(self, spark):
        rows = []
        for r in self.results:
            d = r.to_dict()
            samples = None if d["sample_data"] is None else [json.dumps(s, default=str, ensure_ascii=False) for s in d["sample_data"]]
            rows.append(tuple(samples if k == "sample_data" else d[k] for k in (c.split()[0].strip("`") for c in RESULT_SCHEMA.split(", "))))
        return spark.createDataFrame(rows, RESULT_SCHEMA)

    def to_dicts(self) -> list[dict[str, Any]]:
        return [r.to_dict() for r in self.results]


@dataclass(frozen=True)
class Settings:
    """What a run may be told. Only what is read somewhere is here."""

    sample_data: bool = True
    sample_rows: int = 5
    #: Expressions in one aggregation; a table with more rules is scanned again for the rest.
    most_expressions: int = 400

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)
