"""What is known of each rule type, and a place for further ones.

A registered type brings a builder of its violation Column, and optionally a parameter check; from then on rules of
it take part in fused scans, samples and reports like the built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T

from assaykit.errors import RuleError
from assaykit.functions.predicates import violation
from assaykit.model import Category, Rule, RuleType


@dataclass(frozen=True)
class RuleKind:
    name: str
    category: Category
    summary: str
    parameters: dict[str, dict[str, Any]] = field(default_factory=dict)
    predicate: Callable[[Rule, T.StructType], Column] | None = None
    executable: bool = True

    def json_schema(self) -> dict[str, Any]:
        """A JSON schema of the parameters."""
        required = [k for k, v in self.parameters.items() if v.get("required")]
        properties = {k: {n: x for n, x in v.items() if n != "required"} for k, v in self.parameters.items()}
        return {"type": "object", "properties": properties, **({"required": required} if required else {})}


class RuleRegistry:
    def __init__(self):
        self._kinds: dict[str, RuleKind] = {}

    def register(self, kind: RuleKind) -> RuleKind:
        if kind.name in self._kinds:
            raise RuleError(f"rule type {kind.name} is registered already")
        self._kinds[kind.name] = kind
        return kind

    def remove(self, name: str) -> None:
        self._kinds.pop(name, None)

    def get(self, name: str) -> RuleKind:
        if name not in self._kinds:
            raise RuleError(f"no rule type {name}; known: {', '.join(sorted(self._kinds))}")
        return self._kinds[name]

    def names(self, category: Category | None = None) -> list[str]:
        return sorted(k.name for k in self._kinds.values() if category in (None, k.category))

    def predicate(self, rule: Rule, schema: T.StructType) -> Column:
        """The rule's violation; a rule's parameter ``kind`` names a registered type that takes its place."""
        kind = self.get(rule.parameters.get("kind") or str(rule.type))
        if not kind.executable:
            raise RuleError(f"{kind.name} rules can't be carried out")
        return (kind.predicate or violation)(rule, schema)


_FILTER = {"filter_condition": {"type": "string", "description": "SQL predicate; only rows where it is true count"}}


def builtin() -> RuleRegistry:
    registry = RuleRegistry()
    number, text, whole = {"type": "number"}, {"type": "string"}, {"type": "integer", "minimum": 0}
    for name, category, summary, parameters in (
        (RuleType.NOT_NULL, Category.COMPLETENESS, "values are not null", {}),
        (RuleType.UNIQUE, Category.UNIQUENESS, "values that are not null occur once", {}),
        (RuleType.RANGE, Category.VALIDITY, "values are within bounds, which belong to them", {"min": number, "max": number}),
        (RuleType.LENGTH, Category.VALIDITY, "texts have a number of characters", {"min_length": whole, "max_length": whole, "exact_length": whole}),
        (RuleType.ENUM, Category.VALIDITY, "values are listed", {"allowed_values": {"type": "array", "minItems": 1, "required": True}, "extract_domain": {"type": "boolean"}}),
        (RuleType.REGEX, Category.VALIDITY, "texts match a pattern somewhere", {"pattern": text | {"required": True}}),
        (RuleType.DATE_FORMAT, Category.VALIDITY, "texts are dates or times in a format", {"format_pattern": text | {"required": True}}),
        (RuleType.SCHEMA, Category.VALIDITY, "the table has columns of given types", {"columns": {"type": "object", "required": True}, "strict_mode": {"type": "boolean"}, "case_insensitive": {"type": "boolean"}}),
    ):
        registry.register(RuleKind(str(name), category, summary, parameters | (_FILTER if name != RuleType.SCHEMA else {})))
    registry.register(RuleKind("CUSTOM_SQL", Category.CUSTOM, "known by name only", {"sql": text | {"required": True}}, executable=False))
    return registry


REGISTRY = builtin()
