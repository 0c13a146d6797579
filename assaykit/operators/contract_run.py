"""Runs a contract: schemas first, without a job; then all row rules and desired-type checks of a table in one scan."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assaykit.model import Report, Result, Rule, Settings
from assaykit.operators.engine import validate
from assaykit.plans.compat import desired_rule
from assaykit.plans.contract import Contract, decompose, skip_map
from assaykit.plans.types import from_spark


def _field(schema: T.StructType, name: str, ignore_case: bool) -> T.StructField | None:
    same = (lambda a: a.lower() == name.lower()) if ignore_case else (lambda a: a == name)
    return next((f for f in schema.fields if same(f.name)), None)


def _renamed(rule: Rule, tables: Mapping[str, DataFrame], ignore_case: bool) -> Rule:
    """The rule on the column as the table spells it, if case doesn't matter."""
    df = tables.get(rule.table)
    found = _field(df.schema, rule.column, ignore_case) if df is not None and rule.column else None
    if found is None or found.name == rule.column:
        return rule
    target = type(rule.target)(rule.table, found.name, rule.target.database)
    return Rule(rule.type, target, rule.parameters, rule.name, rule.id, rule.severity, rule.action, rule.threshold, rule.is_active, rule.description)


def run_contract(tables: Mapping[str, DataFrame], contract: Contract, *, settings: Settings = Settings(), order_by: list[str] | None = None) -> Report:  # noqa: B008
    """Results of SCHEMA rules, then of row rules, then of desired types; a conflicting desired type raises.

    Desired types belong to a table's field, whatever other tables call theirs, and are looked at wherever the column
    exists. Rules on what is missing are SKIPPED with a reason.
    """
    began = time.perf_counter()
    schema_rules, row_rules, desired = decompose(contract)
    ignoring = {t.name: t.case_insensitive for t in contract.tables}
    schemas = validate(tables, schema_rules, settings=settings)
    wanted = []
    for (table, name), kind in desired.items():
        df = tables.get(table)
        found = _field(df.schema, name, ignoring[table]) if df is not None else None
        if found is not None:
            rule = desired_rule(table, name, from_spark(found), kind)
            wanted += [rule] if rule else []
    rules = row_rules + wanted
    skipped = skip_map(schemas, rules)
    for r in rules:  # a table or field that no SCHEMA rule declares
        df = tables.get(r.table)
        if r.id not in skipped and df is None:
            skipped[r.id] = "TABLE_NOT_EXISTS"
        elif r.id not in skipped and _field(df.schema, r.column, ignoring[r.table]) is None:
            skipped[r.id] = "FIELD_MISSING"
    done = validate(tables, [_renamed(r, tables, ignoring[r.table]) for r in rules if r.id not in skipped], settings=settings, order_by=order_by)
    by_id = {r.rule.id: r for r in done}
    rest = []
    for r in rules:
        result = Result.skipped(r, skipped[r.id]) if r.id in skipped else by_id[r.id]
        result.rule = r  # with the field's name as the contract spells it
        rest.append(result)
    return Report([*schemas, *rest], time.perf_counter() - began)
