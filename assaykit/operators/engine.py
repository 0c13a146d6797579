"""Carries out rules on tables: prevalidation, one fused scan per table, UNIQUE groupings, samples of what failed."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.errors import AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, PySparkException, SparkRuntimeException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.errors import AssayError, EngineError
from assaykit.model import Report, Result, Rule, RuleType, Settings, Status
from assaykit.operators.schema_check import run_schema_rule
from assaykit.plans.fusion import fused_row, samples, unique_rows
from assaykit.plans.registry import REGISTRY, RuleRegistry

Tables = DataFrame | Mapping[str, DataFrame]


def _table(tables: Tables, name: str) -> DataFrame | None:
    return tables if isinstance(tables, DataFrame) else tables.get(name)


def prevalidate(tables: Tables, rules: list[Rule]) -> dict[str, str]:
    """Why rules can't run, by their ids: the table or the column is missing (names are case-sensitive). No job is run."""
    columns: dict[str, set[str]] = {}
    found = {}
    for rule in rules:
        df = _table(tables, rule.table)
        if rule.type == RuleType.SCHEMA:
            continue
        if df is None:
            found[rule.id] = f"table {rule.table} not found"
        elif rule.column not in columns.setdefault(rule.table, set(df.columns)):
            found[rule.id] = f"column {rule.column} not found in table {rule.table}"
    return found


#: What a rule may be the cause of: a query that can't be analysed, a value that an expression can't take.
FAULTS = (AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, SparkRuntimeException)


def _is_fault(e: Exception) -> bool:
    """Whether a rule is to blame, not the cluster: then the other rules can do without it."""
    return isinstance(e, (*FAULTS, AssayError))


def _count(df: DataFrame, rules: list[Rule], registry: RuleRegistry) -> list[Result]:
    """Counts of row rules in one scan; if a rule can't be carried out, halves of them are tried, down to single ones."""
    began = time.perf_counter()
    try:
        row = fused_row(df, rules, registry).first()
    except (PySparkException, AssayError) as e:
        if not _is_fault(e):
            raise
        if len(rules) == 1:
            return [Result.error(rules[0], str(e).splitlines()[0])]
        half = len(rules) // 2
        return _count(df, rules[:half], registry) + _count(df, rules[half:], registry)
    took = time.perf_counter() - began
    return [Result.counted(r, row[f"total_{i}"], row[f"failed_{i}"], execution_time=took, details={"fused_rules": len(rules)}) for i, r in enumerate(rules)]


def _count_unique(df: DataFrame, rules: list[Rule]) -> list[Result]:
    """Counts of UNIQUE rules in one job; halves of them are tried if one can't be carried out."""
    if not rules:
        return []
    began = time.perf_counter()
    try:
        rows = {row["k"]: row for row in unique_rows(df, rules).collect()}
    except PySparkException as e:
        if not _is_fault(e):
            raise
        if len(rules) == 1:
            return [Result.error(rules[0], str(e).splitlines()[0])]
        half = len(rules) // 2
        return _count_unique(df, rules[:half]) + _count_unique(df, rules[half:])
    took = time.perf_counter() - began
    return [Result.counted(r, rows[k]["total_0"], rows[k]["failed_0"], execution_time=took, details={"duplicate_values": rows[k]["groups_0"]}) for k, r in enumerate(rules)]


def _sample(df: DataFrame, failed: list[Result], settings: Settings, order_by: list[str] | None, registry: RuleRegistry) -> None:
    """Samples of all failed rules of a table in one job: a limited branch for each, stacked as JSON."""
    parts = []
    for k, r in enumerate(failed):
        some = samples(df, r.rule, settings.sample_rows, order_by, registry)
        parts.append(some.select(F.lit(k).alias("k"), F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in some.columns]), {"ignoreNullFields": "false"}).alias("row")))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    import json

    for r in failed:
        r.sample_data = []
    for row in stacked.collect():
        failed[row["k"]].sample_data.append(json.loads(row["row"]))


def validate(
    tables: Tables,
    rules: list[Rule],
    *,
    settings: Settings = Settings(),  # noqa: B008  it is frozen
    order_by: list[str] | None = None,
    registry: RuleRegistry = REGISTRY,
) -> Report:
    """A result for each active rule, in their order. tables: by name, or one DataFrame that all rules are meant for.

    order_by makes samples repeatable; without it they are any violating rows.
    """
    began = time.perf_counter()
    rules = [r for r in rules if r.is_active]
    if len({r.id for r in rules}) < len(rules):
        raise EngineError("two rules have the same id")
    results: dict[str, Result] = {}
    missing = prevalidate(tables, rules)
    by_table: dict[str, list[Rule]] = {}
    for rule in rules:
        if rule.id in missing:
            results[rule.id] = Result.error(rule, missing[rule.id])
        elif rule.type == RuleType.SCHEMA:
            df = _table(tables, rule.table)
            results[rule.id] = run_schema_rule(rule, None if df is None else df.schema)
        else:
            by_table.setdefault(rule.table, []).append(rule)
    for name, own in by_table.items():
        df = _table(tables, name)
        merged = [r for r in own if r.type.merges]
        step = max(1, settings.most_expressions // 2)
        found = [x for i in range(0, len(merged), step) for x in _count(df, merged[i : i + step], registry)]
        found += _count_unique(df, [r for r in own if not r.type.merges])
        failed = [r for r in found if r.status == Status.FAILED]
        if failed and settings.sample_data and settings.sample_rows > 0:
            _sample(df, failed, settings, order_by, registry)
        results |= {r.rule.id: r for r in found}
    return Report([results[r.id] for r in rules], time.perf_counter() - began)


def quarantine(df: DataFrame, rules: list[Rule], registry: RuleRegistry = REGISTRY) -> tuple[DataFrame, DataFrame]:
    """(rows that break no row rule, rows that break any with ``broken_rules``), by the predicates that are counted."""
    broken = []
    for r in (r for r in rules if r.type.merges):
        bad = registry.predicate(r, df.schema)
        broken.append(F.when(F.coalesce(F.expr(r.filter) & bad if r.filter else bad, F.lit(False)), F.lit(r.name)))
    marked = df.withColumn("broken_rules", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))
    return marked.where(F.size("broken_rules") == 0).drop("broken_rules"), marked.where(F.size("broken_rules") > 0)
