"""One plan for many rules: the fused scan of row predicates, and one grouping for each UNIQUE column.

All row rules of a table, with whatever filters, are expressions of a single aggregation, so the table is scanned
once and one row leaves each task. A filter that all of them share goes below the aggregation, where the scan can
use it; different ones are part of each expression. UNIQUE rules group by their column: equal values are counted
before the shuffle, and no Expand multiplies the rows as several distinct counts in one aggregation would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.functions.formats import date_shape
from assaykit.functions.predicates import quoted
from assaykit.model import Rule, RuleType
from assaykit.plans.registry import REGISTRY, RuleRegistry

COUNTS = "rule string, total_records long, failed_records long, status string"


def _filtered(df: DataFrame, rule: Rule) -> DataFrame:
    return df.where(F.expr(rule.filter)) if rule.filter else df


def _used(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Only the columns that the rules name, if none of them has a filter that may name others."""
    if any(r.filter for r in rules):
        return df
    return df.select(*[quoted(c) for c in dict.fromkeys(r.column for r in rules)])


def fused_row(df: DataFrame, rules: list[Rule], registry: RuleRegistry = REGISTRY) -> DataFrame:
    """One row: for the i-th rule total_i and failed_i. Rules are row predicates."""
    shared = {r.filter for r in rules}
    if len(shared) == 1 and None not in shared:
        df, folded = _filtered(df, rules[0]), False
    else:
        folded = True
    expressions = []
    for i, rule in enumerate(rules):
        bad = registry.predicate(rule, df.schema)
        if folded and rule.filter:
            keep = F.expr(rule.filter)
            expressions += [F.count_if(keep).alias(f"total_{i}"), F.count_if(keep & bad).alias(f"failed_{i}")]
        else:
            expressions += [F.count(F.lit(1)).alias(f"total_{i}"), F.count_if(bad).alias(f"failed_{i}")]
    return (_used(df, rules) if folded else df).agg(*expressions)


def unique_row(df: DataFrame, rule: Rule) -> DataFrame:
    """One row: total_0, failed_0 (copies beyond the first of each value that isn't null) and groups_0 (values with copies)."""
    groups = _filtered(df, rule).groupBy(quoted(rule.column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    again = F.col("value").isNotNull() & (F.col("n") > 1)
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_0"),
        F.coalesce(F.sum(F.when(again, F.col("n") - 1)), F.lit(0)).alias("failed_0"),
        F.count_if(again).alias("groups_0"),
    )


def unique_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of unique_row() of several rules with their places k, in one plan: their groupings run side by side."""
    out = None
    for k, rule in enumerate(rules):
        one = unique_row(df, rule).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def _as_rows(row: DataFrame, rules: list[Rule]) -> DataFrame:
    items = [F.struct(F.lit(r.name).alias("rule"), F.col(f"total_{i}").cast("long").alias("total_records"), F.col(f"failed_{i}").cast("long").alias("failed_records")) for i, r in enumerate(rules)]
    status = F.when(F.col("failed_records") == 0, F.lit("PASSED")).otherwise(F.lit("FAILED"))
    return row.select(F.inline(F.array(*items))).withColumn("status", status)


def rule_counts(df: DataFrame, rules: list[Rule], registry: RuleRegistry = REGISTRY) -> DataFrame:
    """Rows of COUNTS, lazily: a row for each rule."""
    merged = [r for r in rules if r.type.merges]
    parts = [_as_rows(fused_row(df, merged, registry), merged)] if merged else []
    parts += [_as_rows(unique_row(df, r), [r]) for r in rules if r.type == RuleType.UNIQUE]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def violations(df: DataFrame, rule: Rule, registry: RuleRegistry = REGISTRY) -> DataFrame:
    """The rows that break a row rule: the very predicate that is counted, and its filter."""
    return _filtered(df, rule).where(F.coalesce(registry.predicate(rule, df.schema), F.lit(False)))


def duplicates(df: DataFrame, rule: Rule) -> DataFrame:
    """(value, duplicate_count) of the values that occur more than once, in order of the value."""
    groups = _filtered(df, rule).where(quoted(rule.column).isNotNull()).groupBy(quoted(rule.column).alias("value")).agg(F.count(F.lit(1)).alias("duplicate_count"))
    return groups.where("duplicate_count > 1").orderBy("value")


def samples(df: DataFrame, rule: Rule, rows: int, order_by: list[str] | None = None, registry: RuleRegistry = REGISTRY) -> DataFrame:
    """A few violating rows; without order_by any of them, so that the scan may stop early. Of UNIQUE, twice as many values."""
    if rule.type == RuleType.UNIQUE:
        return duplicates(df, rule).limit(2 * rows)
    if rule.type == RuleType.DATE_FORMAT:
        return date_failure_samples(df, rule, rows, order_by, registry)
    found = violations(df, rule, registry)
    return (found.orderBy(*[quoted(c) for c in order_by]) if order_by else found).limit(rows)


def date_failure_samples(df: DataFrame, rule: Rule, rows: int, order_by: list[str] | None = None, registry: RuleRegistry = REGISTRY) -> DataFrame:
    """Of a DATE_FORMAT rule's failures some that don't look like the format and some that do but are no date, by turns.

    Where one kind has too few the other fills up.
    """
    found, shaped = violations(df, rule, registry), quoted(rule.column).cast("string").rlike(date_shape(rule.pattern))
    place, kind = (next(n for n in (f"{'_' * i}{name}" for i in range(len(df.columns) + 1)) if n not in df.columns) for name in ("place", "kind"))
    parts = []
    for k, some in enumerate((found.where(~shaped), found.where(shaped))):
        some = (some.orderBy(*[quoted(c) for c in order_by]) if order_by else some).limit(rows)
        parts.append(some.withColumns({place: F.monotonically_increasing_id(), kind: F.lit(k)}))  # a limit leaves one partition
    return parts[0].unionByName(parts[1]).orderBy(place, kind).limit(rows).drop(place, kind)
