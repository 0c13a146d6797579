"""Row rules on data in motion: counts observed while a table is written, per micro-batch, or per time window.

These go beyond batch validation; they use the predicates of the batch engine, so counts mean the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from assaykit.model import Report, Result, Rule
from assaykit.operators.engine import quarantine, validate
from assaykit.plans.registry import REGISTRY


def _expressions(df: DataFrame, rules: list[Rule]) -> list:
    out = []
    for i, r in enumerate(rules):
        bad, keep = REGISTRY.predicate(r, df.schema), F.expr(r.filter) if r.filter else F.lit(True)
        out += [F.count_if(keep).alias(f"total_{i}"), F.count_if(keep & bad).alias(f"failed_{i}")]
    return out


def observed(df: DataFrame, rules: list[Rule], name: str = "rules") -> tuple[DataFrame, Callable[[], Report]]:
    """(df, a function that gives the report once df has been written): the rules cost no pass of their own."""
    seen = Observation(name)
    rules = [r for r in rules if r.type.merges]

    def report() -> Report:
        row = seen.get
        return Report([Result.counted(r, row[f"total_{i}"], row[f"failed_{i}"]) for i, r in enumerate(rules)])

    return df.observe(seen, *_expressions(df, rules)), report


def validate_batches(stream: DataFrame, rules: list[Rule], on_report: Callable[[int, Report], None], *, good: Callable[[DataFrame, int], None] | None = None, bad: Callable[[DataFrame, int], None] | None = None):
    """A stream writer, to be started: each micro-batch is validated and, if asked, split into good and bad rows."""

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist() if good or bad else batch
        on_report(number, validate(batch, rules))
        if good or bad:
            kept, broken = quarantine(batch, rules)
            if good:
                good(kept, number)
            if bad:
                bad(broken, number)
            batch.unpersist()

    return stream.writeStream.foreachBatch(handle)


def windowed_counts(stream: DataFrame, rules: list[Rule], time_column: str, window: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Per tumbling window and rule: total and failed records; rows later than the watermark are left out."""
    rules = [r for r in rules if r.type.merges]
    counts = stream.withWatermark(time_column, lateness).groupBy(F.window(time_column, window)).agg(*_expressions(stream, rules))
    items = [F.struct(F.lit(r.name).alias("rule"), F.col(f"total_{i}").alias("total_records"), F.col(f"failed_{i}").alias("failed_records")) for i, r in enumerate(rules)]
    return counts.select("window.start", "window.end", F.inline(F.array(*items)))
