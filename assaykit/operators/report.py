"""Reports as summaries, per-field rollups, JSON and text, and the exit codes of the two commands."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.errors import classify
from assaykit.model import Report, Result, RuleType, Status

#: Checks of a field that are SKIPPED, not UNKNOWN, until a rule says otherwise.
CHECKS = ("not_null", "range", "enum", "regex", "date_format", "desired_type")


def summary(report: Report) -> dict[str, Any]:
    total = max((r.total_records for r in report if r.rule.type != RuleType.SCHEMA), default=0)
    failed = sum(r.failed_records for r in report)
    return {
        "total_rules": len(report),
        "passed_rules": len(report.of_status(Status.PASSED)),
        "failed_rules": len(report.of_status(Status.FAILED)),
        "skipped_rules": len(report.of_status(Status.SKIPPED)),
        "error_rules": len(report.of_status(Status.ERROR)),
        "total_failed_records": failed,
        "total_records": total,
        "error_rate": 100.0 * failed / total if total else 0.0,
        "execution_time_s": round(report.seconds, 3),
    }


def check_name(result: Result) -> str:
    return "desired_type" if result.rule.name.startswith("desired_type_") else result.rule.type.lower()


def fields(report: Report) -> list[dict[str, Any]]:
    """For each table and column its checks with their status, reason and failed records."""
    index: dict[tuple[str, str], dict[str, Any]] = {}

    def entry(table: str, column: str) -> dict[str, Any]:
        return index.setdefault((table, column), {"column": column, "table": table, "checks": {}})

    for r in report:
        if r.rule.type == RuleType.SCHEMA:
            for c in r.details.get("schema_details", {}).get("field_results", []):
                entry(r.rule.table, c["column"])["checks"] |= {k: {"status": c[k], "failure_code": c["failure_code"]} for k in ("existence", "type")}
            continue
        check: dict[str, Any] = {"status": str(r.status)}
        if r.skip_reason:
            check["skip_reason"] = r.skip_reason
        if r.failed_records:
            check["failed_records"] = r.failed_records
        entry(r.rule.table, r.rule.column)["checks"][check_name(r)] = check
    return list(index.values())


def extras(report: Report) -> list[str]:
    return sorted({x for r in report for x in r.details.get("schema_details", {}).get("extras", [])})


def contract_json(report: Report, source: str, rules_file: str) -> str:
    """The contract command's JSON."""
    found = summary(report)
    payload: dict[str, Any] = {
        "status": "ok",
        "source": source,
        "rules_file": rules_file,
        "rules_count": len(report),
        "summary": {k: v for k, v in found.items() if k not in ("total_records", "error_rate")},
        "results": report.to_dicts(),
        "fields": fields(report),
    }
    if extras(report):
        payload["schema_extras"] = extras(report)
    return json.dumps(payload, default=str, ensure_ascii=False)


def contract_text(report: Report, source: str) -> str:
    """A table's fields with what is wrong with them, a line each."""
    lines = [f"Checking {source}"]
    for table in dict.fromkeys(f["table"] for f in fields(report)):
        own = [f for f in fields(report) if f["table"] == table]
        rows = next((r.total_records for r in report if r.rule.table == table and r.rule.type != RuleType.SCHEMA and r.total_records), 0)
        lines.append(f"\nTable {table} ({rows} records)")
        for f in own:
            bad = []
            for name, c in f["checks"].items():
                if name in ("existence", "type"):
                    if c["status"] == "FAILED":
                        bad.append({"FIELD_MISSING": "missing (skip dependent checks)", "TYPE_MISMATCH": "type mismatch"}.get(c["failure_code"], "metadata mismatch"))
                elif c["status"] in ("FAILED", "ERROR"):
                    bad.append(f"{name} ({c.get('failed_records', 0)} failures)" if c["status"] == "FAILED" else f"{name} (error)")
            lines.append(f"  {'✗' if bad else '✓'} {f['column']}: {', '.join(dict.fromkeys(bad)) or 'OK'}")
        more = next((r.details["schema_details"]["extras"] for r in report if r.rule.table == table and r.rule.type == RuleType.SCHEMA), [])
        if more:
            lines.append(f"  ✗ extra columns: {', '.join(more)}")
    s = summary(report)
    lines.append(f"\n{s['passed_rules']} passed, {s['failed_rules']} failed, {s['skipped_rules']} skipped, {s['error_rules']} errors; {s['total_failed_records']} failed records, {s['error_rate']:.2f}% of {s['total_records']}; {s['execution_time_s']} s")
    return "\n".join(lines)


def check_text(report: Report, source: str, *, quiet: bool = False, verbose: bool = False) -> str:
    """The check command's text: a line per rule, samples of failures if verbose, only the last line if quiet."""
    lines = [] if quiet else [f"Checking {source}"]
    for r in [] if quiet else report:
        mark = {Status.PASSED: "✓", Status.FAILED: "✗", Status.SKIPPED: "-"}.get(r.status, "!")
        lines.append(f"{mark} {r.rule.name}: {r.error_message or r.message}" + (f" ({100 * r.error_rate:.2f}%)" if r.failed_records else ""))
        if verbose and r.sample_data:
            lines += [f"    {json.dumps(s, default=str, ensure_ascii=False)}" for s in r.sample_data]
    s = summary(report)
    lines.append(f"{s['passed_rules']} of {s['total_rules']} rules passed, {s['failed_rules']} failed, {s['error_rules']} errors; {s['total_failed_records']} failed records in {s['execution_time_s']} s")
    return "\n".join(lines)


def check_exit_code(report: Report) -> int:
    """0; the code of the first error if a rule had one; 1 if a rule failed."""
    errors = report.of_status(Status.ERROR)
    if errors:
        why = errors[0].error_message or ""
        if "not found" in why:
            return 7 if why.startswith("table") else 8
        return classify(RuntimeError(why)).exit_code
    return int(bool(report.of_status(Status.FAILED)))


def contract_exit_code(report: Report, fail_on_error: bool = False) -> int:
    """1 if a rule failed, or in any case with fail_on_error."""
    return int(fail_on_error or bool(report.of_status(Status.FAILED)))


def rollup(results: DataFrame) -> DataFrame:
    """For each table and column of a results DataFrame: rules, failed rules and failed records."""
    return results.groupBy("table", "column").agg(F.count(F.lit(1)).alias("rules"), F.count_if(F.col("status") == "FAILED").alias("failed_rules"), F.sum("failed_records").alias("failed_records"))
