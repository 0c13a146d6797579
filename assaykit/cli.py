"""Two commands: ``check`` (rules on one table) and ``schema`` (a contract).

    python -m assaykit check --conn users.csv --table users --rule "not_null(id)" --rules more.json
    python -m assaykit schema --conn book.xlsx --rules contract.json --output json
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from assaykit.errors import ContractError, classify
from assaykit.operators.contract_run import run_contract
from assaykit.operators.engine import validate
from assaykit.operators.report import check_exit_code, check_text, contract_exit_code, contract_json, contract_text
from assaykit.plans.contract import read_contract
from assaykit.plans.parse import parse_rules
from assaykit.sources.readers import parse_source, read

RULES_HELP = "rules: not_null(c)  unique(c)  length(c,min[,max])  range(c,min[,max])  enum(c,a,b,…)  regex(c,pattern)  date_format(c,YYYY-MM-DD)"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="assaykit", description="data quality and schema validation on Spark", epilog=RULES_HELP)
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check", help="rules on one table", epilog=RULES_HELP)
    check.add_argument("--conn", required=True, help="file, database URL, catalog://table")
    check.add_argument("--table", required=True)
    check.add_argument("--rule", action="append", default=[], dest="inline")
    check.add_argument("--rules", dest="file")
    check.add_argument("--quiet", action="store_true")
    check.add_argument("--verbose", action="store_true")
    schema = commands.add_parser("schema", help="a contract's fields")
    schema.add_argument("--conn", required=True)
    schema.add_argument("--rules", required=True, dest="file")
    schema.add_argument("--table")
    schema.add_argument("--output", choices=("table", "json"), default="table")
    schema.add_argument("--fail-on-error", action="store_true")
    schema.add_argument("--verbose", action="store_true")
    return parser


def run(arguments: list[str], spark: SparkSession | None = None) -> tuple[int, str]:
    """(exit code, output)."""
    given = _parser().parse_args(arguments)
    try:
        if given.command == "check":
            if not given.inline and not given.file:
                raise ContractError("no rules given; use --rule or --rules")
            rules = parse_rules(given.table, given.inline, given.file)
            tables = read(_session(spark), parse_source(given.conn, given.table))
            report = validate(tables, rules)
            return check_exit_code(report), check_text(report, given.conn, quiet=given.quiet, verbose=given.verbose)
        contract = read_contract(given.file, given.table)
        single = contract.tables[0].name if len(contract.tables) == 1 else None
        tables = read(_session(spark), parse_source(given.conn, given.table or single))
        report = run_contract(tables, contract)
        text = contract_json(report, given.conn, given.file) if given.output == "json" else "\n".join([*(f"warning: {w}" for w in contract.warnings), contract_text(report, given.conn)])
        return contract_exit_code(report, given.fail_on_error), text
    except Exception as e:  # noqa: BLE001  every error has an exit code
        found = classify(e)
        return found.exit_code, f"error ({found.category}): {found.message}" + (f"; {found.advice}" if found.advice else "")


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.builder.appName("assaykit").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main() -> None:
    code, text = run(sys.argv[1:])
    print(text)
    sys.exit(code)
