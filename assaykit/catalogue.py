"""Queries registered with the driver, each with its SQL.

The tables hold no nulls, so each query derives its violations from whole tables by a fixed rule, on both sides.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import scalars
from assaykit.functions.predicates import integers_within_digits, quoted
from assaykit.model import Report, Rule, RuleType, Target
from assaykit.operators.contract_run import run_contract
from assaykit.operators.engine import prevalidate, quarantine, validate
from assaykit.operators.report import contract_exit_code, fields, rollup, summary
from assaykit.operators.schema_check import check_fields
from assaykit.plans.compat import desired_rule, matrix_rows
from assaykit.plans.contract import decompose, parse_contract, skip_map
from assaykit.plans.fusion import duplicates, rule_counts, samples, violations
from assaykit.plans.parse import parse_rules, rule_from_dict
from assaykit.plans.types import TypeInfo
from assaykit.sources import readers

Query = Callable[[SparkSession, str], DataFrame]

#: Derived columns: query's table, name, Spark SQL, DuckDB SQL (where it differs).
_EMAIL = (
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN concat('user', o_custkey, '.example.com') "
    "WHEN o_orderkey % 5 = 0 THEN concat('u', o_custkey, '@example.org') ELSE concat('u', o_custkey, '@example.com') END"
)
_ISO = "CASE o_orderkey % 6 WHEN 0 THEN '2023-02-31' WHEN 1 THEN '2023-1-05' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN '2024-02-29' ELSE '2023-12-25' END"
_US = "CASE o_orderkey % 4 WHEN 0 THEN '13/01/2023' WHEN 1 THEN '12/25/2023' WHEN 2 THEN '02/30/2024' ELSE NULL END"
_COMPACT = "CASE o_orderkey % 4 WHEN 0 THEN '20230229' WHEN 1 THEN '20240229' WHEN 2 THEN '19780230' ELSE '19680630' END"
_TIME = "CASE o_orderkey % 5 WHEN 0 THEN '12:13:14' WHEN 1 THEN '14:15:78' WHEN 2 THEN '25:17:18' WHEN 3 THEN '00:00:00' ELSE NULL END"
_INT_DATE = "CASE o_orderkey % 3 WHEN 0 THEN 19680223 WHEN 1 THEN 19780230 ELSE 19610631 END"
_NUMBER_TEXT = "CASE o_orderkey % 7 WHEN 0 THEN '12' WHEN 1 THEN '-5' WHEN 2 THEN '12.7' WHEN 3 THEN 'abc' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE '12345' END"
_PRECISE = "CASE o_orderkey % 6 WHEN 0 THEN 999.9 WHEN 1 THEN 1000.0 WHEN 2 THEN 99.99 WHEN 3 THEN 10.0 WHEN 4 THEN NULL ELSE 0.5 END"
_LINE = {
    "flag": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END",
    "qty": "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_quantity END",
}


def _table(spark: SparkSession, sf_dir: str, name: str, **derived: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({k: F.expr(v) for k, v in derived.items()}) if derived else df


def _rule(kind: str, column: str, name: str, **parameters) -> Rule:
    return Rule(RuleType(kind), Target("t", column), parameters, name=name, id=name)


def _counts_sql(table: str, rules: list[tuple[str, str, str | None]], **derived: str) -> str:
    """SQL for rule_counts(): (name, violation, filter) of each rule."""
    columns = "".join(f", {v} AS {k}" for k, v in derived.items())
    parts = []
    for name, bad, keep in rules:
        where = f" WHERE {keep}" if keep else ""
        parts.append(f"SELECT '{name}' AS rule, count(*) AS total_records, count(*) FILTER (WHERE {bad}) AS failed_records FROM t{where}")
    return f"WITH t AS (SELECT *{columns} FROM {table}) SELECT *, CASE WHEN failed_records = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM ({' UNION ALL '.join(parts)})"


def _unique_sql(table: str, column: str, name: str, where: str = "true", **derived: str) -> str:
    columns = "".join(f", {v} AS {k}" for k, v in derived.items())
    return (
        f"WITH t AS (SELECT *{columns} FROM {table}), g AS (SELECT {column} AS value, count(*) AS n FROM t WHERE {where} GROUP BY 1) "
        f"SELECT '{name}' AS rule, sum(n)::BIGINT AS total_records, coalesce(sum(n - 1) FILTER (WHERE value IS NOT NULL), 0)::BIGINT AS failed_records, "
        "CASE WHEN coalesce(sum(n - 1) FILTER (WHERE value IS NOT NULL), 0) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM g"
    )


def _date_sql(column: str, fmt: str) -> str:
    return f"{column} IS NOT NULL AND trim({column}::VARCHAR) <> '' AND (try_strptime({column}::VARCHAR, '{fmt}') IS NULL OR strftime(try_strptime({column}::VARCHAR, '{fmt}'), '{fmt}') <> {column}::VARCHAR)"


class _Catalogue:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def counts(self, name: str, table: str, rules: list[tuple[Rule, str]], **derived: str) -> None:
        """A query of row rules, each with the SQL of its violation."""
        self.queries[name] = lambda spark, d: rule_counts(_table(spark, d, table, **derived), [r for r, _ in rules])
        self.sql[name] = _counts_sql(table, [(r.name, bad, r.filter) for r, bad in rules], **derived)

    def add(self, name: str, query: Query, sql: str) -> None:
        self.queries[name], self.sql[name] = query, sql


C = _Catalogue()

# Row rules, alone.
C.counts("rule_not_null", "lineitem", [(_rule("NOT_NULL", "flag", "flag_not_null"), "flag IS NULL")], flag=_LINE["flag"])
C.counts("rule_not_null_empty_text", "lineitem", [(_rule("NOT_NULL", "e", "empty_is_no_null"), "e IS NULL")], e="CASE WHEN l_linenumber = 1 THEN '' ELSE l_returnflag END")
C.counts("rule_length_min_max", "customer", [(_rule("LENGTH", "c_mktsegment", "segment_length", min_length=8, max_length=9), "length(c_mktsegment) < 8 OR length(c_mktsegment) > 9")])
C.counts("rule_length_exact", "customer", [(_rule("LENGTH", "c_name", "name_length", exact_length=18), "length(c_name) <> 18")])
C.counts("rule_length_null_fails", "lineitem", [(_rule("LENGTH", "flag", "flag_length", min_length=1), "flag IS NULL OR length(flag) < 1")], flag=_LINE["flag"])
C.counts("rule_length_characters", "documents", [(_rule("LENGTH", "text", "text_length", max_length=2000), "length(text) > 2000")])
C.counts("rule_range_both", "lineitem", [(_rule("RANGE", "l_quantity", "quantity_range", min=1, max=40), "l_quantity < 1 OR l_quantity > 40")])
C.counts("rule_range_min_only", "part", [(_rule("RANGE", "p_retailprice", "price_min", min=1000), "p_retailprice < 1000")])
C.counts("rule_range_max_only", "part", [(_rule("RANGE", "p_size", "size_max", max=25), "p_size > 25")])
C.counts("rule_range_equal", "part", [(_rule("RANGE", "p_size", "size_is_7", min=7, max=7), "p_size < 7 OR p_size > 7")])
C.counts("rule_range_zero_bound", "customer", [(_rule("RANGE", "c_acctbal", "no_debt", min_value=0), "c_acctbal < 0")])
C.counts("rule_range_null_fails", "lineitem", [(_rule("RANGE", "qty", "qty_range", min=0, max=100), "qty IS NULL OR qty < 0 OR qty > 100")], qty=_LINE["qty"])
C.counts("rule_enum_string", "orders", [(_rule("ENUM", "o_orderstatus", "status_known", allowed_values=["F", "O"]), "o_orderstatus NOT IN ('F', 'O')")])
C.counts("rule_enum_numeric", "part", [(_rule("ENUM", "p_size", "size_listed", allowed_values=[1, 2, "3", 4.0, 5]), "p_size NOT IN (1, 2, 3, 4, 5)")])
C.counts("rule_enum_mixed_as_text", "part", [(_rule("ENUM", "p_size", "size_mixed", allowed_values=[1, 2, "x"]), "p_size::VARCHAR NOT IN ('1', '2', 'x')")])
C.counts("rule_enum_null_passes", "lineitem", [(_rule("ENUM", "flag", "flag_known", allowed_values=["A", "R"]), "flag NOT IN ('A', 'R')")], flag=_LINE["flag"])
C.counts("rule_enum_domain", "orders", [(_rule("ENUM", "email", "domain_known", allowed_values=["example.com"], extract_domain=True), "email IS NOT NULL AND contains(email, '@') AND split_part(email, '@', -1) NOT IN ('example.com')")], email=_EMAIL)
C.counts("rule_regex_email", "orders", [(_rule("REGEX", "email", "email_form", pattern=r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), r"NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$')")], email=_EMAIL)
C.counts("rule_regex_code", "part", [(_rule("REGEX", "p_brand", "brand_form", pattern="^Brand#[1-3]"), "NOT regexp_matches(p_brand, '^Brand#[1-3]')")])
C.counts("rule_regex_search", "supplier", [(_rule("REGEX", "s_name", "name_has_5", pattern="5"), "NOT regexp_matches(s_name, '5')")])
C.counts("rule_regex_null_passes", "lineitem", [(_rule("REGEX", "flag", "flag_form", pattern="^[AN]$"), "NOT regexp_matches(flag, '^[AN]$')")], flag=_LINE["flag"])
C.counts("rule_date_format_iso", "orders", [(_rule("DATE_FORMAT", "d", "iso", format_pattern="YYYY-MM-DD"), _date_sql("d", "%Y-%m-%d"))], d=_ISO)
C.counts("rule_date_format_us", "orders", [(_rule("DATE_FORMAT", "d", "us", format_pattern="MM/DD/YYYY"), _date_sql("d", "%m/%d/%Y"))], d=_US)
C.counts("rule_date_format_compact", "orders", [(_rule("DATE_FORMAT", "d", "compact", format_pattern="yyyymmdd"), _date_sql("d", "%Y%m%d"))], d=_COMPACT)
C.counts("rule_date_format_time", "orders", [(_rule("DATE_FORMAT", "d", "time", format_pattern="HH:MI:SS"), _date_sql("d", "%H:%M:%S"))], d=_TIME)
C.counts("rule_date_format_int_native", "orders", [(_rule("DATE_FORMAT", "d", "int_date", format_pattern="YYYYMMDD"), _date_sql("d", "%Y%m%d"))], d=_INT_DATE)
C.counts("rule_date_format_directives", "orders", [(_rule("DATE_FORMAT", "d", "directives", format_pattern="%Y-%m-%d"), _date_sql("d", "%Y-%m-%d"))], d=_ISO)
C.counts("rule_total_count", "nation", [(_rule("NOT_NULL", "n_name", "nation_names"), "n_name IS NULL")])

# Filters and fusion.
C.counts("rule_filtered", "lineitem", [(_rule("RANGE", "l_quantity", "returned_quantity", max=40, filter_condition="l_returnflag = 'R'"), "l_quantity > 40")])
C.counts(
    "rules_same_filter",
    "lineitem",
    [
        (_rule("RANGE", "l_discount", "discount", max=0.05, filter_condition="l_linestatus = 'O'"), "l_discount > 0.05"),
        (_rule("ENUM", "l_returnflag", "flag", allowed_values=["N"], filter_condition="l_linestatus = 'O'"), "l_returnflag NOT IN ('N')"),
    ],
)
C.counts(
    "rules_mixed_filters",
    "lineitem",
    [
        (_rule("RANGE", "l_quantity", "quantity_of_r", max=40, filter_condition="l_returnflag = 'R'"), "l_quantity > 40"),
        (_rule("RANGE", "l_quantity", "quantity_of_late", max=30, filter_condition="l_shipdate >= timestamp '1996-01-01'"), "l_quantity > 30"),
        (_rule("NOT_NULL", "flag", "flag_given"), "flag IS NULL"),
        (_rule("RANGE", "l_tax", "tax_of_none", max=0.01, filter_condition="l_orderkey < 0"), "l_tax > 0.01"),
    ],
    flag=_LINE["flag"],
)
FLAGSHIP = [
    (_rule("NOT_NULL", "flag", "flag_not_null"), "flag IS NULL"),
    (_rule("RANGE", "qty", "qty_range", min=1, max=40), "qty IS NULL OR qty < 1 OR qty > 40"),
    (_rule("ENUM", "l_linestatus", "linestatus_enum", allowed_values=["O"]), "l_linestatus NOT IN ('O')"),
    (_rule("REGEX", "l_returnflag", "returnflag_regex", pattern="^[AR]$"), "NOT regexp_matches(l_returnflag, '^[AR]$')"),
    (_rule("LENGTH", "l_returnflag", "returnflag_length", exact_length=1), "l_returnflag IS NULL OR length(l_returnflag) <> 1"),
    (_rule("RANGE", "l_discount", "discount_range", min=0, max=0.08), "l_discount < 0 OR l_discount > 0.08"),
]
C.counts("rules_fused_lineitem", "lineitem", FLAGSHIP, **_LINE)


def _individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules as rules_fused_lineitem, each in a plan of its own: the counts must not differ."""
    df, out = _table(spark, sf_dir, "lineitem", **_LINE), None
    for rule, _ in FLAGSHIP:
        one = rule_counts(df, [rule])
        out = one if out is None else out.unionByName(one)
    return out


C.add("rules_individual_lineitem", _individual, C.sql["rules_fused_lineitem"])

_MANY = [(_rule("RANGE", "l_extendedprice", f"price_over_{i}", min=100 * i), f"l_extendedprice < {100 * i}") for i in range(1, 41)]
C.counts("rules_fused_forty", "lineitem", _MANY)

_MULTI = {
    "orders": [(_rule("RANGE", "o_totalprice", "orders_price", min=0, max=300000), "o_totalprice < 0 OR o_totalprice > 300000")],
    "customer": [(_rule("ENUM", "c_mktsegment", "customer_segment", allowed_values=["BUILDING", "MACHINERY"]), "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")],
    "part": [(_rule("REGEX", "p_type", "part_type", pattern="STEEL"), "NOT regexp_matches(p_type, 'STEEL')")],
    "supplier": [(_rule("RANGE", "s_acctbal", "supplier_balance", min=0), "s_acctbal < 0")],
}


def _multi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for table, rules in _MULTI.items():
        one = rule_counts(_table(spark, sf_dir, table), [r for r, _ in rules])
        out = one if out is None else out.unionByName(one)
    return out


C.add("rules_multi_table", _multi_table, " UNION ALL ".join(f"SELECT * FROM ({_counts_sql(t, [(r.name, bad, None) for r, bad in rules])})" for t, rules in _MULTI.items()))

# UNIQUE.
C.add("rule_unique", lambda s, d: rule_counts(_table(s, d, "lineitem"), [_rule("UNIQUE", "l_orderkey", "orderkey_unique")]), _unique_sql("lineitem", "l_orderkey", "orderkey_unique"))
C.add("rule_unique_key", lambda s, d: rule_counts(_table(s, d, "orders"), [_rule("UNIQUE", "o_orderkey", "key_unique")]), _unique_sql("orders", "o_orderkey", "key_unique"))
C.add("rule_unique_nulls", lambda s, d: rule_counts(_table(s, d, "orders", email=_EMAIL), [_rule("UNIQUE", "email", "email_unique")]), _unique_sql("orders", "email", "email_unique", email=_EMAIL))
C.add(
    "rule_unique_filtered",
    lambda s, d: rule_counts(_table(s, d, "orders"), [_rule("UNIQUE", "o_custkey", "custkey_unique", filter_condition="o_orderstatus = 'F'")]),
    _unique_sql("orders", "o_custkey", "custkey_unique", "o_orderstatus = 'F'"),
)
C.add(
    "rules_unique_several",
    lambda s, d: rule_counts(_table(s, d, "orders"), [_rule("UNIQUE", c, f"{c}_unique") for c in ("o_orderkey", "o_custkey", "o_orderpriority")]),
    " UNION ALL ".join(f"SELECT * FROM ({_unique_sql('orders', c, f'{c}_unique')})" for c in ("o_orderkey", "o_custkey", "o_orderpriority")),
)
C.add("unique_dup_groups", lambda s, d: duplicates(_table(s, d, "orders"), _rule("UNIQUE", "o_custkey", "u")), "SELECT o_custkey AS value, count(*) AS duplicate_count FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
C.add(
    "unique_dup_samples",
    lambda s, d: samples(_table(s, d, "lineitem"), _rule("UNIQUE", "l_orderkey", "u"), 5),
    "SELECT l_orderkey AS value, count(*) AS duplicate_count FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 10",
)

# Samples and quarantine.
_PRICE = _rule("RANGE", "o_totalprice", "price", max=200000)
C.add(
    "samples_range",
    lambda s, d: samples(_table(s, d, "orders").select("o_orderkey", "o_totalprice"), _PRICE, 5, ["o_orderkey"]),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NULL OR o_totalprice > 200000 ORDER BY o_orderkey LIMIT 5",
)
C.add(
    "samples_filtered",
    lambda s, d: samples(_table(s, d, "orders", email=_EMAIL).select("o_orderkey", "o_orderstatus", "email"), _rule("REGEX", "email", "e", pattern="@", filter_condition="o_orderstatus = 'O'"), 5, ["o_orderkey"]),
    f"SELECT * FROM (SELECT o_orderkey, o_orderstatus, {_EMAIL} AS email FROM orders) WHERE o_orderstatus = 'O' AND NOT regexp_matches(email, '@') ORDER BY o_orderkey LIMIT 5",
)
C.add(
    "violating_rows",
    lambda s, d: violations(_table(s, d, "lineitem", **_LINE), FLAGSHIP[1][0]).select("l_orderkey", "l_linenumber", "qty"),
    f"SELECT * FROM (SELECT l_orderkey, l_linenumber, {_LINE['qty']} AS qty FROM lineitem) WHERE qty IS NULL OR qty < 1 OR qty > 40",
)
C.add(
    "quarantine_split",
    lambda s, d: quarantine(_table(s, d, "orders", email=_EMAIL), [_PRICE, _rule("NOT_NULL", "email", "email_given")])[1].select("o_orderkey", F.array_join("broken_rules", ",").alias("broken")),
    f"""SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 200000 THEN 'price' END, CASE WHEN email IS NULL THEN 'email_given' END) AS broken
        FROM (SELECT *, {_EMAIL} AS email FROM orders) WHERE o_totalprice > 200000 OR email IS NULL""",
)


# Desired types.
def _desired(column: str, native: TypeInfo, desired: str) -> Rule:
    rule = desired_rule("t", column, native, desired)
    return Rule(rule.type, rule.target, rule.parameters, name=f"{column} as {desired}", id=column + desired)


def _desired_counts(name: str, column: str, native: TypeInfo, desired: str, bad: str, table: str = "orders", **derived: str) -> None:
    rule = _desired(column, native, desired)
    C.queries[name] = lambda s, d: rule_counts(_table(s, d, table, **derived), [rule]).withColumn("rule", F.lit(name))
    C.sql[name] = _counts_sql(table, [(name, bad, None)], **derived)


_desired_counts("desired_int_digits", "o_custkey", TypeInfo("INTEGER"), "integer(3)", "abs(o_custkey) >= 1000")
_desired_counts("desired_float_to_int", "o_totalprice", TypeInfo("FLOAT"), "integer", "o_totalprice <> floor(o_totalprice)")
_desired_counts("desired_float_to_int_digits", "o_totalprice", TypeInfo("FLOAT"), "integer(5)", "o_totalprice <> floor(o_totalprice) OR abs(o_totalprice) >= 100000")
_desired_counts("desired_float_precision", "v", TypeInfo("FLOAT"), "float(4,1)", "v IS NOT NULL AND (abs(v) >= 1000 OR round(v::DOUBLE, 1) <> v::DOUBLE)", v=f"CAST({_PRECISE} AS DOUBLE)")
_desired_counts("desired_float_precision_equals_scale", "v", TypeInfo("FLOAT"), "float(1,1)", "v IS NOT NULL AND (abs(v) >= 1 OR round(v::DOUBLE, 1) <> v::DOUBLE)", v=f"CAST({_PRECISE} AS DOUBLE)")
_desired_counts("desired_string_length", "c_mktsegment", TypeInfo("STRING"), "string(8)", "length(c_mktsegment) > 8", table="customer")
_desired_counts("desired_int_to_string", "o_custkey", TypeInfo("INTEGER"), "string(3)", "length(o_custkey::VARCHAR) > 3")
_desired_counts("desired_str_to_int", "v", TypeInfo("STRING"), "integer", "NOT regexp_matches(v, '^-?[0-9]+$')", v=_NUMBER_TEXT)
_desired_counts("desired_str_to_int_digits", "v", TypeInfo("STRING"), "integer(2)", "NOT regexp_matches(v, '^-?0*[0-9]{1,2}$')", v=_NUMBER_TEXT)
_desired_counts("desired_str_to_float", "v", TypeInfo("STRING"), "float", r"NOT regexp_matches(v, '^-?[0-9]+(\.[0-9]+)?$')", v=_NUMBER_TEXT)
_desired_counts("desired_str_to_date", "d", TypeInfo("STRING"), "date('YYYY-MM-DD')", _date_sql("d", "%Y-%m-%d"), d=_ISO)
_desired_counts("desired_int_to_date", "d", TypeInfo("INTEGER"), "date", _date_sql("d", "%Y%m%d"), d=_INT_DATE)
_desired_counts("desired_int_to_float", "o_custkey", TypeInfo("INTEGER"), "float(5,2)", "abs(o_custkey) >= 1000")

_KIND = {"I": {"INTEGER": "REGEX", "FLOAT": "REGEX", "DATE": "DATE_FORMAT", "DATETIME": "DATE_FORMAT"}}
C.add(
    "desired_matrix",
    lambda s, d: s.createDataFrame(matrix_rows(), "native string, desired string, verdict string, kind string"),
    """WITH cells(native, desired, verdict, kind) AS (VALUES
         ('STRING', 'STRING', 'COMPATIBLE', NULL), ('STRING', 'INTEGER', 'INCOMPATIBLE', 'REGEX'), ('STRING', 'FLOAT', 'INCOMPATIBLE', 'REGEX'),
         ('STRING', 'DATE', 'INCOMPATIBLE', 'DATE_FORMAT'), ('STRING', 'DATETIME', 'INCOMPATIBLE', 'DATE_FORMAT'),
         ('INTEGER', 'STRING', 'COMPATIBLE', NULL), ('INTEGER', 'INTEGER', 'COMPATIBLE', NULL), ('INTEGER', 'FLOAT', 'COMPATIBLE', NULL),
         ('INTEGER', 'DATE', 'INCOMPATIBLE', 'DATE_FORMAT'), ('INTEGER', 'DATETIME', 'INCOMPATIBLE', 'DATE_FORMAT'),
         ('FLOAT', 'STRING', 'COMPATIBLE', NULL), ('FLOAT', 'INTEGER', 'INCOMPATIBLE', 'REGEX'), ('FLOAT', 'FLOAT', 'COMPATIBLE', NULL),
         ('BOOLEAN', 'BOOLEAN', 'COMPATIBLE', NULL), ('DATE', 'STRING', 'COMPATIBLE', NULL), ('DATE', 'DATE', 'COMPATIBLE', NULL), ('DATE', 'DATETIME', 'COMPATIBLE', NULL),
         ('DATETIME', 'STRING', 'COMPATIBLE', NULL), ('DATETIME', 'DATE', 'COMPATIBLE', NULL), ('DATETIME', 'DATETIME', 'COMPATIBLE', NULL)),
       types(t) AS (VALUES ('STRING'), ('INTEGER'), ('FLOAT'), ('BOOLEAN'), ('DATE'), ('DATETIME'))
       SELECT n.t AS native, d.t AS desired, coalesce(verdict, 'CONFLICTING') AS verdict, kind
       FROM types n CROSS JOIN types d LEFT JOIN cells ON native = n.t AND desired = d.t""",
)


# Schemas: from the data's schema on one side, from the information schema on the other.
def _schema_check(table: str, columns: dict, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        checks, extras = check_fields(_table(spark, sf_dir, table).schema, columns, **options)
        rows = [(c.column, c.existence, c.type, c.failure_code) for c in checks] + [(e, "EXTRA", "SKIPPED", "EXTRA_COLUMN") for e in extras]
        return spark.createDataFrame(rows, "`column` string, existence string, type string, failure_code string")

    return query


def _schema_sql(table: str, columns: dict, strict: bool = False, case_insensitive: bool = False) -> str:
    fold = "lower" if case_insensitive else ""
    wanted = ", ".join(f"('{c}', '{w['expected_type']}')" for c, w in columns.items())
    extra = f" UNION ALL SELECT column_name, 'EXTRA', 'SKIPPED', 'EXTRA_COLUMN' FROM there WHERE {fold}(column_name) NOT IN (SELECT {fold}(name) FROM wanted)" if strict else ""
    return f"""WITH wanted(name, want) AS (VALUES {wanted}),
      there AS (SELECT column_name, CASE WHEN data_type IN ('VARCHAR') THEN 'STRING' WHEN data_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'INTEGER'
                  WHEN data_type IN ('DOUBLE', 'FLOAT') OR data_type LIKE 'DECIMAL%' THEN 'FLOAT' WHEN data_type = 'BOOLEAN' THEN 'BOOLEAN' WHEN data_type = 'DATE' THEN 'DATE'
                  WHEN data_type LIKE 'TIMESTAMP%' THEN 'DATETIME' END AS kind FROM information_schema.columns WHERE table_name = '{table}')
      SELECT name AS "column", CASE WHEN column_name IS NULL THEN 'FAILED' ELSE 'PASSED' END AS existence,
             CASE WHEN column_name IS NULL THEN 'SKIPPED' WHEN kind IS NOT DISTINCT FROM want THEN 'PASSED' ELSE 'FAILED' END AS type,
             CASE WHEN column_name IS NULL THEN 'FIELD_MISSING' WHEN kind IS NOT DISTINCT FROM want THEN 'NONE' ELSE 'TYPE_MISMATCH' END AS failure_code
      FROM wanted LEFT JOIN there ON {fold}(column_name) = {fold}(name){extra}"""


def _kinds(**kinds: str) -> dict:
    return {c: {"expected_type": k} for c, k in kinds.items()}


for _name, _t, _columns, _options in (
    ("schema_check_ok", "nation", _kinds(n_nationkey="INTEGER", n_name="STRING", n_regionkey="INTEGER"), {}),
    ("schema_check_missing", "nation", _kinds(n_nationkey="INTEGER", n_comment="STRING", N_NAME="STRING"), {}),
    ("schema_check_mismatch", "lineitem", _kinds(l_quantity="INTEGER", l_shipdate="DATETIME", l_tax="FLOAT", l_returnflag="BOOLEAN"), {}),
    ("schema_check_strict", "region", _kinds(r_regionkey="INTEGER"), {"strict": True}),
    ("schema_check_case_insensitive", "region", _kinds(R_REGIONKEY="INTEGER", R_Name="STRING", r_other="STRING"), {"case_insensitive": True, "strict": True}),
    ("schema_check_unsupported_type", "embeddings", _kinds(vec_id="INTEGER", embedding="STRING", label="INTEGER"), {}),
):
    C.add(_name, _schema_check(_t, _columns, **_options), _schema_sql(_t, _columns, **_options))

# Rollups over counts.
C.add(
    "profile_error_rate",
    lambda s, d: C.queries["rules_fused_lineitem"](s, d).select("rule", F.try_divide("failed_records", "total_records").alias("error_rate"), (1 - F.try_divide("failed_records", "total_records")).alias("success_rate")),
    f"SELECT rule, failed_records / total_records AS error_rate, 1 - failed_records / total_records AS success_rate FROM ({C.sql['rules_fused_lineitem']})",
)
C.add(
    "report_summary",
    lambda s, d: s.createDataFrame([tuple(v for k, v in summary(validate(_table(s, d, "lineitem", **_LINE), [r for r, _ in FLAGSHIP])).items() if k in _SUMMARY)], ", ".join(f"{k} {t}" for k, t in _SUMMARY.items())),
    f"""SELECT count(*) AS total_rules, count(*) FILTER (WHERE status = 'PASSED') AS passed_rules, count(*) FILTER (WHERE status = 'FAILED') AS failed_rules, 0::BIGINT AS skipped_rules, 0::BIGINT AS error_rules,
          sum(failed_records)::BIGINT AS total_failed_records, max(total_records) AS total_records FROM ({C.sql['rules_fused_lineitem']})""",
)
_SUMMARY = {"total_rules": "long", "passed_rules": "long", "failed_rules": "long", "skipped_rules": "long", "error_rules": "long", "total_failed_records": "long", "total_records": "long"}
_COLUMN_OF = {r.name: r.column for r, _ in FLAGSHIP}
C.add(
    "fields_rollup",
    lambda s, d: rollup(C.queries["rules_fused_lineitem"](s, d).withColumn("table", F.lit("lineitem")).withColumn("column", F.element_at(F.create_map(*[F.lit(x) for kv in _COLUMN_OF.items() for x in kv]), F.col("rule")))),
    f"""SELECT 'lineitem' AS "table", c AS "column", count(*) AS rules, count(*) FILTER (WHERE status = 'FAILED') AS failed_rules, sum(failed_records)::BIGINT AS failed_records
        FROM ({C.sql['rules_fused_lineitem']}) JOIN (VALUES {', '.join(f"('{r}', '{c}')" for r, c in _COLUMN_OF.items())}) m(r, c) ON r = rule GROUP BY c""",
)


# Scalar helpers.
def _scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders", email=_EMAIL, iso=_ISO)
    f = scalars.DATE_FUNCTIONS
    return df.select(
        "o_orderkey",
        scalars.string_length("o_orderpriority").alias("len"),
        scalars.substring("o_orderpriority", 1, 3).alias("sub"),
        scalars.matches(F.col("email"), "org$").alias("org"),
        scalars.like_ignoring_case(F.col("o_orderpriority"), "%URGENT").alias("urgent"),
        scalars.after_last(F.col("email"), "@").alias("domain"),
        f["year"]("o_orderdate").cast("long").alias("y"),
        f["month"]("o_orderdate").cast("long").alias("m"),
        f["day"]("o_orderdate").cast("long").alias("d"),
        f["datediff"](F.col("o_orderdate"), scalars.date_literal("1995-01-01")).cast("long").alias("days"),
        scalars.parse_date(F.col("iso"), "YYYY-MM-DD").isNotNull().alias("is_date"),
    )


C.add(
    "scalar_functions",
    _scalars,
    f"""SELECT o_orderkey, length(o_orderpriority)::INT AS len, substr(o_orderpriority, 1, 3) AS sub, regexp_matches(email, 'org$') AS org, o_orderpriority ILIKE '%URGENT' AS urgent,
          split_part(email, '@', -1) AS domain, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS days,
          coalesce(strftime(try_strptime(iso, '%Y-%m-%d'), '%Y-%m-%d') = iso, false) AS is_date
        FROM (SELECT *, {_EMAIL} AS email, {_ISO} AS iso FROM orders)""",
)


def _sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scalars.register(spark)
    df = _table(spark, sf_dir, "orders", number=_NUMBER_TEXT, iso=_ISO)
    return df.select("o_orderkey", F.expr("detect_invalid_integer_digits(number, 2)").alias("bad_digits"), F.expr("detect_invalid_string_length(number, 2)").alias("too_long"), F.expr("is_valid_date(iso, 'yyyy-MM-dd')").alias("valid"), F.expr("detect_invalid_float_precision(number, 4, 1)").alias("imprecise"))


C.add(
    "sql_functions",
    _sql_functions,
    f"""SELECT o_orderkey, number IS NOT NULL AND coalesce(try_cast(number AS DOUBLE) <> floor(try_cast(number AS DOUBLE)) OR abs(try_cast(number AS DOUBLE)) >= 100, true) AS bad_digits,
          coalesce(length(number) > 2, false) AS too_long, NOT coalesce({_date_sql('iso', '%Y-%m-%d')}, false) AS valid,
          number IS NOT NULL AND coalesce(abs(try_cast(number AS DOUBLE)) >= 1000 OR round(try_cast(number AS DOUBLE), 1) <> try_cast(number AS DOUBLE), true) AS imprecise
        FROM (SELECT *, {_NUMBER_TEXT} AS number, {_ISO} AS iso FROM orders)""",
)


def _date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scalars.DATE_FUNCTIONS
    return _table(spark, sf_dir, "events").select(
        "event_id",
        f["hour"]("ts").cast("long").alias("h"),
        f["minute"]("ts").cast("long").alias("m"),
        f["second"]("ts").cast("long").alias("s"),
        f["date_add"]("ts", 40).cast("string").alias("later"),
        f["date_sub"]("ts", 40).cast("string").alias("earlier"),
        (f["today"]() > F.to_date("ts")).alias("past"),
        (f["now"]() > F.col("ts")).alias("before_now"),
        scalars.not_matches(F.col("event_type"), "^c").alias("no_c"),
    )


C.add(
    "date_functions",
    _date_functions,
    """SELECT event_id, hour(ts) AS h, minute(ts) AS m, floor(second(ts))::BIGINT AS s, (ts::DATE + 40)::DATE::VARCHAR AS later, (ts::DATE - 40)::DATE::VARCHAR AS earlier,
         ts::DATE < DATE '2026-01-01' AS past, ts < TIMESTAMP '2026-01-01' AS before_now, NOT regexp_matches(event_type, '^c') AS no_c FROM events""",
)
C.add(
    "integers_within_digits",
    lambda s, d: _table(s, d, "orders").select("o_orderkey", *[integers_within_digits(quoted(c), 3).alias(f"{c}_fits") for c in ("o_orderkey", "o_custkey")]),
    "SELECT o_orderkey, abs(o_orderkey) <= 999 AS o_orderkey_fits, abs(o_custkey) <= 999 AS o_custkey_fits FROM orders",
)
C.add(
    "samples_date_format",
    lambda s, d: samples(_table(s, d, "orders", d=_ISO).select("o_orderkey", "d"), _rule("DATE_FORMAT", "d", "iso", format_pattern="YYYY-MM-DD"), 5, ["o_orderkey"]),
    f"""WITH t AS (SELECT o_orderkey, {_ISO} AS d FROM orders), bad AS (SELECT *, regexp_matches(d, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AS shaped FROM t WHERE {_date_sql('d', '%Y-%m-%d')}),
        placed AS (SELECT *, row_number() OVER (PARTITION BY shaped ORDER BY o_orderkey) AS k FROM bad)
        SELECT o_orderkey, d FROM placed ORDER BY k, shaped LIMIT 5""",
)


# The engine, from rules in each of their forms to results; what is returned are the results' rows.
def _results(spark: SparkSession, report: Report) -> DataFrame:
    return report.to_df(spark).select(F.col("rule_type").alias("kind"), F.col("column").alias("field"), "status", "total_records", "failed_records", "skip_reason")


def _results_sql(parts: list[tuple[str, str, str, str]]) -> str:
    """SQL for _results(): (kind, column, table, violation) of rules that are counted; of UNIQUE rules a column's copies."""
    rows = []
    for kind, column, table, bad in parts:
        failed = f"count({column}) - count(DISTINCT {column})" if kind == "UNIQUE" else f"count(*) FILTER (WHERE {bad})"
        rows.append(f"SELECT '{kind}' AS kind, '{column}' AS field, count(*) AS total_records, {failed} AS failed_records FROM {table}")
    return f"SELECT kind, field, CASE WHEN failed_records = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, total_records, failed_records, NULL::VARCHAR AS skip_reason FROM ({' UNION ALL '.join(rows)})"


_INLINE = ["not_null(o_orderkey)", "length(o_orderpriority,5,8)", "range(o_totalprice,1000,200000)", "range(o_custkey,,500)", "enum(o_orderstatus,F,O)", "regex(o_orderpriority,^[1-3]-)", "unique(o_custkey)", "unique(o_orderkey)"]
_INLINE_SQL = [
    ("NOT_NULL", "o_orderkey", "orders", "o_orderkey IS NULL"),
    ("LENGTH", "o_orderpriority", "orders", "length(o_orderpriority) NOT BETWEEN 5 AND 8"),
    ("RANGE", "o_totalprice", "orders", "o_totalprice NOT BETWEEN 1000 AND 200000"),
    ("RANGE", "o_custkey", "orders", "o_custkey > 500"),
    ("ENUM", "o_orderstatus", "orders", "o_orderstatus NOT IN ('F', 'O')"),
    ("REGEX", "o_orderpriority", "orders", "NOT regexp_matches(o_orderpriority, '^[1-3]-')"),
    ("UNIQUE", "o_custkey", "orders", ""),
    ("UNIQUE", "o_orderkey", "orders", ""),
]
C.add("parse_inline_rules", lambda s, d: _results(s, validate(_table(s, d, "orders"), parse_rules("orders", _INLINE))), _results_sql(_INLINE_SQL))

_DICTS = [
    {"type": "not_null", "column": "c_name"},
    {"type": "LENGTH", "target": {"entities": [{"database": "main", "table": "customer", "column": "c_mktsegment"}]}, "parameters": {"exact_length": 8}},
    {"rule_type": "range", "column_name": "c_acctbal", "params": {"min_value": 0, "max_value": 1}, "max_value": 5000},
    {"type": "enum", "target": "customer.c_mktsegment", "values": ["BUILDING"]},
    {"type": "regex", "column": "c_name", "regex_pattern": "7$", "severity": "high", "is_active": True},
    {"type": "unique", "column": "c_nationkey"},
    {"type": "regex", "column": "c_name", "pattern": "x", "is_active": False},
]
_DICTS_SQL = [
    ("NOT_NULL", "c_name", "customer", "c_name IS NULL"),
    ("LENGTH", "c_mktsegment", "customer", "length(c_mktsegment) <> 8"),
    ("RANGE", "c_acctbal", "customer", "c_acctbal NOT BETWEEN 0 AND 5000"),
    ("ENUM", "c_mktsegment", "customer", "c_mktsegment NOT IN ('BUILDING')"),
    ("REGEX", "c_name", "customer", "NOT regexp_matches(c_name, '7$')"),
    ("UNIQUE", "c_nationkey", "customer", ""),
]
C.add("rules_from_dicts", lambda s, d: _results(s, validate(_table(s, d, "customer"), [rule_from_dict(r, "customer") for r in _DICTS])), _results_sql(_DICTS_SQL))


def _rules_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:  # the driver alone writes and reads it
        path = os.path.join(folder, "rules.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"rules": _DICTS}, f)
        rules = parse_rules("customer", file=path)
    return _results(spark, validate(_table(spark, sf_dir, "customer"), rules))


C.add("rules_file", _rules_file, C.sql["rules_from_dicts"])

_BROKEN = [("customer", "c_phone"), ("customer", "C_NAME"), ("ghost", "x"), ("customer", "c_name")]
C.add(
    "prevalidation",
    lambda s, d: s.createDataFrame(
        [(t, c, "skip" if r.id in found else "run") for found, rules in [_prevalidated(s, d)] for (t, c), r in zip(_BROKEN, rules, strict=True)], "`table` string, `column` string, verdict string"
    ),
    f"""SELECT t AS "table", c AS "column", CASE WHEN column_name IS NULL THEN 'skip' ELSE 'run' END AS verdict
        FROM (VALUES {', '.join(map(str, _BROKEN))}) v(t, c) LEFT JOIN information_schema.columns ON table_name = t AND column_name = c""",
)


def _prevalidated(spark: SparkSession, sf_dir: str) -> tuple[dict[str, str], list[Rule]]:
    rules = [Rule(RuleType.NOT_NULL, Target(t, c)) for t, c in _BROKEN]
    return prevalidate({"customer": _table(spark, sf_dir, "customer")}, rules), rules


def _engine_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that can't be carried out are ERROR results of their own, the others are counted."""
    rules = [
        _rule("RANGE", "o_custkey", "fine", max=500),
        _rule("RANGE", "o_custkey", "bad_filter", max=500, filter_condition="no_such_column = 1"),
        _rule("RANGE", "o_orderdate", "not_a_number", min=1),
        _rule("NOT_NULL", "nothing", "no_column"),
        _rule("UNIQUE", "o_custkey", "copies"),
        _rule("UNIQUE", "o_custkey", "bad_copies", filter_condition="no_such_column = 1"),
    ]
    return validate(_table(spark, sf_dir, "orders"), rules).to_df(spark).select("rule_name", "status", "total_records", "failed_records")


C.add(
    "engine_errors",
    _engine_errors,
    """SELECT 'fine' AS rule_name, 'FAILED' AS status, count(*) AS total_records, count(*) FILTER (WHERE o_custkey > 500) AS failed_records FROM orders
       UNION ALL SELECT 'copies', 'FAILED', count(*), count(o_custkey) - count(DISTINCT o_custkey) FROM orders
       UNION ALL SELECT name, 'ERROR', 0, 0 FROM (VALUES ('bad_filter'), ('not_a_number'), ('no_column'), ('bad_copies')) v(name)""",
)

# Contracts.
_CONTRACT = {
    "orders": {
        "rules": [
            {"field": "o_orderkey", "type": "integer", "required": True, "desired_type": "string(4)"},
            {"field": "o_totalprice", "type": "float", "min": 0, "max": 200000, "desired_type": "integer(5)"},
            {"field": "o_orderstatus", "type": "string", "enum": ["F", "O"]},
            {"field": "o_clerk", "type": "string", "required": True, "enum": ["a"]},
            {"field": "o_custkey", "type": "string", "max": 500},
        ]
    },
    "customer": {"rules": [{"field": "C_MKTSEGMENT", "type": "string", "required": True, "desired_type": "string(8)"}, {"field": "c_acctbal", "min": 0}], "case_insensitive": True},
    "ghost": {"rules": [{"field": "x", "type": "integer", "required": True}]},
}


def _contract_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: _table(spark, sf_dir, t) for t in ("orders", "customer")}


def _contract_report(spark: SparkSession, sf_dir: str) -> Report:
    return run_contract(_contract_tables(spark, sf_dir), parse_contract(_CONTRACT))


_DONE_SQL = _results_sql(
    [
        ("NOT_NULL", "o_orderkey", "orders", "o_orderkey IS NULL"),
        ("RANGE", "o_totalprice", "orders", "o_totalprice NOT BETWEEN 0 AND 200000"),
        ("ENUM", "o_orderstatus", "orders", "o_orderstatus NOT IN ('F', 'O')"),
        ("RANGE", "o_custkey", "orders", "o_custkey > 500"),
        ("NOT_NULL", "C_MKTSEGMENT", "customer", "C_MKTSEGMENT IS NULL"),
        ("RANGE", "c_acctbal", "customer", "c_acctbal < 0"),
        ("REGEX", "o_orderkey", "orders", "length(o_orderkey::VARCHAR) > 4"),
        ("REGEX", "o_totalprice", "orders", "o_totalprice <> floor(o_totalprice) OR abs(o_totalprice) >= 100000"),
        ("REGEX", "C_MKTSEGMENT", "customer", "length(C_MKTSEGMENT) > 8"),
    ]
)
_SKIPPED_SQL = "SELECT * FROM (VALUES ('NOT_NULL', 'o_clerk', 'FIELD_MISSING'), ('ENUM', 'o_clerk', 'FIELD_MISSING'), ('NOT_NULL', 'x', 'TABLE_NOT_EXISTS')) v(kind, field, reason)"
C.add(
    "contract_run",
    lambda s, d: _results(s, _contract_report(s, d)).where("kind <> 'SCHEMA'"),
    f"SELECT * FROM ({_DONE_SQL}) UNION ALL SELECT kind, field, 'SKIPPED', 0, 0, reason FROM ({_SKIPPED_SQL})",
)
C.add(
    "contract_summary",
    lambda s, d: s.createDataFrame([(contract_exit_code(r), *(summary(r)[k] for k in ("total_rules", "skipped_rules", "error_rules", "total_records"))) for r in [_contract_report(s, d)]], "exit_code int, total_rules long, skipped_rules long, error_rules long, total_records long"),
    "SELECT 1 AS exit_code, 15::BIGINT AS total_rules, 3::BIGINT AS skipped_rules, 0::BIGINT AS error_rules, greatest((SELECT count(*) FROM orders), (SELECT count(*) FROM customer)) AS total_records",
)


def _decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas, rules, desired = decompose(parse_contract(_CONTRACT))
    rows = [(str(r.type), r.table, r.column) for r in schemas + rules] + [("DESIRED", t, f) for t, f in desired]
    return spark.createDataFrame(rows, "kind string, `table` string, field string")


C.add(
    "contract_decomposition",
    _decomposed,
    """SELECT * FROM (VALUES ('SCHEMA', 'orders', NULL), ('SCHEMA', 'customer', NULL), ('SCHEMA', 'ghost', NULL), ('NOT_NULL', 'orders', 'o_orderkey'), ('RANGE', 'orders', 'o_totalprice'),
         ('ENUM', 'orders', 'o_orderstatus'), ('NOT_NULL', 'orders', 'o_clerk'), ('ENUM', 'orders', 'o_clerk'), ('RANGE', 'orders', 'o_custkey'), ('NOT_NULL', 'customer', 'C_MKTSEGMENT'), ('RANGE', 'customer', 'c_acctbal'),
         ('NOT_NULL', 'ghost', 'x'), ('DESIRED', 'orders', 'o_orderkey'), ('DESIRED', 'orders', 'o_totalprice'), ('DESIRED', 'customer', 'C_MKTSEGMENT')) v(kind, "table", field)""",
)


def _skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas, rules, _ = decompose(parse_contract(_CONTRACT))
    reasons = skip_map(validate(_contract_tables(spark, sf_dir), schemas), rules)
    return spark.createDataFrame([(str(r.type), r.column, reasons[r.id]) for r in rules if r.id in reasons], "kind string, field string, reason string")


C.add(
    "skip_map",
    _skips,
    """SELECT kind, c AS field, CASE WHEN NOT EXISTS (SELECT 1 FROM information_schema.tables WHERE table_name = t) THEN 'TABLE_NOT_EXISTS' ELSE 'FIELD_MISSING' END AS reason
       FROM (VALUES ('NOT_NULL', 'orders', 'o_orderkey'), ('NOT_NULL', 'orders', 'o_clerk'), ('ENUM', 'orders', 'o_clerk'), ('RANGE', 'orders', 'o_custkey'), ('NOT_NULL', 'ghost', 'x')) v(kind, t, c)
       WHERE NOT EXISTS (SELECT 1 FROM information_schema.columns WHERE table_name = t AND column_name = c)""",
)
C.add(
    "contract_fields",
    lambda s, d: s.createDataFrame([(f["table"], f["column"], k, c["status"]) for f in fields(_contract_report(s, d)) for k, c in f["checks"].items() if k in ("existence", "type")], "`table` string, `column` string, what string, status string"),
    """WITH wanted(t, c, kinds) AS (VALUES ('orders', 'o_orderkey', 'INT'), ('orders', 'o_totalprice', 'DOUBLE'), ('orders', 'o_orderstatus', 'VARCHAR'), ('orders', 'o_clerk', 'VARCHAR'), ('orders', 'o_custkey', 'VARCHAR'),
         ('customer', 'C_MKTSEGMENT', 'VARCHAR'), ('ghost', 'x', 'INT')),
       found AS (SELECT t, c, kinds, data_type FROM wanted LEFT JOIN information_schema.columns ON table_name = t AND (column_name = c OR (t = 'customer' AND lower(column_name) = lower(c))))
       SELECT t AS "table", c AS "column", 'existence' AS what, CASE WHEN data_type IS NULL THEN 'FAILED' ELSE 'PASSED' END AS status FROM found
       UNION ALL SELECT t, c, 'type', CASE WHEN data_type IS NULL THEN 'SKIPPED' WHEN contains(data_type, kinds) THEN 'PASSED' ELSE 'FAILED' END FROM found""",
)


# Sources and sinks: tables are written to the shared folder and come back through read().
def _shared_folder(spark: SparkSession) -> str:
    """A folder under spark.checkpoint.dir; only where that is unset, as on one machine, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        named = tempfile.mkdtemp(prefix="assaykit-sources-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return f"{named.rstrip('/')}/sources-{uuid.uuid4()}"


_NOTE = "concat(s_name, ', \"', s_suppkey, '\"', chr(10), 'second line')"


def _source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with separators, quotes and line breaks, from a folder of files."""
    path = f"{_shared_folder(spark)}/suppliers.csv"
    _table(spark, sf_dir, "supplier", note=_NOTE).write.csv(path, header=True, escape='"')
    return readers.read(spark, _source(path), "suppliers")["suppliers"]


def _source(path: str) -> readers.Source:
    """A folder in whatever store: only local paths are looked up by parse_source()."""
    suffix = path[path.rindex(".") :]
    return readers.Source(readers.EXTENSIONS[suffix], path, "suppliers")


C.add("source_csv", _source_csv, f"SELECT *, {_NOTE} AS note FROM supplier")


def _source_written(form: str, suffix: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{_shared_folder(spark)}/suppliers{suffix}"
        readers.write_results(_table(spark, sf_dir, "supplier", note=_NOTE), path, form)
        return readers.read(spark, _source(path))["suppliers"].select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"), "s_acctbal", "note")

    return query


for _name, _form, _suffix in (("source_jsonl", "json", ".jsonl"), ("source_parquet", "parquet", ".parquet")):
    C.add(_name, _source_written(_form, _suffix), f"SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal, {_NOTE} AS note FROM supplier")


def _source_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [tuple(r) for r in _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]
    with tempfile.TemporaryDirectory() as folder:  # the driver alone writes and reads it
        path = os.path.join(folder, "nations.db")
        with sqlite3.connect(path) as db:
            db.execute("CREATE TABLE nations (n_nationkey INTEGER, n_name VARCHAR(25), n_regionkey INTEGER)")
            db.executemany("INSERT INTO nations VALUES (?, ?, ?)", rows)
        db.close()
        return readers.read(spark, f"sqlite:///{path}", "nations")["nations"].select("n_nationkey", F.col("n_name").cast("string").alias("n_name"), "n_regionkey")


C.add("source_sqlite", _source_sqlite, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")


def _sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_shared_folder(spark)}/results.parquet"
    report = validate(_table(spark, sf_dir, "lineitem", **_LINE), [r for r, _ in FLAGSHIP])
    readers.write_results(report.to_df(spark), path)
    return spark.read.parquet(path).select(F.col("rule_name").alias("rule"), "total_records", "failed_records", "status")


C.add("results_sink", _sink, C.sql["rules_fused_lineitem"])
C.add(
    "execute_query",
    lambda s, d: s.createDataFrame(readers.execute_query(s, "SELECT o_orderstatus, count(*) AS n, sum(o_custkey) AS keys FROM orders_of_query GROUP BY o_orderstatus", orders_of_query=_table(s, d, "orders")), "o_orderstatus string, n long, keys long"),
    "SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY o_orderstatus",
)
C.add(
    "count_and_page",
    lambda s, d: readers.page(_table(s, d, "nation").orderBy("n_nationkey"), 5, 10).select("n_nationkey", "n_name", F.lit(readers.count_rows(_table(s, d, "nation"), "n_regionkey = 1")).cast("long").alias("in_region")),
    "SELECT n_nationkey, n_name, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS in_region FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 10",
)
C.add(
    "list_columns",
    lambda s, d: s.createDataFrame([(t, c["name"], readers.column_exists(_table(s, d, t), c["name"].upper())) for t in ("orders", "events") for c in readers.list_columns(_table(s, d, t))], "`table` string, name string, found boolean"),
    """SELECT table_name AS "table", column_name AS name, true AS found FROM information_schema.columns WHERE table_name IN ('orders', 'events')""",
)


def queries() -> dict[str, Query]:
    return dict(C.queries)


def oracle_sql() -> dict[str, str]:
    return dict(C.sql)
