"""Types, compatibility, parsers and contracts."""

import json

import pytest

from assaykit.errors import ContractError, RuleError
from assaykit.model import Rule, RuleType, Settings, Severity, Status, Target
from assaykit.operators.contract_run import run_contract
from assaykit.operators.engine import validate
from assaykit.operators.report import check_exit_code, check_text, contract_exit_code, contract_json, contract_text, fields, summary
from assaykit.operators.schema_check import check_fields
from assaykit.plans.compat import COMPATIBLE, CONFLICTING, INCOMPATIBLE, analyse, desired_rule
from assaykit.plans.contract import parse_contract, read_contract
from assaykit.plans.parse import merge_parameters, parse_inline, parse_rules, read_rules, rule_from_dict
from assaykit.plans.types import TypeInfo, desired_metadata, detailed, from_spark, from_vendor, parse_type


@pytest.mark.parametrize(("text", "want"), [("string(20)", TypeInfo("STRING", max_length=20)), (" INT(4) ", TypeInfo("INTEGER", max_digits=4)), ("float(5, 2)", TypeInfo("FLOAT", precision=5, scale=2)), ("date('YYYY-MM-DD')", TypeInfo("DATE", format="YYYY-MM-DD")), ("datetime('HH:MI:SS')", TypeInfo("DATETIME", format="HH:MI:SS")), ("Bool", TypeInfo("BOOLEAN")), ({"type": "date", "format": "YYYY-MM-DD"}, TypeInfo("DATE", format="YYYY-MM-DD")), ({"type": "int", "max_digits": 3}, TypeInfo("INTEGER", max_digits=3))])
def test_types(text, want):
    assert parse_type(text) == want


@pytest.mark.parametrize("text", ["", "text", "string(0)", "string(10,50)", "int(-1)", "float(2,3)", "float(0,0)", "date('')", 5, {"type": "nope"}, {"type": "string", "precision": 3}, {"type": "integer", "max_length": 3}])
def test_bad_types(text):
    with pytest.raises(RuleError):
        parse_type(text)


def test_type_forms():
    assert detailed("float(5,2)") == {"type": "float", "precision": 5, "scale": 2} and desired_metadata("string(3)") == {"desired_type": "STRING", "desired_max_length": 3}
    assert from_vendor("varchar(12)") == TypeInfo("STRING", max_length=12) and from_vendor("DECIMAL(10,2)") == TypeInfo("FLOAT", precision=10, scale=2)
    assert from_vendor("CHARACTER VARYING").type == "STRING" and from_vendor("timestamp with time zone").type == "DATETIME" and from_vendor("tinyint(1)").type == "INTEGER" and from_vendor("json").type is None


def test_spark_types(spark):
    df = spark.sql("SELECT 1 a, 1L b, 1.5D c, CAST(1 AS DECIMAL(5,2)) d, true e, DATE'2020-01-01' f, TIMESTAMP'2020-01-01' g, 'x' h, array(1) i, X'00' j")
    assert [from_spark(f).type for f in df.schema.fields] == ["INTEGER", "INTEGER", "FLOAT", "FLOAT", "BOOLEAN", "DATE", "DATETIME", "STRING", None, None]
    spark.sql("CREATE TABLE IF NOT EXISTS sized (v VARCHAR(12), c CHAR(3)) USING parquet")
    assert [from_spark(f).max_length for f in spark.table("sized").schema.fields] == [12, 3]
    spark.sql("DROP TABLE sized")


@pytest.mark.parametrize(
    ("native", "desired", "verdict", "kind"),
    [
        (TypeInfo("STRING"), "string", COMPATIBLE, None),
        (TypeInfo("STRING", max_length=10), "string(10)", COMPATIBLE, None),
        (TypeInfo("STRING", max_length=11), "string(10)", INCOMPATIBLE, "LENGTH"),
        (TypeInfo("STRING"), "string(10)", INCOMPATIBLE, "LENGTH"),
        (TypeInfo("STRING"), "integer", INCOMPATIBLE, "REGEX"),
        (TypeInfo("STRING"), "date", INCOMPATIBLE, "DATE_FORMAT"),
        (TypeInfo("STRING"), "boolean", CONFLICTING, None),
        (TypeInfo("INTEGER"), "integer(3)", INCOMPATIBLE, "REGEX"),
        (TypeInfo("INTEGER"), "float", COMPATIBLE, None),
        (TypeInfo("INTEGER"), "float(5,2)", INCOMPATIBLE, "REGEX"),
        (TypeInfo("INTEGER"), "float(2,2)", COMPATIBLE, None),
        (TypeInfo("INTEGER"), "string(3)", INCOMPATIBLE, "LENGTH"),
        (TypeInfo("FLOAT", precision=4, scale=1), "float(5,2)", INCOMPATIBLE, "REGEX"),
        (TypeInfo("FLOAT"), "date", CONFLICTING, None),
        (TypeInfo("DATE"), "datetime", COMPATIBLE, None),
        (TypeInfo("DATETIME"), "integer", CONFLICTING, None),
        (TypeInfo("BOOLEAN"), "boolean", COMPATIBLE, None),
        (TypeInfo(None), "string", CONFLICTING, None),
    ],
)
def test_compatibility(native, desired, verdict, kind):
    found = analyse(native, parse_type(desired))
    assert (found.verdict, found.kind) == (verdict, kind)


def test_desired_rules():
    assert desired_rule("t", "c", TypeInfo("INTEGER"), "float") is None
    r = desired_rule("t", "c", TypeInfo("INTEGER"), "date")
    assert r.type == RuleType.DATE_FORMAT and r.pattern == "YYYYMMDD" and r.name == "desired_type_date_c"
    assert desired_rule("t", "c", TypeInfo("STRING"), "float(4,1)").parameters["validation_type"] == "float_precision"
    with pytest.raises(ContractError):
        desired_rule("t", "c", TypeInfo("DATE"), "integer")


@pytest.mark.parametrize(
    ("text", "kind", "column", "parameters"),
    [
        ("not_null(id)", "NOT_NULL", "id", {}),
        ("  UNIQUE( \"email\" ) ", "UNIQUE", "email", {}),
        ("length(name,2,50)", "LENGTH", "name", {"min_length": 2, "max_length": 50}),
        ("length(name,2)", "LENGTH", "name", {"min_length": 2}),
        ("range(age,0,120)", "RANGE", "age", {"min": 0.0, "max": 120.0}),
        ("range(age,,5)", "RANGE", "age", {"max": 5.0}),
        ("enum(s,a,1,2.5,'b')", "ENUM", "s", {"allowed_values": ["a", 1, 2.5, "b"]}),
        (r"regex(email,^[a-z]{2,3}@x\.com$)", "REGEX", "email", {"pattern": r"^[a-z]{2,3}@x\.com$"}),
        ("regex(c,(a|b),c)", "REGEX", "c", {"pattern": "(a|b),c"}),
        ("date_format(d,YYYY-MM-DD)", "DATE_FORMAT", "d", {"format_pattern": "YYYY-MM-DD", "format": "YYYY-MM-DD"}),
    ],
)
def test_inline_rules(text, kind, column, parameters):
    r = parse_inline(text, "t")
    assert (str(r.type), r.column, r.parameters, r.table) == (kind, column, parameters, "t")


@pytest.mark.parametrize("text", ["", "id", "nope(id)", "not_null()", "length(a)", "length(a,x)", "length(a,5,2)", "length(a,-1)", "range(a,9,1)", "range(a,x)", "enum(a)", "regex(a)", "regex(a,[)", "date_format(d)", "schema(a)"])
def test_bad_inline_rules(text):
    with pytest.raises(RuleError):
        parse_inline(text, "t")


def test_rule_files(tmp_path):
    nested = {"rules": [{"name": "n", "type": "REGEX", "column": "c", "parameters": {"pattern": "a"}, "severity": "WARNING"}, {"type": "enum", "column": "c", "values": [1]}, {"type": "RANGE", "column": "c", "min": 0, "max": 5, "filter_condition": "x = 1"}]}
    (tmp_path / "a.json").write_text(json.dumps(nested))
    (tmp_path / "b.json").write_text(json.dumps(nested["rules"]))
    (tmp_path / "c.json").write_text("{")
    a = read_rules(tmp_path / "a.json", "t")
    assert [r.parameters for r in a] == [{"pattern": "a"}, {"allowed_values": [1]}, {"min": 0, "max": 5, "filter_condition": "x = 1"}] and a[0].severity == Severity.MEDIUM
    assert len(read_rules(tmp_path / "b.json", "t")) == 3 and len(parse_rules("t", ["not_null(x)"], tmp_path / "a.json")) == 4
    with pytest.raises(RuleError):
        read_rules(tmp_path / "c.json", "t")
    with pytest.raises(RuleError):
        parse_rules("t")


def test_dict_rules():
    r = rule_from_dict({"type": "NOT_NULL", "target": "d.t.c", "id": "7", "severity": "high", "action": "block"})
    assert (r.target, r.id, r.severity.priority, str(r.action)) == (Target("t", "c", "d"), "7", 3, "BLOCK")
    assert rule_from_dict({"rule_type": "range", "table_name": "t", "column_name": "c", "min_value": 1}).bound("min") == 1
    assert rule_from_dict({"type": "unique", "target": {"entities": [{"database": "d", "table": "t", "column": "c"}]}}).table == "t"
    assert merge_parameters({"a": 1, "b": 2}, None, {"a": None, "b": 3}) == {"a": 1, "b": 3}
    for wrong in ({"type": "x"}, {"type": "NOT_NULL", "column": "c"}, {"type": "NOT_NULL", "table": "t"}, "not_null"):
        with pytest.raises(RuleError):
            rule_from_dict(wrong)


@pytest.mark.parametrize("parameters", [{}, {"min": 5, "max": 1}, {"min": "x"}, {"min": True}])
def test_bad_parameters(parameters):
    with pytest.raises(RuleError):
        Rule(RuleType.RANGE, Target("t", "c"), parameters)


@pytest.mark.parametrize("want", [{"expected_type": "TEXT"}, {"expected_type": "INTEGER", "max_length": 5}, {"expected_type": "STRING", "max_length": 0}, {"expected_type": "FLOAT", "precision": 99}, {"expected_type": "FLOAT", "precision": 2, "scale": 3}])
def test_bad_schema_rules(want):
    with pytest.raises(RuleError):
        Rule(RuleType.SCHEMA, Target("t"), {"columns": {"c": want}})


def test_schema_check(spark):
    df = spark.sql("SELECT 1 AS id, CAST(1 AS DECIMAL(10,2)) AS price, 'x' AS Name, array(1) AS a")
    want = {"id": {"expected_type": "INTEGER"}, "price": {"expected_type": "FLOAT", "precision": 10, "scale": 3}, "name": {"expected_type": "STRING"}, "a": {"expected_type": "STRING"}}
    checks, extras = check_fields(df.schema, want, strict=True)
    assert [c.failure_code for c in checks] == ["NONE", "METADATA_MISMATCH", "FIELD_MISSING", "TYPE_MISMATCH"] and extras == ["Name"]
    checks, extras = check_fields(df.schema, want, strict=True, case_insensitive=True)
    assert checks[2].failure_code == "NONE" and extras == []
    r = validate({"t": df}, [Rule(RuleType.SCHEMA, Target("t"), {"columns": want, "strict_mode": True})]).results[0]
    assert (r.total_records, r.failed_records, r.status) == (4, 4, Status.FAILED)


CONTRACT = {
    "users": {"rules": [{"field": "id", "type": "integer", "required": True}, {"field": "age", "type": "integer", "min": 0, "max": 120, "desired_type": "integer(2)"}, {"field": "name", "type": "string", "desired_type": "string(5)"}, {"field": "gone", "type": "string", "required": True, "desired_type": "string(1)"}, {"field": "kind", "type": "float", "enum": ["a"]}], "strict_mode": True},
    "orders": {"rules": [{"field": "ID", "type": "integer"}, {"field": "day", "desired_type": "date('YYYYMMDD')"}, {"field": "name", "type": "string", "desired_type": "string(20)"}], "case_insensitive": True},
    "missing": {"rules": [{"field": "x", "type": "string", "required": True}]},
}


@pytest.fixture(scope="module")
def tables(spark):
    users = spark.createDataFrame([(1, 25, "Ann", "a", 1), (2, 130, "Benjamin", "b", 1), (None, 5, None, None, 1)], "id int, age int, name string, kind string, extra int")
    orders = spark.createDataFrame([(1, "20240229", "x" * 10), (2, "20230229", "y")], "id int, day string, name string")
    return {"users": users, "orders": orders}


def test_contract_run(tables):
    report = run_contract(tables, parse_contract(CONTRACT))
    assert {(r.rule.table, r.rule.name): (str(r.status), r.failed_records) for r in report} == {
        ("users", "schema_users"): ("FAILED", 3),
        ("orders", "schema_orders"): ("PASSED", 0),
        ("missing", "schema_missing"): ("FAILED", 1),
        ("users", "not_null_id"): ("FAILED", 1),
        ("users", "range_age"): ("FAILED", 1),
        ("users", "not_null_gone"): ("SKIPPED", 0),
        ("users", "enum_kind"): ("FAILED", 1),
        ("missing", "not_null_x"): ("SKIPPED", 0),
        ("users", "desired_type_regex_age"): ("FAILED", 1),
        ("users", "desired_type_length_name"): ("FAILED", 1),
        ("orders", "desired_type_date_day"): ("FAILED", 1),
        ("orders", "desired_type_length_name"): ("PASSED", 0),
    }
    assert {r.rule.name: r.skip_reason for r in report.of_status(Status.SKIPPED)} == {"not_null_gone": "FIELD_MISSING", "not_null_x": "TABLE_NOT_EXISTS"}
    found = {(f["table"], f["column"]): f["checks"] for f in fields(report)}
    assert found["users", "age"]["desired_type"] == {"status": "FAILED", "failed_records": 1} and found["users", "gone"]["not_null"]["skip_reason"] == "FIELD_MISSING"
    payload = json.loads(contract_json(report, "src", "rules.json"))
    assert payload["status"] == "ok" and payload["rules_count"] == 12 and payload["schema_extras"] == ["extra"] and payload["summary"]["skipped_rules"] == 2
    text = contract_text(report, "src")
    assert "gone: missing" in text and "extra columns: extra" in text and "desired_type (1 failures)" in text
    assert contract_exit_code(report) == 1


def test_passing_contract_and_exit_codes(tables):
    report = run_contract(tables, parse_contract({"rules": [{"field": "id", "type": "integer"}]}, "users"))
    assert report.passed and contract_exit_code(report) == 0 and contract_exit_code(report, fail_on_error=True) == 1
    check = validate(tables, [Rule(RuleType.NOT_NULL, Target("users", "nope")), Rule(RuleType.NOT_NULL, Target("users", "extra"))])
    assert check_exit_code(check) == 8 and "column nope not found" in check_text(check, "s") and summary(check)["error_rules"] == 1
    assert check_exit_code(validate(tables, [Rule(RuleType.NOT_NULL, Target("none", "x"))])) == 7
    failed = validate(tables, [Rule(RuleType.NOT_NULL, Target("users", "id"))], settings=Settings(sample_rows=1))
    assert check_exit_code(failed) == 1 and '"age": 5' in check_text(failed, "s", verbose=True) and "\n" not in check_text(failed, "s", quiet=True)


def test_conflicting_desired_type_raises(spark):
    with pytest.raises(ContractError):
        run_contract({"t": spark.sql("SELECT true AS b")}, parse_contract({"t": {"rules": [{"field": "b", "type": "boolean", "desired_type": "integer"}]}}))


@pytest.mark.parametrize("payload", [[], {}, {"t": []}, {"t": {"rules": 1}}, {"rules": [1]}, {"rules": [{"type": "string"}]}, {"rules": [{"field": "a", "type": "nope"}]}, {"rules": [{"field": "a", "enum": []}]}, {"rules": [{"field": "a", "min": "x"}]}, {"rules": [{"field": "a", "type": "integer", "max_length": 3}]}, {"rules": [{"field": "a", "required": "yes"}]}, {"t": {"rules": [], "strict_mode": "yes"}}])
def test_bad_contracts(payload):
    with pytest.raises(ContractError):
        parse_contract(payload)


def test_contract_files(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"t": {"rules": [{"field": "a", "type": "string(5)", "colour": 1}]}}))
    c = read_contract(tmp_path / "c.json")
    assert c.fields == 1 and "colour" in c.warnings[0]
    (tmp_path / "d.json").write_text("nope")
    with pytest.raises(ContractError):
        read_contract(tmp_path / "d.json")
