"""Counts, statuses and samples of whole runs; fused and single runs must agree."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assaykit.model import Report, Result, Rule, RuleType, Settings, Severity, Status, Target
from assaykit.operators import engine
from assaykit.operators.engine import prevalidate, quarantine, validate
from assaykit.plans.compat import desired_rule
from assaykit.plans.fusion import date_failure_samples, duplicates, rule_counts, unique_rows
from assaykit.plans.types import TypeInfo

PEOPLE = [(1, "Alice", "alice@example.com", 25, "active"), (2, None, "bob@example.com", 30, "active"), (3, "Charlie", "charlie@example.com", -5, "inactive"), (4, "Diana", "alice@example.com", 35, "active"), (5, "Eve", "eve@example.com", 150, "active")]


def rule(kind, column, **p):
    return Rule(RuleType(kind), Target("people", column), p)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "id int, name string, email string, age int, status string")


def test_golden_counts(people):
    report = validate({"people": people}, [rule("NOT_NULL", "name"), rule("RANGE", "age", min=0, max=120), rule("UNIQUE", "email")])
    assert [(r.status, r.total_records, r.failed_records) for r in report] == [(Status.FAILED, 5, 1), (Status.FAILED, 5, 2), (Status.FAILED, 5, 1)]
    assert [s["id"] for s in report["not_null_name"].sample_data] == [2]
    assert report["unique_email"].sample_data == [{"value": "alice@example.com", "duplicate_count": 2}]
    assert report["unique_email"].details["duplicate_values"] == 1
    assert report["not_null_name"].message == "NOT_NULL check completed, found 1 null records" and not report.passed


def test_filters_restrict_both_counts(people):
    rules = [rule("RANGE", "age", max=28, filter_condition="status = 'active'"), rule("NOT_NULL", "id"), rule("UNIQUE", "email", filter_condition="id < 4")]
    report = validate(people, rules)
    assert [(r.total_records, r.failed_records) for r in report] == [(4, 3), (5, 0), (3, 0)]
    same = validate(people, [rule("RANGE", "age", max=28, filter_condition="status = 'active'"), rule("NOT_NULL", "name", filter_condition="status = 'active'")])
    assert [(r.total_records, r.failed_records) for r in same] == [(4, 3), (4, 1)]
    assert all(s["status"] == "active" for s in same.results[0].sample_data)


def test_missing_tables_and_columns_do_not_spoil_the_rest(people):
    rules = [rule("NOT_NULL", "nope"), Rule(RuleType.NOT_NULL, Target("gone", "x")), rule("NOT_NULL", "id"), rule("RANGE", "age", max=1, filter_condition="no_such_column = 1"), rule("NOT_NULL", "ID")]
    report = validate({"people": people}, rules)
    assert [r.status for r in report] == [Status.ERROR, Status.ERROR, Status.PASSED, Status.ERROR, Status.ERROR]
    assert report.results[1].error_message == "table gone not found" and set(prevalidate({"people": people}, rules)) == {rules[0].id, rules[1].id, rules[4].id}


def test_a_rule_that_fails_at_run_time_errs_alone(people):
    report = validate(people, [rule("RANGE", "status", max=3), rule("NOT_NULL", "id", filter_condition="1 / (id - 1) > 0"), rule("NOT_NULL", "name")])
    assert [r.status for r in report] == [Status.FAILED, Status.ERROR, Status.FAILED]


def test_empty_table_passes(people):
    report = validate(people.limit(0), [rule("NOT_NULL", "name"), rule("UNIQUE", "email"), rule("RANGE", "age", min=0)])
    assert all(r.status == Status.PASSED and r.total_records == 0 and r.success_rate == 1.0 and r.error_rate == 0.0 for r in report)


def test_samples_are_bounded_ordered_and_optional(spark):
    df = spark.range(100)
    r = Rule(RuleType.RANGE, Target("t", "id"), {"max": 9})
    assert [s["id"] for s in validate(df, [r], order_by=["id"]).results[0].sample_data] == [10, 11, 12, 13, 14]
    assert validate(df, [r], settings=Settings(sample_data=False)).results[0].sample_data is None
    assert len(validate(df, [r], settings=Settings(sample_rows=2)).results[0].sample_data) == 2


def test_many_rules_in_several_scans(spark):
    df = spark.range(50)
    rules = [Rule(RuleType.RANGE, Target("t", "id"), {"min": i}, name=f"r{i}") for i in range(30)]
    report = validate(df, rules, settings=Settings(most_expressions=10, sample_data=False))
    assert [r.failed_records for r in report] == list(range(30)) and {r.details["fused_rules"] for r in report} == {5}


def test_one_scan_for_all_row_rules(people):
    row_rules = [rule("NOT_NULL", "name"), rule("RANGE", "age", min=0), rule("REGEX", "email", pattern="@")]
    plan = rule_counts(people, row_rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Expand" not in rule_counts(people, [rule("UNIQUE", "name"), rule("UNIQUE", "email")])._jdf.queryExecution().optimizedPlan().toString()


def test_quarantine_agrees_with_counts(people):
    rules = [rule("NOT_NULL", "name"), rule("RANGE", "age", min=0, max=120, filter_condition="id > 3")]
    good, broken = quarantine(people, rules)
    assert {r["id"]: r["broken_rules"] for r in broken.collect()} == {2: ["not_null_name"], 5: ["range_age"]} and good.count() == 3 and good.columns == people.columns


def test_inactive_rules_do_not_run(people):
    assert len(validate(people, [Rule(RuleType.NOT_NULL, Target("people", "name"), is_active=False)])) == 0


def test_date_samples_show_both_kinds_of_failure(spark):
    df = spark.createDataFrame([(v,) for v in ["x", "y", "z", "2023-02-30", "2023-02-31", "2023-13-01", "2023-01-01"]], "d string")
    got = [r["d"] for r in date_failure_samples(df, Rule(RuleType.DATE_FORMAT, Target("t", "d"), {"format_pattern": "YYYY-MM-DD"}), 4).collect()]
    assert len(got) == 4 and sum(g in "xyz" for g in got) == 2


_VALUES = st.lists(st.one_of(st.none(), st.sampled_from(["a", "bb", "", "2023-01-01", "2023-02-30", "5", "é"])), max_size=12)
_RULES = [
    rule("NOT_NULL", "v"), rule("LENGTH", "v", min_length=1, max_length=2), rule("ENUM", "v", allowed_values=["a", 5]), rule("REGEX", "v", pattern="^[a-z]*$"),
    rule("DATE_FORMAT", "v", format_pattern="YYYY-MM-DD"), rule("RANGE", "v", min=0, max=9), rule("NOT_NULL", "v", filter_condition="i % 2 = 0"), rule("UNIQUE", "v"),
]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_VALUES)
def test_fused_equals_individual(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    rules = [Rule(r.type, r.target, r.parameters, name=f"r{k}") for k, r in enumerate(_RULES)]
    together = [(r.total_records, r.failed_records, r.status) for r in validate(df, rules)]
    alone = [(r.total_records, r.failed_records, r.status) for x in rules for r in validate(df, [x])]
    assert together == alone
    for (total, failed, status), r in zip(together, validate(df, rules), strict=True):
        assert 0 <= failed <= total and (status == Status.PASSED) == (failed == 0) == (not r.sample_data)
    given_values = [v for v in values if v is not None]
    assert together[-1][1] == len(given_values) - len(set(given_values)) == duplicates(df, rules[-1]).agg(F.coalesce(F.sum(F.col("duplicate_count") - 1), F.lit(0))).first()[0]


def test_report_as_dataframe(spark, people):
    report = validate(people, [rule("NOT_NULL", "name"), rule("NOT_NULL", "id")])
    df = report.to_df(spark)
    assert [tuple(r) for r in df.select("rule_name", "status", "failed_records").collect()] == [("not_null_name", "FAILED", 1), ("not_null_id", "PASSED", 0)]
    assert '"id": 2' in df.first()["sample_data"][0]


def test_model():
    r = rule("NOT_NULL", "name")
    assert Status.PENDING.may_become(Status.RUNNING) and not Status.PASSED.may_become(Status.RUNNING) and Status.FAILED.final
    assert Severity.of("nonsense") == Severity.MEDIUM and Severity.of("high").priority == 3
    assert Target.parse("d.t.c") == Target("t", "c", "d") and str(Target("t", "c")) == "t.c"
    assert Result.error(r, "x").failed_records == 0 and Result.skipped(r, "FIELD_MISSING").status == Status.SKIPPED
    assert r.to_dict()["category"] == "COMPLETENESS" and len(Report([])) == 0


def test_a_rule_that_fails_at_run_time_does_not_touch_the_others(people):
    bad = rule("RANGE", "age", min=0, filter_condition="cast(name AS int) > 0")
    report = validate(people, [rule("NOT_NULL", "name"), bad, rule("UNIQUE", "email"), rule("UNIQUE", "age", filter_condition="cast(name AS int) > 0"), rule("UNIQUE", "status")])
    assert [r.status for r in report] == [Status.FAILED, Status.ERROR, Status.FAILED, Status.ERROR, Status.FAILED]


def test_faults_of_the_cluster_are_raised(people, monkeypatch):
    """A lost connection or executor is no rule's fault: no half of the rules is tried again."""
    calls = []

    def lost(df, rules, registry=None):
        calls.append(len(rules))
        raise PySparkException("executor lost")

    monkeypatch.setattr(engine, "fused_row", lost)
    with pytest.raises(PySparkException):
        validate(people, [rule("NOT_NULL", "name"), rule("NOT_NULL", "age")])
    assert calls == [2]


def test_unique_rules_are_one_plan(people):
    plan = unique_rows(people, [rule("UNIQUE", c) for c in ("id", "name", "email")])
    assert [(r["k"], r["total_0"], r["failed_0"]) for r in plan.orderBy("k").collect()] == [(0, 5, 0), (1, 5, 0), (2, 5, 1)]


def test_blank_dates_and_digits_of_texts(spark):
    df = spark.createDataFrame([(v,) for v in ["2023-01-01", " ", "\t", "\n \t", "", None, "2023-1-1"]], "d string")
    assert validate(df, [Rule(RuleType.DATE_FORMAT, Target("t", "d"), {"format_pattern": "YYYY-MM-DD"})]).results[0].failed_records == 1
    df = spark.createDataFrame([(v,) for v in ["12", "-99", "007", "123", "12.0", "", None, "-000", "abc"]], "v string")
    assert validate(df, [desired_rule("t", "v", TypeInfo("STRING"), "integer(2)")]).results[0].failed_records == 4
