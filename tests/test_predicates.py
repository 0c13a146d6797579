"""Truth tables of each rule's predicate, and of nulls in it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assaykit.errors import RuleError
from assaykit.functions import formats
from assaykit.functions import predicates as P
from assaykit.functions.scalars import DATE_FUNCTIONS, full_name, quote_text, register
from assaykit.model import Rule, RuleType, Target
from assaykit.plans.registry import REGISTRY


def bad(spark, rule_type, kind, values, **parameters):
    """The values that violate, by place."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    rule = Rule(RuleType(rule_type), Target("t", "c"), parameters)
    return sorted(r["i"] for r in df.where(F.coalesce(P.violation(rule, df.schema), F.lit(False))).collect())


def test_not_null(spark):
    assert bad(spark, "NOT_NULL", "string", ["a", None, "", " "]) == [1]


@pytest.mark.parametrize(("parameters", "want"), [({"min_length": 2}, [0, 3, 4]), ({"max_length": 2}, [2, 3]), ({"exact_length": 4}, [0, 1, 3, 4]), ({"min_length": 0}, [3])])
def test_length_counts_characters_and_null_fails(spark, parameters, want):
    assert bad(spark, "LENGTH", "string", ["é", "ab", "café", None, ""], **parameters) == want


def test_length_of_numbers(spark):
    assert bad(spark, "LENGTH", "double", [1.0, 12.5, 1e7, None], max_length=4) == [2, 3]
    assert bad(spark, "LENGTH", "int", [1, 12345], max_length=4) == [1]


def test_range(spark):
    values = [0, 1, 120, 121, -1, None]
    assert bad(spark, "RANGE", "int", values, min=0, max=120) == [3, 4, 5]
    assert bad(spark, "RANGE", "int", values, min_value=0) == [4, 5]
    assert bad(spark, "RANGE", "int", values, max_value=0) == [1, 2, 3, 5]
    assert bad(spark, "RANGE", "string", ["5", "x", " 7 ", None, "500"], min=0, max=120) == [1, 3, 4]
    with pytest.raises(RuleError):
        bad(spark, "RANGE", "date", [dt.date(2020, 1, 1)], min=0)


def test_enum(spark):
    assert bad(spark, "ENUM", "string", ["a", "b", None, "A"], allowed_values=["a"]) == [1, 3]
    assert bad(spark, "ENUM", "int", [0, 1, 3, None], allowed_values=[0, "1"]) == [2]
    assert bad(spark, "ENUM", "int", [0, 1, 3], allowed_values=[0, "x"]) == [1, 2]
    assert bad(spark, "ENUM", "boolean", [True, False, None], allowed_values=["true"]) == [1]
    assert bad(spark, "ENUM", "double", [1.0, 2.5], allowed_values=[1]) == [1]
    assert bad(spark, "ENUM", "string", ["x@a.com", "y@b.com", "x@b.com@a.com", "none", None], allowed_values=["a.com"], extract_domain=True) == [1]


def test_regex_searches(spark):
    assert bad(spark, "REGEX", "string", ["xaz", "z", None, ""], pattern="a") == [1, 3]
    assert bad(spark, "REGEX", "double", [10000000.0, 0.5, 12.0], pattern=r"^1\d*\.0$") == [1]


@pytest.mark.parametrize(
    ("fmt", "good", "wrong"),
    [
        ("YYYY-MM-DD", ["2023-12-25", "2024-02-29", " ", ""], ["2023-02-31", "not-a-date", "2023-13-01", "2023-1-05", "12023-01-01", "2023-12-25 10:00"]),
        ("MM/DD/YYYY", ["12/25/2023"], ["2023-12-25", "13/01/2023"]),
        ("yyyymmdd", ["20240229"], ["20230229", "2024-02-29"]),
        ("HH:MI:SS", ["12:13:14", "00:00:00"], ["14:15:78", "25:17:18", "24:00:00"]),
        ("%Y-%m-%d", ["2023-12-25"], ["2023-02-31"]),
        ("YYYY-MM-DDTHH:MI:SS", ["2023-12-25T01:02:03"], ["2023-12-25 01:02:03"]),
        ("MMDD", ["0228"], ["0229", "1301"]),
        ("DD-MMM-YYYY", ["25-Dec-2023"], ["25-12-2023"]),
    ],
)
def test_date_formats(spark, fmt, good, wrong):
    assert bad(spark, "DATE_FORMAT", "string", [*good, *wrong, None], format_pattern=fmt) == list(range(len(good), len(good) + len(wrong)))


def test_golden_dates(spark):
    dates = ["2020-02-29", "2019-11-22", "2021-02-29", "2021-04-31", "2011-01-05", "2024-13-06"]
    times = ["12:13:14", "12:00:00", "14:15:78", "15:16:17", "25:17:18", "12:00:00"]
    births = [19680223, 19780230, 19680630, 19610631, 19680701]
    assert len(bad(spark, "DATE_FORMAT", "string", dates, format_pattern="YYYY-MM-DD")) == 3
    assert len(bad(spark, "DATE_FORMAT", "string", times, format_pattern="HH:MI:SS")) == 2
    assert len(bad(spark, "DATE_FORMAT", "int", births, format_pattern="YYYYMMDD")) == 2


def desired(spark, kind, values, **parameters):
    return bad(spark, "REGEX", kind, values, **parameters)


def test_integer_digits(spark):
    values = ["12", "-99", "100", "1.0", "1.5", "abc", "", None, "inf", "nan"]
    assert desired(spark, "string", values, validation_type="integer_digits", max_digits=2) == [2, 4, 5, 6, 8, 9]
    assert desired(spark, "int", [1, 99, 0, -1, -99, 123, 9999, -123, 99, 100, None], validation_type="integer_digits", max_digits=2) == [5, 6, 7, 9]
    assert desired(spark, "double", [89.0, 999.99, 123.45, float("nan"), None], validation_type="integer_digits", max_digits=2) == [1, 2, 3]
    assert desired(spark, "bigint", [10**17, 10**18], validation_type="integer_digits", max_digits=18) == [1]


@pytest.mark.parametrize(("value", "p", "s", "valid"), [(999.9, 4, 1, True), (1000.0, 4, 1, False), (99.99, 4, 1, False), (0.9, 1, 1, True), (1.0, 1, 1, False), (123.45, 5, 2, True), (1234.56, 5, 2, False), (123.456, 5, 2, False), (-999.9, 4, 1, True), (0.0, 1, 1, True), (1e20, 5, 2, False)])
def test_float_precision(spark, value, p, s, valid):
    for kind, v in (("double", value), ("string", str(value))):
        assert (desired(spark, kind, [v], validation_type="float_precision", precision=p, scale=s) == []) == valid


def test_float_precision_of_other_values(spark):
    assert desired(spark, "string", ["abc", None, "5", "12345"], validation_type="float_precision", precision=4, scale=1) == [0, 3]
    df = spark.sql("SELECT 0 AS i, CAST('10.00' AS DECIMAL(10,2)) AS c UNION ALL SELECT 1, CAST('10.05' AS DECIMAL(10,2)) UNION ALL SELECT 2, CAST('-1000.10' AS DECIMAL(10,2))")
    rule = Rule(RuleType.REGEX, Target("t", "c"), {"validation_type": "float_precision", "precision": 4, "scale": 1})
    assert sorted(r["i"] for r in df.where(P.violation(rule, df.schema)).collect()) == [1, 2]


def test_string_length_and_whole_numbers(spark):
    assert desired(spark, "string", ["", "1234567890", "12345678901", None], validation_type="string_length", max_length=10) == [2]
    assert desired(spark, "string", ["abc\n"], validation_type="string_length", max_length=3) == [0]
    assert desired(spark, "double", [42.0, 42.5, -1.0, 1e18, None, float("inf")], validation_type="integer_like_float") == [1, 5]


def test_canonical_text(spark):
    df = spark.createDataFrame([(v,) for v in (1e7, 123456789.123, 0.5, -2.0, 0.0, 1e20, 1e-7)], "c double")
    got = [r[0] for r in df.select(P.canonical_text(F.col("c"), df.schema[0].dataType)).collect()]
    assert got == ["10000000.0", "123456789.123", "0.5", "-2.0", "0.0", "1.0E20", "1.0E-7"]


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([(None,), ("x",)], "`a.b``c d` string")
    assert df.where(P.violation(Rule(RuleType.NOT_NULL, Target("t", "a.b`c d")), df.schema)).count() == 1
    with pytest.raises(RuleError):
        P.violation(Rule(RuleType.NOT_NULL, Target("t", "nope")), df.schema)


def test_regular_expressions_of_types():
    import re

    assert re.search(formats.integer_digits(2), "-12") and not re.search(formats.integer_digits(2), "123")
    assert re.search(formats.float_digits(5, 2), "123.45") and not re.search(formats.float_digits(5, 2), "1234.5")
    assert re.search(formats.float_digits(2, 2), "0.12") and not re.search(formats.float_digits(2, 2), "1.12")
    assert re.search(formats.float_digits(3, 0), "123.00") and re.search(formats.basic_float(), "-1.5") and not re.search(formats.basic_integer(), "1.0")
    assert re.search(formats.integer_like_float(), "12.00") and re.search(formats.at_most_characters(2), "ab")
    assert formats.java_pattern("YYYY/MM/DD") == "yyyy/MM/dd" and formats.strftime_pattern("yyyy-mm-dd hh:mi:ss") == "%Y-%m-%d %H:%M:%S"


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT detect_invalid_integer_digits('123', 2) a, detect_invalid_integer_digits('12', 2) b, detect_invalid_string_length('abc', 2) c, detect_invalid_float_precision('99.99', 4, 1) d, detect_invalid_float_precision('0.9', 1, 1) e, is_valid_date('2023-02-31', 'yyyy-MM-dd') f, is_valid_date('', 'yyyy') g").first()
    assert tuple(row) == (True, False, True, True, False, False, True)
    assert full_name("t", "d") == "`d`.`t`" and quote_text("a'b") == "'a\\'b'" and "year" in DATE_FUNCTIONS


def test_registered_kinds(spark):
    from assaykit.model import Category
    from assaykit.plans.registry import RuleKind

    assert {"NOT_NULL", "SCHEMA", "CUSTOM_SQL"} <= set(REGISTRY.names()) and REGISTRY.names(Category.UNIQUENESS) == ["UNIQUE"]
    assert REGISTRY.get("ENUM").json_schema()["required"] == ["allowed_values"]
    REGISTRY.register(RuleKind("EVEN", Category.CUSTOM, "even numbers", predicate=lambda rule, schema: P.quoted(rule.column) % 2 != 0))
    try:
        df = spark.range(5)
        rule = Rule(RuleType.NOT_NULL, Target("t", "id"), {"kind": "EVEN"})
        assert df.where(REGISTRY.predicate(rule, df.schema)).count() == 2
        with pytest.raises(RuleError):
            REGISTRY.predicate(Rule(RuleType.NOT_NULL, Target("t", "id"), {"kind": "CUSTOM_SQL"}), df.schema)
        with pytest.raises(RuleError):
            REGISTRY.register(RuleKind("EVEN", Category.CUSTOM, "again"))
    finally:
        REGISTRY.remove("EVEN")
