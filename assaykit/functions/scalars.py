"""Scalar helpers as Columns, and the same checks as SQL functions for users of spark.sql().

The SQL functions are expressions, not Python: they are inlined into the plan that uses them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.formats import java_pattern

string_length = F.length
substring = F.substring


def matches(c: Column, pattern: str) -> Column:
    return c.cast("string").rlike(pattern)


def not_matches(c: Column, pattern: str) -> Column:
    return ~c.cast("string").rlike(pattern)


def like_ignoring_case(c: Column, pattern: str) -> Column:
    return c.cast("string").ilike(pattern)


def after_last(c: Column, delimiter: str) -> Column:
    """What follows the last delimiter, or all of it."""
    return F.substring_index(c.cast("string"), delimiter, -1)


def parse_date(c: Column, fmt: str) -> Column:
    """A timestamp, or null if the text isn't in just that format."""
    return F.try_to_timestamp(c.cast("string"), F.lit(java_pattern(fmt)))


def date_literal(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def quote_identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def full_name(table: str, database: str | None = None) -> str:
    return f"{quote_identifier(database)}.{quote_identifier(table)}" if database else quote_identifier(table)


#: The date functions by their general names.
DATE_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "now": F.current_timestamp,
    "today": F.current_date,
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
    "date_add": F.date_add,
    "date_sub": F.date_sub,
    "datediff": F.datediff,
}

_SQL_FUNCTIONS = {
    "detect_invalid_integer_digits": (
        "v STRING, digits INT",
        "v IS NOT NULL AND coalesce(try_cast(v AS DOUBLE) <> floor(try_cast(v AS DOUBLE)) OR abs(try_cast(v AS DOUBLE)) >= pow(10, digits), true)",
    ),
    "detect_invalid_string_length": ("v STRING, most INT", "coalesce(length(v) > most, false)"),
    "detect_invalid_float_precision": (
        "v STRING, p INT, s INT",
        """v IS NOT NULL AND coalesce(try_cast(v AS DECIMAL(38,18)) IS NULL
           OR (p = s AND abs(try_cast(v AS DECIMAL(38,18))) >= 1)
           OR (p <> s AND length(split_part(cast(abs(try_cast(v AS DECIMAL(38,18))) AS STRING), '.', 1)) > p - s)
           OR length(rtrim('0', split_part(cast(abs(try_cast(v AS DECIMAL(38,18))) AS STRING), '.', 2))) > s, true)""",
    ),
    "is_valid_date": ("v STRING, pattern STRING", "v IS NULL OR trim(v) = '' OR try_to_timestamp(v, pattern) IS NOT NULL"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers the checks as temporary SQL functions; is_valid_date takes a Java pattern, see java_pattern()."""
    for name, (parameters, body) in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS BOOLEAN RETURN {body}")
    return list(_SQL_FUNCTIONS)
