"""Each rule as one Column that is true for the rows that violate it.

The same Column serves a table's fused scan, a rule on its own, samples, quarantine and streams, so they cannot
disagree. A rule settles what null means: NOT_NULL, LENGTH and RANGE fail it; ENUM, REGEX, DATE_FORMAT and the
checks of desired types let it pass. Predicates may be null; count_if() takes that as false.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.errors import RuleError
from assaykit.functions.formats import java_pattern
from assaykit.model import Rule, RuleType


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def canonical_text(c: Column, kind: T.DataType) -> Column:
    """The text of a value: for floating point the plain decimal notation, with one zero if it is whole."""
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.cast("string")
    d = c.cast("string").cast("double") if isinstance(kind, T.FloatType) else c
    plain = F.rtrim(d.try_cast("decimal(38,18)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    size = F.abs(d)
    return F.when((size >= 1e-4) & (size < 1e16), plain).when(size == 0, F.lit("0.0")).otherwise(c.cast("string"))


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def as_number(c: Column, kind: T.DataType) -> Column:
    """Numbers as they are, text as a double if it is one."""
    return c if is_number(kind) else c.cast("string").try_cast("double")


def violates_not_null(c: Column) -> Column:
    return c.isNull()


def violates_range(c: Column, kind: T.DataType, low: Any, high: Any) -> Column:
    """Null fails; text that is not a number fails as well."""
    if not isinstance(kind, (T.NumericType, T.StringType, T.CharType, T.VarcharType)):
        raise RuleError(f"RANGE is for numbers, not for {kind.simpleString()}")
    v = as_number(c, kind)
    bad = v.isNull()
    if low is not None:
        bad = bad | (v < F.lit(low))
    if high is not None:
        bad = bad | (v > F.lit(high))
    return bad


def violates_length(c: Column, kind: T.DataType, low: int | None, high: int | None, exact: int | None) -> Column:
    """In characters; null fails."""
    n = F.length(canonical_text(c, kind))
    bad = c.isNull()
    for limit, test in ((low, n.__lt__), (high, n.__gt__), (exact, n.__ne__)):
        if limit is not None:
            bad = bad | test(F.lit(limit))
    return bad


def _typed(values: list[Any], kind: T.DataType) -> list[Any] | None:
    """The values as the column's type, or None if one is none of it."""
    out: list[Any] = []
    for v in values:
        try:
            if isinstance(kind, T.BooleanType):
                out.append({"true": True, "1": True, "false": False, "0": False}[str(v).strip().lower()])
            elif isinstance(kind, T.IntegralType):
                n = float(v)
                if n != int(n):
                    return None
                out.append(int(v) if not isinstance(v, str) or "." not in v else int(n))
            elif isinstance(kind, T.NumericType):
                out.append(float(v))
            else:
                return None
        except (KeyError, TypeError, ValueError, OverflowError):
            return None
    return out


def violates_enum(c: Column, kind: T.DataType, values: list[Any]) -> Column:
    """Compared as the column's type if every value is one, else as text; null passes, and so does no value at all."""
    given = [v for v in values if v is not None]
    typed = _typed(given, kind)
    if typed is not None:
        return ~c.isin(typed)
    return ~canonical_text(c, kind).isin([str(v) for v in given])


def violates_domain(c: Column, values: list[Any]) -> Column:
    """Of what contains @, the part after the last one must be listed."""
    text = c.cast("string")
    return text.isNotNull() & text.contains("@") & ~F.substring_index(text, "@", -1).isin([str(v) for v in values])


def violates_regex(c: Column, kind: T.DataType, pattern: str) -> Column:
    """The pattern may match anywhere; null passes."""
    return ~canonical_text(c, kind).rlike(pattern)


def violates_date_format(c: Column, fmt: str) -> Column:
    """Not a date or time in just that format; null and blank pass. Partial formats resolve in 1970."""
    text = c.cast("string")
    return text.isNotNull() & ~text.rlike(r"^\s*$") & F.try_to_timestamp(text, F.lit(java_pattern(fmt))).isNull()


def integers_within_digits(c: Column, digits: int) -> Column:
    """Whether the whole part of a number is within so many digits; null if it is null or no number."""
    return F.abs(c.try_cast("decimal(38,0)")) <= F.lit(10**digits - 1).cast("decimal(38,0)")


def violates_integer_digits(c: Column, kind: T.DataType, digits: int) -> Column:
    """Not a whole number of at most so many digits; null passes."""
    if isinstance(kind, T.IntegralType):
        return ~integers_within_digits(c, digits) if digits < 20 else F.lit(False)
    d = c.cast("string").try_cast("double") if not is_number(kind) else c.cast("double")
    return c.isNotNull() & F.coalesce(F.isnan(d) | (d != F.floor(d)) | (F.abs(d) >= F.lit(float(10**digits))), F.lit(True))


def violates_integer_text(c: Column, digits: int) -> Column:
    """A text that isn't written as a whole number, or has more digits, zeros at the front apart; null passes."""
    return ~c.cast("string").rlike(rf"^-?0*[0-9]{{1,{digits}}}$")


def violates_whole(c: Column, kind: T.DataType) -> Column:
    """Not a whole number, whatever its size; null passes."""
    d = c.cast("string").try_cast("double") if not is_number(kind) else c.cast("double")
    return c.isNotNull() & F.coalesce(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))) | (d % 1 != 0), F.lit(True))


def violates_string_length(c: Column, kind: T.DataType, most: int) -> Column:
    """More characters than allowed; null passes."""
    return F.length(canonical_text(c, kind)) > most


def violates_float_precision(c: Column, kind: T.DataType, precision: int, scale: int) -> Column:
    """More than precision - scale digits before the point or scale after it, zeros at the end apart; null passes.

    If both are equal the part before the point must be 0. What isn't a number fails.
    """
    number = c.cast("string").try_cast("double") if not is_number(kind) else c.cast("double")
    text = c.cast("string") if isinstance(kind, T.DecimalType) else canonical_text(number, T.DoubleType())
    text = F.ltrim(text, F.lit("-"))
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.rtrim(F.split_part(text, F.lit("."), F.lit(2)), F.lit("0"))
    bad = (whole != "0") if precision == scale else (F.length(whole) > precision - scale)
    odd = F.isnan(number) | (F.abs(number) == F.lit(float("inf"))) | text.contains("E")
    return c.isNotNull() & F.coalesce(odd | bad | (F.length(part) > scale), F.lit(True))


def _desired(c: Column, kind: T.DataType, p: dict[str, Any]) -> Column:
    what = p["validation_type"]
    if what == "integer_digits":
        return violates_integer_digits(c, kind, p["max_digits"])
    if what == "integer_text":
        return violates_integer_text(c, p["max_digits"])
    if what == "integer_like_float":
        return violates_whole(c, kind)
    if what == "string_length":
        return violates_string_length(c, kind, p["max_length"])
    if what == "float_precision":
        return violates_float_precision(c, kind, p["precision"], p["scale"])
    raise RuleError(f"unknown validation_type {what!r}")


def violation(rule: Rule, schema: T.StructType) -> Column:
    """The rule's predicate on a table with this schema, without its filter."""
    field = next((f for f in schema.fields if f.name == rule.column), None)
    if field is None:
        raise RuleError(f"column {rule.column!r} not found", rule=rule.name)
    c, kind, p = quoted(rule.column), field.dataType, rule.parameters
    if rule.type == RuleType.NOT_NULL:
        return violates_not_null(c)
    if rule.type == RuleType.RANGE:
        return violates_range(c, kind, rule.bound("min"), rule.bound("max"))
    if rule.type == RuleType.LENGTH:
        return violates_length(c, kind, p.get("min_length"), p.get("max_length"), p.get("exact_length"))
    if rule.type == RuleType.ENUM:
        return violates_domain(c, p["allowed_values"]) if p.get("extract_domain") else violates_enum(c, kind, list(p["allowed_values"]))
    if rule.type == RuleType.REGEX:
        return _desired(c, kind, p) if p.get("validation_type") else violates_regex(c, kind, p["pattern"])
    if rule.type == RuleType.DATE_FORMAT:
        return violates_date_format(c, rule.pattern)
    raise RuleError(f"{rule.type} is not a predicate on a row")
