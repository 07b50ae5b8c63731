"""Destination filters: column, operator, value text, under loose comparison.

``=``, ``!=`` and ``contains`` compare text, the four orderings compare numbers.
NULL is ``''`` as text and 0 as a number, so NULL rows pass ``!= 'x'`` and
``>= 0``. The expressions below give the same rows as comparing the coerced
values, but are written over the bare column wherever its type allows, so that
Parquet and JDBC scans receive them as pushed filters.

A result is TRUE, or FALSE/NULL for a row that does not match. Conditions are
only combined with AND and OR and used as filters, where both mean "no"; wrap
with :func:`flag` to select the answer as a column.
"""

from __future__ import annotations

import re
from collections.abc import Mapping as Mapped
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.coerce import (
    FRACTIONAL, INTEGRAL, NUMERIC, literal_number, number_of, text_of,
)
from rowferry.plans.spec import MATCH_MODES, Condition

_INT_TEXT = re.compile(r"0|-?[1-9][0-9]*")
_LONG_MIN, _LONG_MAX = -(2**63), 2**63 - 1

_ORDERINGS = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}

NO = False


def flag(predicate: Column) -> Column:
    """A predicate as a plain TRUE/FALSE column."""
    return F.coalesce(predicate, F.lit(False))


def _equals(c: Column, dtype: T.DataType, value: str) -> Column:
    if isinstance(dtype, T.StringType):
        return (c == value) if value else (c.isNull() | (c == ""))
    if value == "":
        return c.isNull()
    if isinstance(dtype, INTEGRAL):
        # Only the canonical spelling of an integer can equal its text.
        if _INT_TEXT.fullmatch(value) and _LONG_MIN <= int(value) <= _LONG_MAX:
            return c == F.lit(int(value))
        return F.lit(NO)
    if isinstance(dtype, FRACTIONAL):
        number = _plain_float(value)
        if number is not None:
            return c.cast("double") == F.lit(number) if isinstance(dtype, T.FloatType) else c == F.lit(number)
    return text_of(c, dtype) == value


def _plain_float(value: str) -> float | None:
    """The double whose shortest text is ``value``, if that is easily told."""
    number = literal_number(value)
    if number is None or not (1e-3 <= abs(number) < 1e15):
        return None
    shown = repr(number)
    return number if shown.removesuffix(".0") == value else None


def _differs(c: Column, dtype: T.DataType, value: str) -> Column:
    if isinstance(dtype, T.StringType):
        return (c.isNull() | (c != value)) if value else (c.isNotNull() & (c != ""))
    if value == "":
        return c.isNotNull()
    return ~flag(_equals(c, dtype, value))


def _ordered(c: Column, dtype: T.DataType, operator: str, value: str) -> Column:
    number = literal_number(value)
    if number is None:
        return F.lit(NO)
    compare = _ORDERINGS[operator]
    if isinstance(dtype, NUMERIC):
        # Whole literals stay whole, so a bigint column is compared uncast.
        whole = number.is_integer() and _LONG_MIN <= number <= _LONG_MAX
        bound = F.lit(int(number)) if whole and isinstance(dtype, INTEGRAL) else F.lit(number)
        test = compare(c, bound)
        if isinstance(dtype, FRACTIONAL):
            if operator in (">", ">="):
                # Spark orders NaN above every number; this form can be pushed.
                test = test & (c <= F.lit(float("inf")))
        return (test | c.isNull()) if compare(0.0, number) else test
    return compare(number_of(c, dtype), F.lit(number))


def _typed(c: Column, dtype: T.DataType, operator: str, value: str) -> Column:
    """SQL comparison with the value read as the column's own type."""
    literal = F.lit(value).try_cast(dtype)
    if operator in _ORDERINGS:
        return _ORDERINGS[operator](c, literal)
    return (c == literal) if operator == "=" else (c != literal)


def condition(schema: T.StructType, cond: Condition, compare: str = "loose",
              present: Mapped[str, Column] | None = None) -> Column:
    """One condition as a predicate over the rows of ``schema``.

    ``present`` tells, for columns that a row may lack altogether, whether it
    has them: an absent column is text ``''`` but not the number 0.
    ``compare='typed'`` uses ordinary SQL comparison instead. An operator that
    is not known matches nothing.
    """
    types = {f.name: f.dataType for f in schema.fields}
    name, op, value = cond.column, cond.operator, cond.value
    if name not in types:
        return F.lit({"=": value == "", "!=": value != "", "contains": value == ""}.get(op, NO))
    c = F.col(f"`{name}`")
    dtype = types[name]
    if op == "contains":
        needle = value.lower()
        if needle == "":
            return F.lit(True)
        return F.lower(text_of(c, dtype)).contains(needle)
    if compare == "typed" and op in ("=", "!=", *_ORDERINGS):
        return _typed(c, dtype, op, value)
    if op == "=":
        return _equals(c, dtype, value)
    if op == "!=":
        return _differs(c, dtype, value)
    if op in _ORDERINGS:
        test = _ordered(c, dtype, op, value)
        here = (present or {}).get(name)
        return test if here is None else (here & test)
    return F.lit(NO)


def conditions(schema: T.StructType, conds: Sequence[Condition], match_mode: str = "all",
               compare: str = "loose", present: Mapped[str, Column] | None = None) -> Column:
    """Conditions joined by AND (``all``) or OR (``any``); none at all is true."""
    if match_mode not in MATCH_MODES:
        raise ValueError(f"match_mode must be one of {MATCH_MODES}")
    if not conds:
        return F.lit(True)
    parts = [condition(schema, c, compare, present) for c in conds]
    return reduce((lambda a, b: a | b) if match_mode == "any" else (lambda a, b: a & b), parts)
