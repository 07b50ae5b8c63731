"""Loose value coercions as JVM-side expressions.

Sources hand over values of whatever type their driver chose, so keys and
filters compare through two coercions: *text* (``text_of``) and *number*
(``number_of``). "Not a number" is SQL NULL here, never NaN, because Spark
orders NaN above every number and treats it as equal to itself.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FRACTIONAL + (T.DecimalType,)
INSTANT = (T.TimestampType, T.TimestampNTZType)

# The text accepted as a decimal number, and trimmed blanks.
NUMBER_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
BLANKS = (" \t\n\r\f\x0b\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000\ufeff")

_NUMBER_RE = re.compile(NUMBER_TEXT)


def _float_text(c: Column) -> Column:
    """Shortest plain text of a double: ``100`` for 100.0, ``12345678.9`` for 1.23456789E7."""
    d = c.cast("double")
    as_text = d.cast("string")
    plain = F.regexp_replace(
        as_text.try_cast("decimal(38,18)").cast("string"), "[.]?0+$", ""
    )
    size = F.abs(d)
    return (
        F.when((d == F.floor(d)) & (size < F.lit(1e15)), d.cast("bigint").cast("string"))
        .when((size >= F.lit(1e-3)) & (size < F.lit(1e7)), as_text)
        .otherwise(F.coalesce(plain, as_text))
    )


def text_or_null(c: Column, dtype: T.DataType) -> Column:
    """Text form of a value, NULL staying NULL."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, FRACTIONAL):
        return _float_text(c)
    if isinstance(dtype, T.DecimalType):
        if dtype.scale == 0:
            return c.cast("string")
        return F.regexp_replace(c.cast("string"), "[.]?0+$", "")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


def text_of(c: Column, dtype: T.DataType) -> Column:
    """Text form of a value; NULL and absent both become ``''``."""
    return F.coalesce(text_or_null(c, dtype), F.lit(""))


def number_of(c: Column, dtype: T.DataType) -> Column:
    """Number form of a value: NULL and blank text are 0, other non-numbers NULL."""
    if isinstance(dtype, NUMERIC):
        return F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double"))
                          if isinstance(dtype, FRACTIONAL) else c.cast("double"),
                          F.when(c.isNull(), F.lit(0.0)))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    if isinstance(dtype, INSTANT + (T.DateType,)):
        return F.coalesce(epoch_ms(c).cast("double"), F.lit(0.0))
    if isinstance(dtype, T.StringType):
        t = F.trim(c, F.lit(BLANKS))
        return (
            F.when(c.isNull() | (t == ""), F.lit(0.0))
            .when(t.rlike(NUMBER_TEXT), t.try_cast("double"))
        )
    return F.when(c.isNull(), F.lit(0.0))


def literal_number(value: str) -> float | None:
    """``number_of`` for a filter value known while planning."""
    t = value.strip(BLANKS)
    if t == "":
        return 0.0
    return float(t) if _NUMBER_RE.match(t) else None


def epoch_ms(c: Column) -> Column:
    """Milliseconds since 1970 of a timestamp, session zone UTC."""
    return F.unix_millis(c.cast("timestamp"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from ``start`` to ``end``."""
    return epoch_ms(end) - epoch_ms(start)


def round_half_up(c: Column, places: int = 0) -> Column:
    """Round with halves going towards +infinity, so -2.5 becomes -2."""
    if places == 0:
        return F.floor(c + F.lit(0.5)).cast("double")
    scale = F.lit(float(10**places))
    return F.floor(c * scale + F.lit(0.5)) / scale


def fixed_text(c: Column, places: int) -> Column:
    """Text with exactly ``places`` decimals."""
    return F.round(c, places).cast(f"decimal(38,{places})").cast("string")


def or_default(c: Column, default: Column) -> Column:
    """``default`` where text ``c`` is NULL or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def day_key(c: Column) -> Column:
    """UTC calendar day as ``yyyy-MM-dd`` text."""
    return F.date_format(c, "yyyy-MM-dd")


def iso_text(c: Column) -> Column:
    """UTC ISO-8601 text with milliseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def key_part(c: Column) -> Column:
    """Percent-encode text for use inside a composed key (space is ``%20``)."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


# -- serialized size ---------------------------------------------------------

def _json_value_bytes(c: Column, dtype: T.DataType) -> Column:
    """UTF-8 bytes of one non-null value written as compact JSON."""
    if isinstance(dtype, T.StringType):
        return F.octet_length(F.to_json(F.array(c))) - F.lit(2)  # without its [ and ]
    if isinstance(dtype, INSTANT + (T.DateType,)):
        return F.lit(26)  # "yyyy-MM-ddTHH:mm:ss.SSSZ" with its quotes
    if isinstance(dtype, FRACTIONAL):
        d = c.cast("double")
        finite = ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))
        return F.when(finite, F.octet_length(_float_text(c))).otherwise(F.lit(4))
    if isinstance(dtype, T.BinaryType):
        return F.octet_length(F.base64(c)) + F.lit(2)
    return F.octet_length(text_or_null(c, dtype))


def row_bytes(schema: T.StructType, present: dict[str, Column] | None = None) -> Column:
    """UTF-8 bytes of a row written as one compact JSON object.

    NULL is written as ``null``; a column whose ``present`` expression is false
    is left out. The size is summed from per-field lengths; only text values,
    whose escapes matter, are written as JSON for it.
    """
    present = present or {}
    total = F.lit(0)
    fields = F.lit(0)
    always = 0
    constant = 2
    for field in schema.fields:
        c = F.col(f"`{field.name}`")
        label = _label_bytes(field.name)
        value = F.when(c.isNull(), F.lit(4)).otherwise(_json_value_bytes(c, field.dataType))
        here = present.get(field.name)
        if here is None:
            always += 1
            constant += label
            total = total + value
        else:
            total = total + F.when(here, value + F.lit(label)).otherwise(F.lit(0))
            fields = fields + F.when(here, F.lit(1)).otherwise(F.lit(0))
    if always == len(schema.fields):
        return (total + F.lit(constant + max(always - 1, 0))).cast("bigint")
    commas = F.greatest(fields + F.lit(always - 1), F.lit(0))
    return (total + F.lit(constant) + commas).cast("bigint")


def _label_bytes(name: str) -> int:
    """Bytes of ``"name":`` in JSON."""
    return len(json.dumps(name, ensure_ascii=False).encode()) + 1
