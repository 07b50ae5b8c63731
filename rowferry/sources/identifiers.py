"""Names that may be placed in generated reader options."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: one part of a table or column name.
NAME_PART = "[A-Za-z_][A-Za-z0-9_]*"

_TABLE = re.compile(rf"{NAME_PART}(\.{NAME_PART})?")


def split_identifier(name: str) -> list[str]:
    """Parts of ``table`` or ``schema.table``; anything else is refused."""
    if not _TABLE.fullmatch(name):
        raise ValueError(f"Invalid identifier: {name}")
    return name.split(".")


def valid_identifier(c: Column) -> Column:
    """The same rule over a column of names, for auditing a catalog."""
    return F.coalesce(c.rlike(rf"\A{NAME_PART}(\.{NAME_PART})?\z"), F.lit(False))


def schema_and_table(c: Column, default_schema: str) -> tuple[Column, Column]:
    """Split ``schema.table``, the schema defaulting where there is no dot."""
    parts = F.split(c, "[.]", -1)
    dotted = F.size(parts) > 1
    return (
        F.when(dotted, F.element_at(parts, 1)).otherwise(F.lit(default_schema)),
        F.when(dotted, F.element_at(parts, 2)).otherwise(F.element_at(parts, 1)),
    )
