"""What a run is made of: connectors, sources, mappings, conditions, targets."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import DataFrame

# The words each configuration field accepts.
SYNC_MODES = ("append", "truncate_reload")
COMBINE_MODES = ("union", "join")
JOIN_TYPES = ("inner", "left")
MATCH_MODES = ("all", "any")
OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "contains")
CONNECTOR_ROLES = ("source", "target", "both")

Operator = Literal["=", "!=", ">", "<", ">=", "<=", "contains"]


@dataclass(frozen=True)
class Connector:
    """Connection settings of one system.

    ``database`` is the database name, the bucket or container, or for
    ``type='file'`` a folder URI.
    """

    type: str
    database: str = ""
    host: str = ""
    port: int | None = None
    username: str = ""
    password: str = field(default="", repr=False)
    id: str | None = None


@dataclass(frozen=True)
class Mapping:
    """One renamed column; ``cast_to`` optionally converts the value."""

    source_col: str
    target_col: str
    cast_to: str | None = None


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: str


@dataclass(frozen=True)
class SourceSpec:
    """An extra source, joined to or unioned with the primary one.

    ``on`` lists (column of the rows so far, column of this source) pairs; most
    joins have one. ``null_keys='never'`` keeps empty keys from matching each
    other. ``split_hot_keys`` spreads the rows of this source's most frequent
    keys over that many tasks in a left join (one extra pass over its key column
    while planning); 0 turns that off.
    """

    df: DataFrame
    mode: str = "union"
    join_type: str = "inner"
    on: tuple[tuple[str, str], ...] = ()
    null_keys: str = "match"
    split_hot_keys: int | None = None

    def __post_init__(self):
        if self.mode not in COMBINE_MODES:
            raise ValueError(f"mode must be one of {COMBINE_MODES}")
        if self.mode == "join" and not self.on:
            raise ValueError("a join source needs at least one pair of key columns")
        if self.join_type not in JOIN_TYPES:
            raise ValueError(f"join_type must be one of {JOIN_TYPES}")
        if self.null_keys not in ("match", "never"):
            raise ValueError("null_keys must be 'match' or 'never'")


@dataclass(frozen=True)
class Target:
    """A table of a connector to load into."""

    connector: Connector
    table: str
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class DestinationSpec:
    """A further target that receives the rows meeting its conditions."""

    id: str
    target: Target | None = None
    conditions: tuple[Condition, ...] = ()
    match_mode: str = "all"
