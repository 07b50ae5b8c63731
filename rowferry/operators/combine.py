"""Several sources into one set of rows: joins in order, then UNION ALL.

Join keys compare as text, so 1 meets '1' and NULL meets both NULL and ''.
Columns already there win over columns of a joined source. A left join that
finds nothing leaves the joined columns *absent*, which differs from NULL: a
later join may still supply them, and numeric filters do not see them as 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.coerce import INTEGRAL, text_of, text_or_null
from rowferry.operators.sizing import broadcast_by_size
from rowferry.plans.spec import SourceSpec
from rowferry.session import stage

#: Tasks that share the rows of one hot key of a left-joined source.
HOT_KEY_SPLITS = 32
#: A key is hot when it holds more than this share of its source's rows, so
#: there are at most 1000 of them whatever the size of the data ...
HOT_KEY_SHARE = 0.001
#: ... and at least this many rows, below which one task copes easily.
HOT_KEY_MIN_ROWS = 100_000
_HOT_KEYS_MAX = 1000
_HOT_KEYS_TRACKED = 8_000


@dataclass(frozen=True)
class Combined:
    """Combined rows, and for columns a row may lack a test whether it has them."""

    df: DataFrame
    present: dict[str, Column] = field(default_factory=dict)


def _has(name: str) -> str:
    return f"__has.{name}"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def _key(df: DataFrame, columns: Sequence[str]) -> Column:
    """All key columns of one side as a single text value, never NULL."""
    parts = [text_of(_c(c), _dtype(df, c)) if c in df.columns else F.lit("") for c in columns]
    if len(parts) == 1:
        return parts[0]
    # Lengths in front keep ('a','bc') apart from ('ab','c').
    return F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)])


def hot_keys(sides: dict[int, tuple[DataFrame, Column]], min_rows: int | None = None) -> dict[int, list[str]]:
    """Keys holding a large share of each side, at most 1000 per side by construction.

    One job for all sides: a pass over their key columns with a bounded sketch
    per task, no shuffle of keys. The counts are estimates, which only decides
    how work is spread.
    """
    if not sides:
        return {}
    top = F.expr(f"approx_top_k(k, {_HOT_KEYS_MAX}, {_HOT_KEYS_TRACKED})")
    found = [
        side.select(key.alias("k")).agg(top.alias("top"), F.count(F.lit(1)).alias("n"))
        .select(F.lit(i).alias("i"), "top", "n")
        for i, (side, key) in sides.items()
    ]
    least = F.greatest(F.col("n") * F.lit(HOT_KEY_SHARE), F.lit(float(HOT_KEY_MIN_ROWS if min_rows is None else min_rows)))
    hot = reduce(DataFrame.unionAll, found).select(
        "i", F.filter("top", lambda t: t["count"] >= least)["item"].alias("items"))
    return {row["i"]: list(row["items"]) for row in hot.collect()}


def _split_left_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column,
                     marker: str, splits: int, hot: list[str]) -> DataFrame:
    """Left join that spreads the right rows of ``hot`` keys over ``splits`` tasks.

    Adaptive execution can divide a large *left* partition of a left join, but
    not a large right one. So right rows of a hot key get one of ``splits``
    numbers and left rows of such a key are repeated for each number. Every key
    of ``hot`` must occur in ``right``, hence unmatched repeats are surplus and
    dropped; :func:`_fixed` sees to that.

    The numbers are drawn per row, not hashed from it, so that copies of one row
    spread too. ``right`` is a staged table, whose scan draws them alike each time.
    """
    spread = F.array(*[F.lit(i) for i in range(splits)])
    lhs = left.withColumn("__k", left_key).withColumn("__hot", F.col("__k").isin(hot))
    lhs = lhs.withColumn(
        "__s", F.explode(F.when(F.col("__hot"), spread).otherwise(F.array(F.lit(0))))
    )
    draw = F.floor(F.rand(17) * F.lit(splits)).cast("int")
    rhs = right.withColumn("__rk", right_key).withColumn(
        "__rs", F.when(F.col("__rk").isin(hot), draw).otherwise(F.lit(0))
    )
    joined = lhs.join(rhs, (F.col("__k") == F.col("__rk")) & (F.col("__s") == F.col("__rs")), "left")
    kept = joined.filter(~F.col("__hot") | F.col(marker).isNotNull())
    return kept.drop("__k", "__s", "__hot", "__rk", "__rs")


def _same_key(left: DataFrame, right: DataFrame, a: str, b: str, nulls: bool) -> Column:
    """Key columns ``a`` and ``b`` name the same thing.

    Integers have equal text exactly if they are equal, so they are compared as
    they are; anything else by its text.
    """
    known = a in left.columns and b in right.columns
    if known and isinstance(_dtype(left, a), INTEGRAL) and isinstance(_dtype(right, b), INTEGRAL):
        x, y = _c(a), _c(b)
        if _dtype(left, a) != _dtype(right, b):
            x, y = x.cast("bigint"), y.cast("bigint")
        return x.eqNullSafe(y) if nulls else x == y
    return _key(left, [a]) == _key(right, [b])


def _splits(spec: SourceSpec) -> int:
    """Tasks to spread a hot key of this source over; 0 for none.

    Inner joins are left to adaptive execution, which can divide either side.
    """
    if spec.join_type == "inner" or spec.split_hot_keys in (0, 1):
        return 0
    return spec.split_hot_keys or HOT_KEY_SPLITS


def _usable(df: DataFrame, spec: SourceSpec, prefix: str = "") -> DataFrame:
    """The rows of a joined source that can match: under ``'never'`` those with no empty key."""
    if spec.null_keys != "never":
        return df
    parts = [text_of(_c(prefix + b), _dtype(df, prefix + b)) != "" if prefix + b in df.columns else F.lit(False)
             for _, b in spec.on]
    return df.filter(reduce(lambda a, b: a & b, parts))


def _find_hot_keys(joins: Sequence[SourceSpec], min_rows: int | None) -> dict[int, list[str]]:
    """Hot keys of the sources to split, sought among the rows that can match.

    Sources that the optimizer will broadcast, and knows to be too small to hold
    a hot key, are left out.
    """
    sides = {}
    small = 12 * (HOT_KEY_MIN_ROWS if min_rows is None else min_rows)
    for i, spec in enumerate(joins):
        if _splits(spec) and not broadcast_by_size(spec.df, small):
            usable = _usable(spec.df, spec)
            sides[i] = (usable, _key(usable, [b for _, b in spec.on]))
    return hot_keys(sides, min_rows)


def _fixed(spec: SourceSpec, hot: list[str]) -> tuple[SourceSpec, list[str]]:
    """The source as a staged table, and those of its hot keys that are in it.

    The list came from an earlier read. Once the rows are written down, a key of
    the list is either among them or is not hot, also where the source changed.
    """
    df = stage(_usable(spec.df, spec), "hot-side")
    key = _key(df, [b for _, b in spec.on])
    there = df.select(key.alias("k")).filter(F.col("k").isin(hot)).distinct().collect()  # at most as many as listed
    return replace(spec, df=df), [r.k for r in there]


def _join(state: Combined, spec: SourceSpec, number: int, hot: list[str]) -> Combined:
    left = state.df
    marker = f"__m{number}"
    prefix = f"__j{number}."
    right = spec.df.select(
        *[_c(c).alias(prefix + c) for c in spec.df.columns], F.lit(True).alias(marker)
    )
    own = [a for a, _ in spec.on]
    theirs = [prefix + b for _, b in spec.on]
    inner = spec.join_type == "inner"

    # Rows without a key match nothing under 'never': they need not meet the shuffle's key.
    right = _usable(right, spec, prefix)

    if hot:
        joined = _split_left_join(left, right, _key(left, own), _key(right, theirs), marker,
                                  _splits(spec), hot)
    else:
        nulls = spec.null_keys == "match"
        same = [_same_key(left, right, a, b, nulls) for a, b in zip(own, theirs)]
        joined = left.join(right, reduce(lambda a, b: a & b, same), spec.join_type)

    matched = F.col(marker).isNotNull()
    have = set(left.columns)
    columns: list[Column] = []
    present: dict[str, Column] = {}
    flags: list[Column] = []

    def mark(name: str, test: Column) -> None:
        flags.append(test.alias(_has(name)))
        present[name] = _c(_has(name))

    for name in left.columns:
        if name.startswith("__has."):
            continue
        here = state.present.get(name)
        if here is None:
            columns.append(_c(name))
        elif name in spec.df.columns:
            value = _merge(here, _c(name), _dtype(left, name), _c(prefix + name),
                           _dtype(spec.df, name))
            columns.append(value.alias(name))
            if not inner:
                mark(name, here | matched)
        else:
            columns.append(_c(name))
            mark(name, here)
    for name in spec.df.columns:
        if name not in have:
            columns.append(_c(prefix + name).alias(name))
            if not inner:
                mark(name, matched)
    return Combined(joined.select(*columns, *flags), present)


def _merge(here: Column, a: Column, a_type: T.DataType, b: Column, b_type: T.DataType) -> Column:
    """``a`` where the row has it, else ``b``; types brought together."""
    target = common_type([a_type, b_type])
    return F.when(here, _as(a, a_type, target)).otherwise(_as(b, b_type, target))


def common_type(types: Sequence[T.DataType]) -> T.DataType:
    """Type able to hold every value unchanged in meaning; text if need be."""
    known = [t for t in types if not isinstance(t, T.NullType)]
    if not known:
        return T.StringType()
    if all(t == known[0] for t in known):
        return known[0]
    if all(isinstance(t, INTEGRAL) for t in known):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in known):
        return T.DoubleType()
    return T.StringType()


def _as(c: Column, dtype: T.DataType, target: T.DataType) -> Column:
    if dtype == target:
        return c
    if isinstance(target, T.StringType):
        return text_or_null(c, dtype).cast("string")
    return c.cast(target)


def cap_rows(df: DataFrame, n: int | None, order_by: Sequence[str] | None = None) -> DataFrame:
    """At most ``n`` rows, chosen by ``order_by`` (by default every column)."""
    if n is None:
        return df
    keys = order_by or [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return df.orderBy(*[_c(k) for k in keys]).limit(n)


def _branch(df: DataFrame, present: dict[str, Column], columns: Sequence[str]):
    """Columns of one UNION ALL input with, per column, how it is present."""
    have = set(df.columns)
    return {
        name: (_c(name), _dtype(df, name), present.get(name)) if name in have
        else (F.lit(None).cast("string"), T.NullType(), F.lit(False))
        for name in columns
    }


def combine(primary: DataFrame, sources: Sequence[SourceSpec] = (),
            mapped_cols: Sequence[str] | None = None, row_cap: int | None = None,
            cap_order: Sequence[str] | None = None, hot_key_min_rows: int | None = None) -> Combined:
    """All joins in the order given, then all unions, then the optional cap.

    ``mapped_cols`` are the source columns of the mapping. Union sources, and
    the primary when nothing is joined, are narrowed to them; a filter on any
    other column then finds it absent. ``row_cap`` (off by default) limits each
    source and the result; it orders first, so the choice is repeatable.
    ``hot_key_min_rows`` (:data:`HOT_KEY_MIN_ROWS`) is the least number of rows that make a key hot.
    """
    joins = [s for s in sources if s.mode == "join"]
    unions = [s for s in sources if s.mode == "union"]
    wanted = list(dict.fromkeys(mapped_cols)) if mapped_cols is not None else None

    def capped(df: DataFrame) -> DataFrame:
        order = [c for c in cap_order if c in df.columns] if cap_order else None
        return cap_rows(df, row_cap, order)

    if joins:
        state = Combined(capped(primary))
        if row_cap is not None:
            joins = [replace(spec, df=capped(spec.df)) for spec in joins]
        hot = _find_hot_keys(joins, hot_key_min_rows) if row_cap is None else {}
        for i, spec in enumerate(joins):
            keys = hot.get(i, [])
            if keys:
                spec, keys = _fixed(spec, keys)
            state = _join(state, spec, i, keys)
    else:
        state = Combined(capped(_narrow(primary, wanted)))

    if unions:
        state = _union(state, [capped(_narrow(u.df, wanted)) for u in unions])
    return Combined(capped(state.df), state.present) if row_cap is not None else state


def _narrow(df: DataFrame, wanted: Sequence[str] | None) -> DataFrame:
    if wanted is None:
        return df
    have = set(df.columns)
    return df.select(*[_c(c) for c in wanted if c in have])


def _union(state: Combined, others: Sequence[DataFrame]) -> Combined:
    columns = [c for c in state.df.columns if not c.startswith("__has.")]
    for df in others:
        columns += [c for c in df.columns if c not in columns]
    frames = [state.df, *others]
    branches = [_branch(state.df, state.present, columns)]
    branches += [_branch(df, {}, columns) for df in others]
    types = {c: common_type([b[c][1] for b in branches]) for c in columns}
    partial = [c for c in columns if any(b[c][2] is not None for b in branches)]

    def rows(df: DataFrame, branch) -> DataFrame:
        values = [_as(branch[c][0], branch[c][1], types[c]).cast(types[c]).alias(c) for c in columns]
        flags = [
            (F.lit(True) if branch[c][2] is None else branch[c][2]).alias(_has(c)) for c in partial
        ]
        return df.select(*values, *flags)

    united = reduce(DataFrame.unionByName, [rows(df, b) for df, b in zip(frames, branches)])
    return Combined(united, {c: _c(_has(c)) for c in partial})
