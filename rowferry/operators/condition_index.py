"""Fan-out to thousands of destinations through an index of their conditions.

:mod:`rowferry.operators.fanout` evaluates one expression per destination, so a
row costs as much as there are destinations. Here the conditions are a table.
Each destination is filed under one *access* condition, and a row only meets
the destinations filed under one of its own keys:

* an ``=`` condition: the column and its value, found by a hash join;
* else an ordering: the column and the interval its orderings leave. All bounds
  of a column are cut at quantiles into ``2**LEVELS`` ranges, these are joined in
  twos, fours and so on, and an interval is filed under the few largest of them
  that make it up (at most two of a size). A row is in one range of each size;
* else (``contains`` and ``!=`` alone, or no condition): every row.

What is left of its conditions is then tested on the pair. Under ``any`` each
condition is an access of its own; a pair counts for the first condition that
holds, so no pair occurs twice and nothing has to be made distinct.

The rows are scanned once, repeated for their keys (one per column looked up by
value, ``LEVELS + 1`` per ordered one; most meet no entry), and not shuffled while the index is small enough to be broadcast (its size is measured).
Beyond that the join shuffles on the key and Spark divides hot keys of the rows.

Totals need no pair where an interval of one column decides alone: the rows are
summed along that column once, and a destination gets the difference of the sums
at its two bounds. What an ``any`` found by value before is taken off again.

Comparison is loose, as in :mod:`rowferry.operators.predicates`; the one
difference is that whole numbers beyond 2**53 are ordered as doubles.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.coerce import number_of, text_of
from rowferry.operators.combine import Combined
from rowferry.operators.fanout import PRIMARY, mapped_with_bytes
from rowferry.operators.remap import mapping_columns
from rowferry.operators.sizing import broadcast_if_small
from rowferry.plans.spec import MATCH_MODES, DestinationSpec, Mapping
from rowferry.session import stage

#: An ordered column has 2 to this power finest ranges.
LEVELS = 10

LINES = T.StructType([
    T.StructField("destination_id", T.StringType()), T.StructField("match_mode", T.StringType()),
    T.StructField("position", T.IntegerType()), T.StructField("column", T.StringType()),
    T.StructField("operator", T.StringType()), T.StructField("value", T.StringType()),
])
EVERY = "*"
LOWER_BOUNDS, UPPER_BOUNDS = (">", ">="), ("<", "<=")


def condition_lines(spark: SparkSession, destinations: Sequence[DestinationSpec]) -> DataFrame:
    """Destinations as lines: one per condition, one with NULLs where there is none."""
    rows = []
    for d in destinations:
        if d.match_mode not in MATCH_MODES:
            raise ValueError(f"match_mode must be one of {MATCH_MODES}")
        rows += [(d.id, d.match_mode, i, c.column, c.operator, c.value) for i, c in enumerate(d.conditions)]
        if not d.conditions:
            rows.append((d.id, d.match_mode, 0, None, None, None))
    return spark.createDataFrame(rows, LINES)


@dataclass(frozen=True)
class ConditionIndex:
    """``wanted``: destination_id, must (all of which hold), unless (none of which holds).

    ``columns`` are those that conditions look at, in the order of their
    numbers; ``equal`` and ``cuts`` tell which of them rows are looked up by,
    ``weights`` how many values each is compared with.
    """

    wanted: DataFrame
    destinations: DataFrame
    columns: tuple[str, ...]
    equal: tuple[int, ...]
    cuts: dict[int, tuple[float, ...]]
    weights: tuple[int, ...]

    @cached_property
    def entries(self) -> DataFrame:
        """``wanted`` with the keys that each is filed under."""
        return stage(_access(self.wanted, self.weights, self.cuts), "condition-index")


def _bin(number: Column, cuts: Sequence[float]) -> Column:
    """The finest range a number is in, by bisection: how many cuts are not above it; NULL for NULL.

    There are ``2**LEVELS - 1`` cuts, in order; those there is no bound for are infinite.
    """
    known = F.expr("array(" + ",".join("double('Infinity')" if c == float("inf") else f"{c!r}D" for c in cuts) + ")")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(LEVELS))])
    at = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(known, at + step - 1) <= number, step).otherwise(F.lit(0)))
    return F.when(number.isNotNull(), at)


def _padded(cuts: Sequence[float]) -> tuple[float, ...]:
    distinct = sorted(set(cuts))
    return (*distinct, *[float("inf")] * ((1 << LEVELS) - 1 - len(distinct)))


def _range_key(column: int, level: int, place: Column) -> Column:
    return F.concat(F.lit(f"r{column}:{level}:"), place.cast("string"))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _filed(column: int, first: Column, last: Column) -> Column:
    """Keys of the largest ranges that make up the finest ones from ``first`` to ``last``."""
    return _once(F.struct(first.alias("first"), last.alias("last")),
                 lambda ends: _filed_ends(column, ends["first"], ends["last"]))


def _filed_ends(column: int, first: Column, last: Column) -> Column:
    keys = []
    for level in range(LEVELS + 1):
        # The first whole range of this size, and the last one.
        a = F.shiftright(first + F.lit((1 << level) - 1), level)
        b = F.shiftright(last + F.lit(1), level) - F.lit(1)
        keys += [F.when((a <= b) & (a % 2 == 1), _range_key(column, level, a)),
                 F.when((a <= b) & (b % 2 == 0), _range_key(column, level, b))]
    return F.array_compact(F.array(*keys))


def _access(entries: DataFrame, weights: Sequence[int], cuts: dict[int, tuple[float, ...]]) -> DataFrame:
    """``entries`` with the keys that each is filed under.

    Of several ``=`` conditions the one whose column has the most different
    values in the index is taken, and need not be tested again.
    """
    weight = F.array(*[F.lit(int(w)) for w in weights])
    equal = F.array_max(F.transform(
        F.filter("must", lambda c: c["operator"] == "="),
        lambda c: F.struct(F.get(weight, c["idx"]).alias("w"), (-c["idx"]).alias("i"), c["text"].alias("text"))))
    ordered = F.filter("must", lambda c: c["operator"].isin(*LOWER_BOUNDS, *UPPER_BOUNDS))
    rows = entries.select("*", equal.alias("eq"), F.get(ordered, F.lit(0))["idx"].alias("by"))

    def bound(operators, pick):
        mine = F.filter("must", lambda c: (c["idx"] == F.col("by")) & c["operator"].isin(*operators))
        return pick(F.transform(mine, lambda c: c["num"]))

    ranges = F.lit(None).cast("array<string>")
    lo, hi = bound(LOWER_BOUNDS, F.array_max), bound(UPPER_BOUNDS, F.array_min)
    for i, at in cuts.items():
        first = F.coalesce(_bin(lo, at), F.lit(0))
        last = F.coalesce(_bin(hi, at), F.lit((1 << LEVELS) - 1))
        # An empty interval has its last range before its first, or is told apart by its tests.
        ranges = F.when(F.col("by") == i, _filed(i, first, last)).otherwise(ranges)
    by_value = F.col("eq").isNotNull()
    keys = (F.when(by_value, F.array(F.concat(F.lit("e"), (-F.col("eq.i")).cast("string"), F.lit(":"), F.col("eq.text"))))
            .when(F.col("by").isNotNull(), ranges).otherwise(F.array(F.lit(EVERY))))
    left = F.filter("must", lambda c: ~((c["operator"] == "=") & (c["idx"] == -F.col("eq.i")) & (c["text"] == F.col("eq.text"))))
    return rows.select(F.explode(keys).alias("key"), F.when(by_value, left).otherwise(F.col("must")).alias("must"),
                       *[c for c in entries.columns if c != "must"])


def condition_index(combined: Combined, lines: DataFrame) -> ConditionIndex:
    """The index of ``lines`` (see :func:`condition_lines`) for rows of ``combined``.

    Lines without a destination id are left out. A destination whose lines all
    lack a column wants every row. An unknown column is empty text and no
    number, an unknown operator holds for no row. Lines may come from a table
    of any size; only the names of the columns used, how many values each is
    compared with, and ``2**LEVELS - 1`` quantiles of its bounds reach the driver.
    """
    schema = combined.df.schema
    names = [f.name for f in schema.fields]
    value = F.coalesce("value", F.lit(""))
    op, number = F.col("operator"), number_of(value, T.StringType())
    unknown = ~F.col("column").isin(*names)
    ordering = op.isin(*LOWER_BOUNDS, *UPPER_BOUNDS)
    fixed = (F.when(F.col("column").isNull(), F.lit(None).cast("boolean"))
             .when(unknown & op.isin("=", "contains"), value == "").when(unknown & (op == "!="), value != "")
             .when(unknown, F.lit(False))
             .when((op == "contains") & (value == ""), F.lit(True))
             .when(ordering & number.isNull(), F.lit(False))
             .when(~F.coalesce(ordering | op.isin("=", "!=", "contains"), F.lit(False)), F.lit(False)))
    lines = stage(lines.where(F.col("destination_id").isNotNull()).select(
        F.col("destination_id").cast("string").alias("destination_id"),
        F.coalesce(F.col("match_mode") == "any", F.lit(False)).alias("any"), "position", "column",
        "operator", value.alias("text"), number.alias("num"), fixed.alias("fixed")), "conditions")
    live = lines.where("column is not null and fixed is null")
    seen = live.groupBy("column").agg(
        F.count_distinct(F.when(op == "=", F.col("text"))).alias("values"),
        F.percentile_approx(F.when(ordering, F.col("num")), [i / (1 << LEVELS) for i in range(1, 1 << LEVELS)], 10_000).alias("cuts"),
    ).collect()
    used = {r["column"]: r for r in seen}
    columns = tuple(n for n in names if n in used)
    number_by_name = {n: i for i, n in enumerate(columns)}
    cuts = {i: _padded(used[n]["cuts"]) for n, i in number_by_name.items() if used[n]["cuts"] is not None}
    idx = F.lit(-1)
    for n, i in number_by_name.items():
        idx = F.when(F.col("column") == n, F.lit(i)).otherwise(idx)
    test = F.struct(idx.alias("idx"), "operator", "text", "num")
    varies = F.col("column").isNotNull() & F.col("fixed").isNull()
    per = lines.groupBy("destination_id").agg(
        F.bool_or("any").alias("any"), (F.count("column") == 0).alias("all_rows"),
        F.coalesce(F.bool_or("fixed"), F.lit(False)).alias("some_true"),
        F.coalesce(~F.bool_and("fixed"), F.lit(False)).alias("some_false"),
        F.transform(F.array_sort(F.collect_list(F.when(varies, F.struct("position", test.alias("t"))))),
                    lambda p: p["t"]).alias("tests"))
    none = F.slice("tests", 1, 0)
    always = F.col("all_rows") | F.when(F.col("any"), F.col("some_true")).otherwise(
        ~F.col("some_false") & (F.size("tests") == 0))
    per = per.withColumn("always", always)
    whole = per.where("always or (not any and not some_false)").select(
        "destination_id", F.when(F.col("always"), none).otherwise(F.col("tests")).alias("must"), none.alias("unless"))
    each = per.where("any and not always").select("destination_id", "tests", F.posexplode("tests").alias("at", "test")).select(
        "destination_id", F.array("test").alias("must"), F.expr("slice(tests, 1, at)").alias("unless"))
    equal = tuple(i for n, i in number_by_name.items() if used[n]["values"])
    return ConditionIndex(stage(whole.unionByName(each), "condition-sets"), lines.select("destination_id").distinct(),
                          columns, equal, cuts, tuple(used[n]["values"] for n in columns) or (0,))


def _row_ranges(column: int, finest: Column) -> Column:
    """Keys of the ranges of every size that a row is in."""
    return _once(finest, lambda b: F.array(*[
        _range_key(column, level, F.shiftright(b, level)) for level in range(LEVELS + 1)]))


def _holds(test: Column) -> Column:
    """Whether one test of an entry holds for the row beside it."""
    text, number = F.get(F.col("__texts"), test["idx"]), F.get(F.col("__numbers"), test["idx"])
    op, bound = test["operator"], test["num"]
    return F.coalesce(
        F.when(op == "=", text == test["text"]).when(op == "!=", text != test["text"])
        .when(op == "contains", F.contains(F.lower(text), F.lower(test["text"])))
        .when(op == ">", number > bound).when(op == ">=", number >= bound)
        .when(op == "<", number < bound).when(op == "<=", number <= bound), F.lit(False))


def _looked_up(combined: Combined, index: ConditionIndex, used: Collection[str] | None = None) -> list[Column]:
    """What a row is looked up and tested by; evaluated on source columns.

    ``used`` are the beginnings of keys that anything is filed under, if known.
    """
    def wanted(begin: str) -> bool:
        return used is None or begin in used

    types = {f.name: f.dataType for f in combined.df.schema.fields}
    texts, numbers = [], []
    for name in index.columns:
        c = F.col(f"`{name}`")
        number, here = number_of(c, types[name]), combined.present.get(name)
        texts.append(text_of(c, types[name]))
        numbers.append(number if here is None else F.when(here, number))
    keys = [F.concat(F.lit(f"e{i}:"), texts[i]) for i in index.equal if wanted(f"e{i}")]
    keys += [F.lit(EVERY)] if wanted(EVERY) else []
    ranges = [_row_ranges(i, _bin(numbers[i], cuts)) for i, cuts in index.cuts.items() if wanted(f"r{i}")]
    return [F.array(*[t.cast("string") for t in texts]).cast("array<string>").alias("__texts"),
            F.array(*numbers).cast("array<double>").alias("__numbers"),
            F.array_compact(F.concat(F.array(*keys).cast("array<string>"), *ranges)).alias("__keys")]


def _met(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``rows`` once per entry that wants them."""
    keyed = rows.withColumn("__key", F.explode("__keys")).drop("__keys")
    named = {"key": "__key", "destination_id": "__destination", "must": "__must", "unless": "__unless"}
    entries = entries.withColumnsRenamed(named)
    pairs = keyed.join(broadcast_if_small(entries), "__key", "inner")
    return pairs.where(F.forall("__must", _holds) & ~F.exists("__unless", _holds)).drop(
        "__key", "__must", "__unless", "__texts", "__numbers")


def indexed_rows(combined: Combined, mappings: Sequence[Mapping], index: ConditionIndex,
                 carry: Sequence[Column] = ()) -> DataFrame:
    """Every mapped row once per destination whose conditions it meets.

    The rows of ``fanout_rows`` without those of the primary target.
    """
    rows = combined.df.select(*mapping_columns(combined.df, mappings), *carry, *_looked_up(combined, index))
    met = _met(rows, index.entries)
    return met.select(F.col("__destination").alias("destination_id"),
                      *[F.col(f"`{c}`") for c in met.columns if c != "__destination"])


#: What is left of an ordering when it must not hold; beside a number either it or its opposite holds.
OPPOSITE = {">": "<=", ">=": "<", "<": ">=", "<=": ">"}


def _intervals(wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``by``, the column an entry wants an interval of, if it wants nothing else.

    Such an entry may leave out rows found by value (``unless`` of ``=``). Where
    it leaves out rows by an ordering of its own column, that becomes a bound.
    """
    by = F.get("must", F.lit(0))["idx"]
    opposite = F.create_map(*[F.lit(x) for pair in OPPOSITE.items() for x in pair])

    def ordering(c: Column) -> Column:
        return (c["idx"] == F.col("by")) & c["operator"].isin(*OPPOSITE)

    turned = F.transform(F.filter("unless", ordering), lambda c: F.struct(
        c["idx"].alias("idx"), opposite[c["operator"]].alias("operator"), c["text"].alias("text"), c["num"].alias("num")))
    alone = (F.size("must") > 0) & F.forall("must", ordering) & F.forall(
        "unless", lambda c: ordering(c) | (c["operator"] == "="))
    found = wanted.withColumn("by", by).withColumn("alone", F.coalesce(alone, F.lit(False)))
    return found.select(
        "destination_id", F.when(F.col("alone"), F.concat("must", turned)).otherwise(F.col("must")).alias("must"),
        F.when(F.col("alone"), F.filter("unless", lambda c: ~ordering(c))).otherwise(F.col("unless")).alias("unless"),
        F.when(F.col("alone"), F.col("by")).alias("by"))


def _sums_between(rows: DataFrame, intervals: DataFrame, columns: Sequence[int]) -> DataFrame:
    """``destination_id, records, bytes`` of intervals from sums along each column, without a pair of row and interval."""
    each = F.filter(F.array(*[F.struct(F.lit(i).alias("by"), (F.get("__numbers", F.lit(i)) + F.lit(0.0)).alias("at")) for i in columns]),
                    lambda p: p["at"].isNotNull())
    points = rows.select(F.inline(each), "__bytes").groupBy("by", "at").agg(
        F.count(F.lit(1)).alias("records"), F.sum("__bytes").alias("bytes"))
    # A bound stands before or behind the rows of its value.
    side = F.when(F.col("t.operator").isin(">=", "<"), F.lit(-1)).otherwise(F.lit(1))
    lower = F.col("t.operator").isin(*LOWER_BOUNDS)
    number = intervals.select(F.monotonically_increasing_id().alias("entry"), "destination_id", "by", "must")
    number = stage(number, "intervals")
    bounds = number.select("entry", "by", F.explode("must").alias("t")).select(
        "entry", "by", (F.col("t.num") + F.lit(0.0)).alias("at"), side.alias("side"), lower.alias("lower"))
    none = F.lit(0).cast("bigint")
    line = points.select("by", "at", F.lit(0).alias("side"), "records", "bytes", F.lit(None).cast("bigint").alias("entry"),
                         F.lit(None).cast("boolean").alias("lower")).unionByName(
        bounds.select("by", "at", "side", none.alias("records"), none.alias("bytes"), "entry", "lower"))
    # Stretches of the line, each summed in a task of its own, and what comes before each.
    line = stage(line.repartitionByRange("by", "at").withColumn("part", F.spark_partition_id()), "line")
    parts = line.groupBy("by", "part").agg(F.sum("records").alias("r"), F.sum("bytes").alias("b"))
    before = Window.partitionBy("by").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("by", "part", *[F.coalesce(F.sum(c).over(before), none).alias(c) for c in ("r", "b")])
    along = Window.partitionBy("by", "part").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    summed = line.select("by", "part", "entry", "lower", *[F.sum(c).over(along).alias(c) for c in ("records", "bytes")])
    placed = summed.where("entry is not null").join(F.broadcast(parts), ["by", "part"]).select(
        "by", "entry", "lower", (F.col("records") + F.col("r")).alias("records"), (F.col("bytes") + F.col("b")).alias("bytes"))
    whole = line.groupBy("by").agg(F.sum("records").alias("r"), F.sum("bytes").alias("b"))
    # The highest lower bound and the lowest upper one; sums never fall along the line, so each column's extreme is theirs.
    ends = placed.groupBy("entry", "by").agg(*[
        f(F.when(F.col("lower") == low, F.col(c))).alias(f"{c}{int(low)}")
        for c in ("records", "bytes") for f, low in ((F.max, True), (F.min, False))])
    inside = [F.greatest(F.coalesce(f"{c}0", t) - F.coalesce(f"{c}1", none), none).alias(c) for c, t in (("records", "r"), ("bytes", "b"))]
    sums = ends.join(F.broadcast(whole), "by").select("entry", *inside)
    return number.select("entry", "destination_id").join(sums, "entry").drop("entry")


def indexed_summary(combined: Combined, mappings: Sequence[Mapping], index: ConditionIndex) -> DataFrame:
    """Rows and bytes of the primary target and of each destination, none left out.

    The result of ``fanout_summary``, as a shuffle of one partial sum per task
    and destination in place of a row as wide as there are destinations. Entries
    that are one interval, or want every row, meet no rows one by one.
    """
    wanted = _intervals(index.wanted)
    every = (F.size("must") == 0) & (F.size("unless") == 0)
    spans = wanted.where("by is not null")
    # Rows of an interval that it leaves out as found by value are counted by pairs, and taken off.
    off = spans.select("destination_id", "must", "unless", F.posexplode("unless").alias("at", "test")).select(
        "destination_id", F.concat("must", F.array("test")).alias("must"), F.expr("slice(unless, 1, at)").alias("unless"))
    rest = wanted.where(F.col("by").isNull() & ~every).select("destination_id", "must", "unless")
    filed = stage(_access(rest.withColumn("sign", F.lit(1)).unionByName(off.withColumn("sign", F.lit(-1))),
                          index.weights, index.cuts), "condition-index")
    # Rows are only looked up by what is filed there.
    used = {r.k for r in filed.select(F.split("key", ":")[0].alias("k")).distinct().collect()}
    rows = mapped_with_bytes(combined, mappings, _looked_up(combined, index, used))
    totals = [F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("__bytes"), F.lit(0)).alias("bytes")]
    primary = rows.agg(*totals).select(F.lit(PRIMARY).alias("destination_id"), "records", "bytes")
    met = _met(rows.select("__texts", "__numbers", "__keys", "__bytes"), filed)
    signed = [F.sum("sign").alias("records"), F.sum(F.col("sign") * F.col("__bytes")).alias("bytes")]
    sums = met.groupBy("__destination").agg(*signed).select(F.col("__destination").alias("destination_id"), "records", "bytes")
    columns = sorted(r.by for r in spans.select("by").distinct().collect())
    if columns:
        sums = sums.unionByName(_sums_between(rows.select("__numbers", "__bytes"), spans, columns))
    sums = sums.unionByName(wanted.where(every).select("destination_id").crossJoin(
        F.broadcast(primary.select("records", "bytes"))))
    sums = sums.groupBy(F.col("destination_id").alias("__destination")).agg(
        F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))
    named = index.destinations.join(sums, F.col("destination_id") == F.col("__destination"), "left").select(
        "destination_id", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return primary.unionByName(named)
