"""Propose column mappings for many pairs of tables at once.

Input are two catalogs, columns (``pair``, ``ordinal``, ``name``, ``type``):
source columns and target columns of each pair of tables. A pair is matched by
similarity of normalised names and by type class, one to one.

All columns of a pair meet in one row: two arrays no longer than its tables are
wide, folded by array functions inside the JVM. Scores of column pairs exist
only while they are compared; no row per column pair is ever produced, and the
only shuffle is the one by ``pair``.

Lambdas of array functions are interpreted, so they do as little as can be:
they see plain arrays of normalised names and numbers of type classes, and give
positions. All else is worked out per column or per match, in compiled code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.functions.coerce import BLANKS, round_half_up

# Weights of the score, the score a fuzzy match must exceed, the
# confidence shown at most, the characters a normalised name leaves out, and the
# words that tell the class of a type, in the order they are tried.
NAME_WEIGHT = 0.75
TYPE_WEIGHT = 0.25
FLOOR = 0.35
TOP_CONFIDENCE = 0.99
SEPARATORS = "_-" + BLANKS
TYPE_CLASSES = [
    ("numeric", ("int", "numeric", "decimal", "float", "double", "real", "number")),
    ("string", ("char", "text", "string", "clob")),
    ("date", ("date", "time")),
    ("boolean", ("bool",)),
]
HIGH_CONFIDENCE = 0.9
# Fixed value: warning where the type classes differ, around the two type names.
WARNING = ("Type mismatch: source is ", ", target is ",
           ". Verify conversion is safe before running.")


def normalized(name: Column) -> Column:
    """Lower case without underscores, blanks and hyphens."""
    return F.translate(F.lower(name), SEPARATORS, "")


def type_class(type_name: Column) -> Column:
    """``numeric``, ``string``, ``date``, ``boolean`` or ``other``.

    Nested types are *other*, whatever their element types are called.
    """
    return _classified(type_name, [name for name, _ in TYPE_CLASSES], "other")


def _classified(type_name: Column, values: list, other) -> Column:
    """The value of ``type_name``'s class, ``other`` if it has none."""
    t = F.lower(type_name)
    nested = t.startswith("struct<") | t.startswith("array<") | t.startswith("map<")
    chain = F.when(nested, F.lit(other))
    for value, (_, words) in zip(values, TYPE_CLASSES, strict=True):
        chain = chain.when(reduce(lambda a, b: a | b, [t.contains(w) for w in words]), F.lit(value))
    return chain.otherwise(F.lit(other))


def name_similarity(a: Column, a_len: Column, b: Column, b_len: Column) -> Column:
    """1 for equal names, less by their edit distance over the longer length."""
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b) / F.greatest(a_len, b_len))


def score(s, t) -> Column:
    """Score of a source column and a target column, each with its normalised name ``norm``, that name's length ``len``
    and its type class ``cls``."""
    same = F.when(s["cls"] == t["cls"], F.lit(TYPE_WEIGHT)).otherwise(F.lit(0.0))
    return name_similarity(s["norm"], s["len"], t["norm"], t["len"]) * F.lit(NAME_WEIGHT) + same


def shown_confidence(value: Column) -> Column:
    return round_half_up(F.least(F.lit(TOP_CONFIDENCE), value), 2)


def type_warning(s: Column, t: Column) -> Column:
    """Warning text, NULL where the type classes agree."""
    before, between, after = (F.lit(part) for part in WARNING)
    return F.when(s["cls"] != t["cls"], F.concat(before, s["type"], between, t["type"], after))


def _by_pair(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row per pair with both column lists ``ss`` and ``ts``, each in table order.

    A name listed twice counts once, where it comes first; columns without a name
    do not count. Normalised names and numbers of type classes are worked out
    after the shuffle, which need not carry them.
    """
    def tagged(df: DataFrame, side: int) -> DataFrame:
        return df.select("pair", F.lit(side).alias("side"), "ordinal", "name", "type")

    def first(columns: str) -> Column:
        names = F.col(columns)["name"]
        repeats = F.size(F.array_distinct(names)) < F.size(columns)
        kept = _let(names, lambda ns: F.filter(columns, lambda c, i: F.array_position(ns, c["name"]) == i + 1))
        return F.when(repeats, kept).otherwise(F.col(columns))

    # Moved before it is collected: there is nothing to combine on the map side.
    both = tagged(source, 0).unionByName(tagged(target, 1)).repartition("pair")
    classes = _classified(F.col("type"), list(range(1, len(TYPE_CLASSES) + 1)), 0)
    described = both.select("*", normalized(F.col("name")).alias("norm"), classes.alias("cls"))
    # What collect_list is given is interpreted too. That two fields are made of ``norm`` keeps the optimizer from moving
    # the compiled projection into it.
    column = F.struct("side", "ordinal", "name", "type", "norm", F.length("norm").alias("len"), "cls")
    listed = described.groupBy("pair").agg(
        F.sort_array(F.collect_list(F.when(F.col("norm").isNotNull(), column))).alias("both"),
        F.count_if((F.col("side") == 0) & F.col("norm").isNotNull()).cast("int").alias("n"))
    split = listed.select("pair", F.slice("both", F.lit(1), F.col("n")).alias("ss"),
                          F.slice("both", F.col("n") + 1, F.size("both")).alias("ts"))
    return split.select("pair", first("ss").alias("ss"), first("ts").alias("ts"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside a lambda.

    A fold over nothing that ends in ``body``. An element of a transformed array would do as well, but taking one works out
    the array's type at each evaluation, and with it the types of all that is nested in ``body``.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def _lists(columns: str, body) -> Column:
    """``body`` of the columns' normalised names, their lengths and type classes, an array each by its name."""
    def bind(fields: tuple, bound: dict) -> Column:
        if not fields:
            return body(bound)
        return _let(F.col(columns)[fields[0]], lambda a: bind(fields[1:], {**bound, fields[0]: a}))

    return bind(("norm", "len", "cls"), {})


def _at(lists: dict, i: Column) -> dict:
    return {field: F.get(a, i) for field, a in lists.items()}


def _exact(sn: Column, tn: Column) -> Column:
    """Per source the position of the target with the same normalised name, -1 without: the first such source gets the
    first such target, the second the second, and so on."""
    def later(n: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(sn, F.lit(1), i), lambda x: x == n))
        places = F.filter(F.transform(tn, lambda x, j: F.when(x == n, j).otherwise(F.lit(-1))), lambda j: j >= 0)
        return F.coalesce(F.get(places, before), F.lit(-1))

    def settle(n: Column, i: Column) -> Column:
        place = (F.array_position(tn, n) - 1).cast("int")
        # Most names have no equal, and most that have one are the first of their kind.
        return F.when(place < 0, F.lit(-1)).when(F.array_position(sn, n) == i + 1, place).otherwise(later(n, i))

    return F.transform(sn, settle)


def _best(scores: Column) -> Column:
    """Position of the highest score, the first among equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _matches(ss: dict, ts: dict, floor: float) -> Column:
    """Per source the position of its target, -1 without: the exact pass, then a fold over the sources it left."""
    def chosen(i: Column, free: Column) -> Column:
        scores = F.transform(free, lambda t: score(_at(ss, i), _at(ts, t)))
        return _let(scores, lambda of: F.when(F.array_max(of) > F.lit(floor), F.get(free, _best(of))).otherwise(F.lit(-1)))

    def fold(exact: Column, every: Column) -> Column:
        # The state is what the exact pass took, followed by the target of each source so far.
        def step(state: Column, i: Column) -> Column:
            place = F.get(exact, i)
            left = _let(F.array_except(every, state), lambda free: chosen(i, free))
            return F.concat(state, F.array(F.when(place >= 0, place).otherwise(left)))

        n = F.size(ss["norm"])
        return F.slice(F.aggregate(F.transform(ss["norm"], lambda _, i: i), exact, step), n + 1, n)

    return _let(_exact(ss["norm"], ts["norm"]), lambda exact: _let(
        F.transform(ts["norm"], lambda _, j: j), lambda every: fold(exact, every)))


def _matched(pairs: DataFrame, places: Column) -> DataFrame:
    """A row per source column with a target: pair, ``s_no``, both columns ``s`` and ``t``, and their score."""
    # The outer form of explode: the plain one makes the optimizer add a filter
    # on the array, and with it a second evaluation of the whole fold.
    rows = pairs.withColumn("places", places).select("pair", "ss", "ts", F.posexplode_outer("places").alias("s_no", "t_no"))
    found = rows.where("t_no >= 0").select("pair", "s_no", F.get("ss", F.col("s_no")).alias("s"),
                                           F.get("ts", F.col("t_no")).alias("t"))
    return found.withColumn("score", score(F.col("s"), F.col("t")))


def match_schemas(source: DataFrame, target: DataFrame, floor: float = FLOOR) -> DataFrame:
    """One-to-one mapping of each pair's source columns to its target columns.

    Equal normalised names are settled first, over all source columns. Each
    remaining source column, in order, then gets the best free target, if the
    score exceeds ``floor``. Names may repeat within a pair; the first counts.
    The only shuffle is the one by pair, and lists of positions stand for columns
    while they are matched.
    """
    found = _matched(_by_pair(source, target), _lists("ss", lambda ss: _lists("ts", lambda ts: _matches(ss, ts, floor))))
    return found.select(
        "pair",
        F.col("s_no").alias("source_ordinal"),
        F.col("s.name").alias("source_col"), F.col("t.name").alias("target_col"),
        F.col("s.type").alias("source_type"), F.col("t.type").alias("target_type"),
        shown_confidence(F.col("score")).alias("confidence"),
        type_warning(F.col("s"), F.col("t")).alias("warning"),
    )


def best_candidates(source: DataFrame, target: DataFrame) -> DataFrame:
    """Best target of every source column regardless of what others take."""
    def best(ss: dict, ts: dict) -> Column:
        return F.transform(ss["norm"], lambda _, i: _let(
            F.transform(ts["norm"], lambda _, j: score(_at(ss, i), _at(ts, j))), _best))

    found = _matched(_by_pair(source, target), _lists("ss", lambda ss: _lists("ts", lambda ts: best(ss, ts))))
    return found.select("pair", F.col("s.name").alias("source_col"), F.col("t.name").alias("target_col"), "score")


# -- candidate columns -------------------------------------------------------

def candidate_columns(primary: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    """Columns a mapping may draw from: the primary table's, then joined tables'.

    ``joined`` has a further column ``source_no``. Of equal names within a pair
    the first is kept; an aggregate, so repeated names are dropped map-side.
    """
    first = listed_columns(primary, joined).groupBy("pair", "name").agg(F.min(F.struct("ordinal", "type")).alias("m"))
    return first.select("pair", F.col("m.ordinal").alias("ordinal"), "name", F.col("m.type").alias("type"))


def listed_columns(primary: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    """As :func:`candidate_columns`, repeated names included, which matching drops itself behind its own shuffle."""
    # Position among all candidates of a pair, in (source, ordinal) order.
    def ranked(df: DataFrame, no: Column) -> DataFrame:
        return df.select("pair", (no * F.lit(1_000_000) + F.col("ordinal")).alias("ordinal"), "name", "type")

    columns = ranked(primary, F.lit(0))
    return columns if joined is None else columns.unionByName(ranked(joined, F.col("source_no").cast("int")))


def targets_or_sources(target: DataFrame, primary: DataFrame) -> DataFrame:
    """Target columns; pairs whose target has none yet take the primary source's."""
    known = target.select(F.col("pair").alias("__pair")).distinct()
    fill = primary.join(known, F.col("pair") == F.col("__pair"), "left_anti")
    columns = ["pair", "ordinal", "name", "type"]
    return target.select(*columns).unionByName(fill.select(*columns))


def mapping_quality(mappings: DataFrame) -> DataFrame:
    """Per pair: average confidence in percent, warnings, high-confidence columns.

    Confidences have two decimals, so they are averaged as whole percents: the
    sum is exact and does not depend on the order of the rows.
    """
    percent = F.round(F.col("confidence") * F.lit(100.0)).cast("bigint")
    return mappings.groupBy("pair").agg(
        F.count(F.lit(1)).alias("columns"),
        round_half_up(F.avg(percent)).cast("bigint").alias("avg_confidence_pct"),
        F.count_if(F.col("warning").isNotNull()).alias("warnings"),
        F.count_if(F.col("confidence") >= HIGH_CONFIDENCE).alias("high_confidence"),
    )
