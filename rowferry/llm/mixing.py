"""Mixing sources to target weights by entropy balancing.

Document rates minimise their relative entropy to 1 under the condition that
each source gives its target number of words and no rate is above a limit. The
solution is an exponential tilt, ``min(limit, exp(multiplier * size))``, with
one multiplier per source; the convex dual is solved by safeguarded Newton
iterations whose gradient and curvature are aggregated in Spark. Systematic
rounding turns rates into whole copies. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowferry.operators.sizing import BROADCAST_ROWS, broadcast_if_small
from rowferry.session import stage

#: Weights given to the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this, so no target is above this many times its source's size.
LIMIT = 3
#: A source is solved when its words are within this share of the target.
TOLERANCE = 1e-7
MAX_STEPS = 200
#: So often one document of each source is rounded the other way to come nearer to the target.
SETTLING = 3
#: Rates are added up in integer units, so that sums don't depend on the order of rows.
UNIT = 1 << 32


def size_of(text):
    """Number of words of a text, 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``source, source_no, source_size, target`` from rows of ``source, size, n``.

    Targets share all words by weight; one above ``limit`` times its source's
    size stops there and the excess is shared again. That ends at
    ``min(limit * size, level * weight)`` with one level for all, found here in
    one pass over the sources in the order in which they reach their limit.
    """
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") - 1) % len(weights) + 1)
    filling = Window.orderBy("full_at", "source_no")
    everything = Window.partitionBy(F.lit(0))
    out = (
        by_source.withColumn("source_no", no).withColumn("w", w).withColumn("most", F.col("source_size") * limit)
        .withColumn("full_at", F.col("most") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("w").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    )
    level = F.min_by(F.when(F.col("full_at") > F.col("level"), F.col("level")),
                     F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "source_no"))).over(everything)
    return out.withColumn("final", level).select(
        "source", "source_no", "source_size",
        F.least(F.col("most").cast("double"), F.coalesce(F.col("final") * F.col("w"), F.col("most").cast("double")))
        .alias("target"))


def solve(sizes: DataFrame, goals: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The multiplier of each source: ``source_no, tilt`` from ``source_no, size, n`` and :func:`targets`.

    The multiplier is per word. Each step is one aggregation over the distinct
    sizes of all sources; sums are decimal, hence the same in every run.
    """
    known = F.col("size") > 0
    moments = sizes.where(known).groupBy("source_no").agg(
        F.min("size").alias("least"), F.sum("n").alias("docs"))
    ratio = F.col("target") / F.col("source_size")
    flat = F.abs(ratio - 1) <= TOLERANCE
    full = ratio >= limit * (1 - TOLERANCE)
    # At the outer end all rates are at the limit, or all together below what is needed.
    end = F.when(ratio > 1, F.lit(math.log(limit))).otherwise(F.log(ratio)) / F.col("least")
    state = goals.join(moments, "source_no").select(
        "source_no", "target",
        F.when(full, end).otherwise(F.lit(0.0)).alias("tilt"),
        F.least(F.lit(0.0), end).alias("low"), F.greatest(F.lit(0.0), end).alias("high"),
        (full | flat).alias("done"))
    state = stage(state, "mix-step")
    few = F.broadcast if goals.count() <= BROADCAST_ROWS else (lambda df: df)
    for _ in range(MAX_STEPS):
        if state.where(~F.col("done")).limit(1).count() == 0:
            break
        tilted = F.exp(F.col("tilt") * F.col("size"))
        mass = F.col("n") * F.col("size")
        exact = "decimal(38,9)"
        step = (
            sizes.where(known).join(few(state.where(~F.col("done"))), "source_no")
            .groupBy("source_no").agg(
                F.sum((mass * F.least(F.lit(float(limit)), tilted)).cast(exact)).cast("double").alias("words"),
                F.sum(F.when(tilted < limit, mass * F.col("size") * tilted).otherwise(0.0).cast(exact))
                .cast("double").alias("slope"))
        )
        over = F.col("words") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("tilt"))
        high = F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - (F.col("words") - F.col("target")) / F.nullif(F.col("slope"), F.lit(0.0))
        settled = (F.abs(F.col("words") - F.col("target")) <= TOLERANCE * F.col("target")) | (
            high - low <= 1e-16 * F.greatest(F.abs(low), F.abs(high)))
        moved = state.join(step, "source_no", "left").withColumns({"low2": low, "high2": high})
        within = (newton > F.col("low2")) & (newton < F.col("high2"))
        state = stage(moved.select(
            "source_no", "target",
            F.when(F.col("done") | settled, F.col("tilt"))
            .when(within, newton).otherwise((F.col("low2") + F.col("high2")) / 2).alias("tilt"),
            F.when(F.col("done"), F.col("low")).otherwise(F.col("low2")).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(F.col("high2")).alias("high"),
            (F.col("done") | settled).alias("done")), "mix-step")
    else:
        if state.where(~F.col("done")).limit(1).count():
            raise RuntimeError(f"a source did not settle in {MAX_STEPS} steps")
    return state.select("source_no", "tilt")


def _settle(placed: DataFrame) -> DataFrame:
    """Round one document per source the other way, that whose size is nearest to what the source lacks or has over."""
    lack = placed.groupBy("source_no").agg(
        (F.round(F.max("target")) - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("lack"))
    lack = broadcast_if_small(stage(lack, "mix-lack"))
    step = F.when(F.col("lack") > 0, 1).otherwise(-1)
    free = F.when(F.col("lack") > 0, F.col("copies") < F.ceil("rate")).otherwise(F.col("copies") > F.floor("rate"))
    gain = F.abs("lack") - F.abs(F.abs("lack") - F.col("size"))
    turned = placed.join(lack, "source_no").where((F.col("lack") != 0) & free & (gain > 0)).groupBy("source_no").agg(
        F.max_by(F.struct("row", step.alias("step")), F.struct(gain, -F.coalesce("doc_id", F.lit(0)), -F.col("row")))
        .alias("turn")).select("turn.row", F.col("turn.step").alias("step"))
    turned = broadcast_if_small(stage(turned, "mix-turned"))
    return placed.join(turned, "row", "left").withColumn(
        "copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("step")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        keep: tuple[str, ...] = (), weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Copies of every document for the mix.

    Returns ``doc_id, size, source_size, target, rate, copies, taken``, and the
    input columns named in ``keep`` in a struct ``kept``; it travels through
    every step, so let it be a key rather than texts. A null text has size
    0, a null source is a source of its own, sorted last. Documents of size 0
    give no words: they are taken once (``rate`` 1). Repeated rows are each
    mixed on their own, rows alike in id and text in either order. An empty
    table gives an empty result. Other columns are not read. Copies are the
    rates rounded systematically in order of size, which keeps a source's words
    within about one document of its target; then single documents are
    rounded the other way where that comes nearer.
    """
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"),
        size_of(docs[text_col].cast("string")).alias("size"),
        F.xxhash64(docs[text_col].cast("string")).alias("hash"),
        F.struct(*[docs[f"`{c}`"].alias(c) for c in keep]).alias("kept") if keep
        else F.lit(None).cast("string").alias("kept"))
    rows = stage(rows, "mix-sizes")
    counts = stage(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    goals = stage(targets(counts, weights, limit), "mix-targets")
    named = counts.join(broadcast_if_small(goals.select("source", "source_no")),
                        counts["source"].eqNullSafe(goals["source"])).select("source_no", "size", "n")
    tilts = solve(named, goals, limit)
    goals = goals.withColumnRenamed("source", "of").join(tilts, "source_no", "left")

    # Sizes with six leading bits in common form a class; a class is dealt into about as many lots as a lot has rows.
    shift = F.expr("shiftleft(cast(1 as bigint), cast(greatest(0, floor(log2(cast(greatest(size, 1) as double)))"
                   " - 5) as int))")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(float(limit)), F.exp(F.coalesce(F.col("tilt"), F.lit(0.0)) * F.col("size"))))
    units = F.round(rate * F.lit(float(UNIT))).cast("long")
    class_of = F.col("size") - F.pmod(F.col("size"), shift)
    lots_table = named.withColumn("class", class_of).groupBy("source_no", "class").agg(
        F.ceil(F.sqrt(F.sum("n").cast("double"))).cast("int").alias("lots")).join(
        goals.select("of", "source_no", "source_size", "target", "tilt"), "source_no")
    lots_table = stage(lots_table, "mix-lots")
    a, b = rows.withColumn("class_", class_of), broadcast_if_small(lots_table)
    dealt = a.join(b, a["source"].eqNullSafe(b["of"]) & (a["class_"] == b["class"])).select(
        "doc_id", "size", "hash", "kept", "source_no", "class", "source_size", "target", rate.alias("rate"),
        units.alias("units"),
        F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "size", "hash"), F.col("lots")).cast("int").alias("lot"))
    lots = dealt.groupBy("source_no", "class", "lot").agg(F.sum(F.col("units").cast("decimal(38,0)")).alias("units"))
    lots = stage(lots, "mix-lot-sums")
    classes = lots.groupBy("source_no", "class").agg(F.sum("units").alias("units"))
    upto = Window.unboundedPreceding
    classes = classes.select("source_no", "class", F.coalesce(F.sum("units").over(
        Window.partitionBy("source_no").orderBy("class").rowsBetween(upto, -1)), F.lit(0)).alias("from_class"))
    offsets = lots.join(classes, ["source_no", "class"]).select(
        "source_no", "class", "lot", F.pmod(F.col("from_class") + F.coalesce(F.sum("units").over(
            Window.partitionBy("source_no", "class").orderBy("lot").rowsBetween(upto, -1)), F.lit(0)),
            F.lit(UNIT).cast("decimal(38,0)")).cast("long").alias("from_lot"))
    placed = dealt.withColumn("upto", F.sum("units").over(
        Window.partitionBy("source_no", "class", "lot").orderBy("size", "doc_id", "hash").rowsBetween(upto, 0)))
    half = UNIT // 2
    placed = placed.join(broadcast_if_small(stage(offsets, "mix-offsets")), ["source_no", "class", "lot"])
    copies = F.expr(f"(from_lot + upto + {half}) div {UNIT} - (from_lot + upto - units + {half}) div {UNIT}")
    placed = placed.withColumn("copies", copies.cast("int")).drop("class", "lot", "units", "upto", "from_lot", "hash")
    # The numbers given to rows are fixed by writing them down.
    placed = stage(placed.withColumn("row", F.monotonically_increasing_id()), "mix-placed")
    for _ in range(SETTLING):
        placed = _settle(placed)
    return placed.select("doc_id", "size", "source_size", "target", "rate", "copies",
                         (F.col("copies") * F.col("size")).alias("taken"), *(["kept"] if keep else []))
