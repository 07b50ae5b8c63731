import random

from pyspark.sql import functions as F

from rowferry.operators import matching as S

CATALOG = "pair string, ordinal int, name string, type string"


def catalog(spark, names, pair="p"):
    rows = [(pair, i, n, t) for i, (n, t) in enumerate(names)]
    return spark.createDataFrame(rows, CATALOG)


def pairs(df):
    return sorted((r.source_col, r.target_col, r.confidence) for r in df.collect())


def test_exact_names_are_settled_before_weak_ones(spark):
    source = catalog(spark, [("code", "text"), ("region_name", "text")])
    target = catalog(spark, [("region_name", "text")])
    assert pairs(S.match_schemas(source, target)) == [("region_name", "region_name", 0.99)]
    alone = S.match_schemas(catalog(spark, [("code", "text")]), target)
    assert pairs(alone) == [("code", "region_name", 0.4)]


def test_names_are_normalised_and_types_warned_about(spark):
    source = catalog(spark, [("Customer-ID", "int"), ("created at", "timestamp")])
    target = catalog(spark, [("customer_id", "varchar(20)"), ("createdat", "date")])
    got = {r.source_col: r for r in S.match_schemas(source, target).collect()}
    assert got["Customer-ID"].confidence == 0.75
    assert got["Customer-ID"].warning == (
        "Type mismatch: source is int, target is varchar(20). Verify conversion is safe before running.")
    assert got["created at"].confidence == 0.99 and got["created at"].warning is None


def test_type_classes(spark):
    kinds = {"INT": "numeric", "interval": "numeric", "point": "numeric", "decimal(10,2)": "numeric",
             "nvarchar": "string", "datetime": "date", "timestamp": "date", "bool": "boolean",
             "bit": "other", "uuid": "other", "money": "other", "struct<a:int>": "other"}
    df = spark.createDataFrame([(k,) for k in kinds], "t string")
    got = {r.t: r.c for r in df.select("t", S.type_class(F.col("t")).alias("c")).collect()}
    assert got == kinds


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def by_hand(source, target, cls):
    """Independent statement of the rules for one pair."""
    norm = {n: "".join(ch for ch in n.lower() if ch not in "_- \t\n") for n, _ in source + target}
    free, out, late = list(target), [], []
    for name, kind in source:
        same = [t for t in free if norm[t[0]] == norm[name]]
        if same:
            free.remove(same[0])
            out.append((name, same[0][0], 1.0 if cls[kind] == cls[same[0][1]] else 0.75))
        else:
            late.append((name, kind))
    for name, kind in late:
        scored = []
        for t in free:
            a, b = norm[name], norm[t[0]]
            scored.append(((1 - edit_distance(a, b) / max(len(a), len(b))) * 0.75
                           + (0.25 if cls[kind] == cls[t[1]] else 0.0), t))
        if scored:
            top = max(s for s, _ in scored)
            t = next(t for s, t in scored if s == top)
            if top > 0.35:
                free.remove(t)
                out.append((name, t[0], top))
    return sorted((s, t) for s, t, _ in out)


def test_random_pairs_against_brute_force(spark):
    rng = random.Random(5)
    cls = {"int": "numeric", "text": "string", "date": "date", "uuid": "other"}
    words = ["id", "name", "code", "order", "total", "date", "Cust", "region", "_key"]

    def table():
        names = {}
        for _ in range(rng.randint(1, 9)):
            sep = rng.choice(["", "_", " ", "-"])
            names[sep.join(rng.choices(words, k=rng.randint(1, 3)))] = rng.choice(list(cls))
        return list(names.items())

    cases = {f"p{i}": (table(), table()) for i in range(120)}
    flat = [[(p, i, n, t) for p, sides in cases.items() for i, (n, t) in enumerate(sides[k])] for k in (0, 1)]
    source, target = (spark.createDataFrame(rows, CATALOG) for rows in flat)
    got = {p: [] for p in cases}
    for r in S.match_schemas(source, target).collect():
        got[r.pair].append((r.source_col, r.target_col))
    for p, (s, t) in cases.items():
        assert sorted(got[p]) == by_hand(s, t, cls), (p, s, t)
        assert len({x for x, _ in got[p]}) == len({y for _, y in got[p]}) == len(got[p])


def test_no_row_per_column_pair(spark):
    source, target = catalog(spark, [("a", "int")]), catalog(spark, [("b", "int")])
    plan = S.match_schemas(source, target)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert plan.count("Exchange") == 1


def test_wide_tables(spark):
    names = [(f"column_{i:03d}", "int") for i in range(150)]
    got = S.match_schemas(catalog(spark, names), catalog(spark, list(reversed(names)))).collect()
    assert len(got) == 150 and all(r.source_col == r.target_col for r in got)


def test_candidates_and_fallback(spark):
    primary = catalog(spark, [("id", "int"), ("name", "text")])
    joined = catalog(spark, [("name", "blob"), ("tier", "text")]).withColumn("source_no", F.lit(1))
    got = S.candidate_columns(primary, joined).orderBy("ordinal").collect()
    assert [(r.name, r.type) for r in got] == [("id", "int"), ("name", "text"), ("tier", "text")]
    empty = spark.createDataFrame([], CATALOG)
    same = S.match_schemas(S.candidate_columns(primary, joined), S.targets_or_sources(empty, primary))
    assert pairs(same) == [("id", "id", 0.99), ("name", "name", 0.99)]


def test_sources_without_targets_match_nothing(spark):
    assert S.match_schemas(catalog(spark, [("a", "int")]), spark.createDataFrame([], CATALOG)).count() == 0


def test_quality(spark):
    df = spark.createDataFrame([("p", 0.99, None), ("p", 0.6, "w")], "pair string, confidence double, warning string")
    assert tuple(S.mapping_quality(df).first()) == ("p", 2, 80, 1, 1)


def test_matching_shuffles_once_and_takes_wide_tables(spark):
    n = 2000
    side = lambda prefix: spark.range(n).selectExpr("'p' pair", "cast(id as int) ordinal", f"concat('{prefix}', id) name", "'int' type")
    found = S.match_schemas(side("Col_"), side("col-"))
    assert found.count() == n and found.filter("confidence < 0.99").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_normalised_names_leave_out_every_blank(spark):
    blanks = "".join(chr(c) for c in (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                                      0x205F, 0x3000, 0xFEFF))
    df = spark.createDataFrame([("A" + blanks + "_-b",)], "n string")
    assert df.select(S.normalized(F.col("n")).alias("n")).first().n == "ab"


def test_lambdas_neither_normalise_nor_classify(spark):
    """Lambdas and what collect_list is given are interpreted: 20 searches of a type's name there took most of the time."""
    source, target = catalog(spark, [("a", "int")]), catalog(spark, [("b", "int")])
    for found in (S.match_schemas(source, target), S.best_candidates(source, target)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # A blank in the list of separators breaks its line in two.
        nodes = plan.replace(S.SEPARATORS, "").split("\n")
        slow = [n for n in nodes if "lambdafunction(" in n or "collect_list(" in n]
        assert slow and not [n for n in slow if "translate(" in n or "Contains(" in n or "StartsWith(" in n]
        assert any("translate(" in n for n in nodes) and any("Contains(" in n for n in nodes)


def test_repeated_and_missing_names(spark):
    """Names alike once normalised are paired in order, the rest fall to the fold; a column listed twice counts once."""
    source = catalog(spark, [("a_b", "int"), (None, "int"), ("A B", "text"), ("a_b", "date"), ("ab", None), ("AB_", "int")])
    target = catalog(spark, [("zz", "int"), ("AB", "int"), (None, "text"), ("a-b", "bigint"), ("abx", "int"), ("AB", "int")])
    assert pairs(S.match_schemas(source, target)) == [("A B", "a-b", 0.75), ("a_b", "AB", 0.99), ("ab", "abx", 0.5)]
    got = S.match_schemas(source, target).orderBy("source_ordinal").collect()
    assert [(r.source_ordinal, r.source_col, r.warning) for r in got][0] == (0, "a_b", None)
    best = sorted((r.source_col, r.target_col, r.score) for r in S.best_candidates(source, target).collect())
    assert best == [("A B", "AB", 0.75), ("AB_", "AB", 1.0), ("a_b", "AB", 1.0), ("ab", "AB", 0.75)]
