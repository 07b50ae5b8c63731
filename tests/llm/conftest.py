import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity: nulls, empty and long texts, repeated rows, ties, columns with clashing names."""
    long_text = " ".join(f"w{i % 977} v{i}" for i in range(30_000))
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (1, line, "en", "a"), (1, line, "en", "a"), (2, line.upper(), "en", None), (3, "", "en", "b"),
        (4, None, None, "b"), (None, line, "en", "c"), (5, long_text, "de", "c"), (6, " \t\n", "en", "a"),
        (7, "one two three", "en", "é"), (8, "one two three", "en", "z"), (9, line + " extra", "en", "a"),
        (10, "Größe naïve   日本語 text x", "ja", ""), (11, "x" * 70_000, "en", "a"),
    ]
    extra = [(*r, len(r[1] or ""), 0.5, "node", i, "mine") for i, r in enumerate(rows)]
    return spark.createDataFrame(
        extra, "doc_id long, text string, lang string, source string, n_chars long, score double, node string, "
               "row long, tokens string")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([
        (1, "alpha beta gamma delta epsilon zeta eta theta iota. Kappa lambda mu nu xi omicron pi"),
        (2, None), (None, ""), (3, "one"), (3, "one"), (4, "Nothing of this stands anywhere. Not even its answer"),
    ], "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (2, 1, 0), (3, 0, 0), (4, 0, None), (None, 1, 1), (5, 1, 0), (7, 0, 1), (8, None, 1),
         (9, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
