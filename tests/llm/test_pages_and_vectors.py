"""Operators over pages and embeddings."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowferry.llm import html_text, neighbours, warc
from rowferry.llm.components import components
from rowferry.llm.html_text import main_text
from rowferry.session import scratch_path


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def pages(spark):
    body = "<p>" + "One sentence, with commas, in a paragraph. " * 5 + "</p>"
    long_page = f"<article>{body * 3000}</article>"
    data = [
        (1, "http://www.Example.org:80/a?x=1#top", f"<article><h1>T</h1>{body}</article>"),
        (1, "http://www.Example.org:80/a?x=1#top", f"<article><h1>T</h1>{body}</article>"),
        (2, "https://b.example.org/", None), (3, None, ""), (None, "not a url", f"<article><h1>T</h1>{body}</article>"),
        (4, "https://b.example.org/", long_page), (5, "https://example.org/\r\nEvil: x", "<p>x"), (6, "http://[", ""),
        (7, "https://b.example.org/", f"<article><h1>T</h1>{body}</article>"),
    ]
    extra = [(*r, "n", 7, 1) for r in data]
    return spark.createDataFrame(
        extra, "page_id long, url string, html string, text string, n_chars int, payload int").repartition(3)


# main text (op6)


def test_article_without_what_surrounds_it():
    p = "This is a sentence of the article, long enough, with commas, to count as a paragraph."
    page = f"""<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad --><div class="ad">Buy, now, this, please, today.</div>
    <div id=cookie-notice><p>We use cookies, and so on, and on, and on, as all do.</p></div>
    <div class="post"><h2>Title &amp; more</h2><p>{p}<p><b>{p}<br>next&nbsp;line</b>
    <p>short</p><ul><li>an item<li>another</ul><table><tr><td>cell<td>two</table><pre>  code
      here</pre><form><p>{p} in a form</p></form><div class="comments"><p>{p} by a reader</p></div></div>
    <aside><p>{p} aside</p></aside><footer>&copy; <p>{p}</p></footer></body></html>"""
    assert main_text(page) == "\n\n".join(
        ["Title & more", p, f"{p} next line", "short", "an item", "another", "cell", "two", "code here"])


def test_siblings_join_and_menus_do_not():
    p = "Some words, many words, and still more words, for a paragraph of text that counts. " * 3
    page = f"<body><div><p>{p}</p><p>{p}</p></div><div><p>{p}</p></div><div><a href=x>{'link ' * 30}</a></div></body>"
    assert main_text(page) == "\n\n".join([" ".join(p.split())] * 3)


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), ("<nav><p>only, a, menu, here, and nothing, else at all</p></nav>", ""),
    ("<article>tiny &lt;b&gt; &am", "tiny <b> &am"), ("<article><p>cut off in a tag <a href='", "cut off in a tag"),
    ("<article>a < b and 5 > 4</article>", "a < b and 5 > 4"), ("<article>x<!-- never closed <p>y", "x"),
    ("<main><p>one</p><script>if (a</script>two</main>", "one\n\ntwo"), ("<div>" * 5000 + "<article>deep</article>", "deep"),
])
def test_odd_pages(page, want):
    assert main_text(page) == want


def test_extract_of_odd_pages(pages):
    got = rows(html_text.extract(pages))
    assert len(got) == pages.count()
    assert all(g["n_chars"] == len(g["text"]) for g in got)
    assert {g["page_id"]: g["n_chars"] for g in got}[4] > 500_000
    assert html_text.extract(pages.limit(0)).count() == 0


def test_whole_article_of_the_given_pages(spark):
    import html
    import re

    data = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {g["page_id"]: g["text"] for g in rows(html_text.extract(data))}
    for page in rows(data):
        inner = page["html"].split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        parts = re.split(r"</?p>|</?h1>", re.sub(r"<br>", " ", re.sub(r"</?b>|<[^>]*$", "", inner)))
        want = [" ".join(html.unescape(x).split()) for x in parts]
        assert got[page["page_id"]] == "\n\n".join(x for x in want if x)


# archives (op4)


def test_archives_of_odd_pages(spark, pages):
    index = warc.archive(spark, pages)
    got = rows(warc.read_all(index))
    source = rows(pages)
    assert len(got) == len(source)
    largest = {}
    for p in source:
        key = p["html"] or ""
        if p["page_id"] is not None:
            largest[key] = max(largest.get(key, -1), p["page_id"])
    for p in source:
        payload = (p["html"] or "").encode()
        mine = [g for g in got if g["page_id"] == p["page_id"]]
        assert mine
        for g in mine:
            assert g["payload_bytes"] == len(payload)
            assert g["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            keeper = largest.get(p["html"] or "")
            assert (g["record_type"], g["refers_to"]) == (
                ("response", None) if p["page_id"] == keeper else ("revisit", keeper))
            assert g["payload"] == (payload if g["record_type"] == "response" else None)


def test_lookup_finds_all_captures_of_a_url(spark, pages):
    folder = scratch_path(spark, "warc")
    index = warc.build_index(warc.write_archives(pages, folder), folder, block_lines=2)
    assert index.directory.count() >= 4
    assert sorted(r["page_id"] for r in warc.lookup(index, "https://b.example.org")) == [2, 4, 7]
    assert [r["page_id"] for r in warc.lookup(index, "http://example.org/a?x=1")] == [1, 1]
    assert warc.lookup(index, "https://nowhere.example.org/") == []


def test_small_payloads_are_all_responses(spark, pages):
    folder = scratch_path(spark, "warc")
    index = warc.build_index(warc.write_archives(pages, folder, min_bytes=10), folder)
    empty = [g for g in rows(warc.read_all(index)) if g["payload_bytes"] == 0]
    assert len(empty) == 3 and {g["record_type"] for g in empty} == {"response"}


def test_url_keys_sort_by_host():
    assert warc.url_key("https://www.Example.org:8080/a/B?q=1#f") == "org,example:8080)/a/B?q=1"
    assert warc.url_key(None) == "" and warc.url_key("http://b.a.org") == "org,a,b)/"


def test_no_pages(spark, pages):
    assert warc.read_all(warc.archive(spark, pages.limit(0))).count() == 0


# neighbours (op5)


def _exact(ids, vectors, queries, k):
    out = {}
    norm = [v / np.sqrt((v * v).sum()) for v in vectors]
    for q in queries:
        i = ids.index(q)
        scored = sorted(((-float(norm[i] @ norm[j]), ids[j]) for j in range(len(ids)) if j != i))[:k]
        out[q] = [(b, -a) for a, b in scored]
    return out


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    same = [(i, good[0][1]) for i in range(100, 140)]  # a hot vector
    scaled = [(200, [x * 1e150 for x in good[1][1]]), (201, [x * 1e-150 for x in good[1][1]])]
    bad = [(300, None), (301, [0.0] * 8), (302, [math.nan] * 8), (303, [None] + [1.0] * 7), (304, [math.inf] * 8),
           (305, []), (None, good[2][1]), (306, [1.0] * 5)]
    table = spark.createDataFrame([(*r, "n", 1.0, 5) for r in good + same + scaled + bad],
                                  "vec_id long, embedding array<double>, node string, score double, query int")
    got = {}
    for r in rows(neighbours.search(neighbours.build(table), table.where("vec_id % 50 = 0"), 5)):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    kept = good + same + scaled
    ids, vectors = [r[0] for r in kept], [np.array(r[1]) / np.abs(r[1]).max() for r in kept]
    want = _exact(ids, vectors, [0, 50, 100, 200], 5)
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        for (_, v, s), (w, t) in zip(found, want[q]):
            assert abs(s - t) < 1e-12 and (v == w or abs(dict(want[q]).get(v, s) - t) < 1e-12)
    assert [f[1] for f in got[0]] == [100, 101, 102, 103, 104] and [f[1] for f in got[100]] == [0, 101, 102, 103, 104]


def test_few_or_no_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = rows(neighbours.search(neighbours.build(table), table.where("vec_id % 50 = 0"), 5))
    assert sorted((g["query_id"], g["rank"], g["vec_id"]) for g in got) == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    none = table.limit(0)
    assert neighbours.search(neighbours.build(none), none, 5).count() == 0


def test_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in rows(neighbours.search(neighbours.build(table), table.where("vec_id % 50 = 0"), 5)):
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    data = rows(table.orderBy("vec_id"))
    want = _exact([d["vec_id"] for d in data], [np.array(d["embedding"], float) for d in data], sorted(got), 5)
    hits = sum(len(got[q] & {v for v, _ in want[q]}) for q in got)
    assert len(got) == 40 and hits >= 0.9 * 5 * len(got)


def _dense(spark, size=3000, width=8):
    """A third of the rows lie close together without being equal."""
    rng = np.random.default_rng(4)
    center = rng.normal(size=width)
    vectors = [center + rng.normal(size=width) * 0.02 if i % 3 == 0 else rng.normal(size=width) for i in range(size)]
    return vectors, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)],
                                          "vec_id long, embedding array<double>")


def test_leaves_of_a_dense_group_hold_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 32)
    vectors, table = _dense(spark)
    links = neighbours.build(table, iterations=0).links
    lists = {r["node"]: set(np.frombuffer(r["ids"], np.int64).tolist()) for r in rows(links)}
    want = _exact(list(range(len(vectors))), vectors, list(range(0, 3000, 90)), 5)
    hits = sum(v in lists[q] for q, found in want.items() for v, _ in found)
    assert hits >= 0.6 * 5 * len(want), hits / (5 * len(want))


def test_recall_in_a_dense_group(spark, monkeypatch):
    for name, value in (("LEAF", 32), ("EXPAND", 8), ("POOL", 24)):  # a walk can't visit everything
        monkeypatch.setattr(neighbours, name, value)
    vectors, table = _dense(spark)
    got = {}
    for r in rows(neighbours.search(neighbours.build(table), table.where("vec_id % 90 = 0"), 5)):
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = _exact(list(range(len(vectors))), vectors, sorted(got), 5)
    hits = sum(len(got[q] & {v for v, _ in want[q]}) for q in got)
    assert len(got) == 34 and hits >= 0.9 * 5 * len(got), hits / (5 * len(got))


def test_equal_vectors_in_single_precision_fit_in_leaves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 32)
    table = spark.createDataFrame([(i, [1.0, 2.0, 3.0 + i * 1e-12]) for i in range(100)],
                                  "vec_id long, embedding array<double>")
    assert neighbours.search(neighbours.build(table), table.where("vec_id = 0"), 5).count() == 5


# components


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(90)]
    edges += [(2000, 2000), (5000, 5001), (5001, 5000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {n: find(n) for n in parent if n != 2000 and any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(1, 2)], "a long, b long")).select(F.max("root")).first()[0] == 1
