"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm import (
    collocations, decontamination, fingerprints, html_text, mixing, near_duplicates, neighbours, quality, repair, runs,
    secret_links, toxicity, warc,
)
from rowferry.llm.ship import ship
from rowferry.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op6_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@_query
def op7_secret_scan(spark, sf_dir):
    """Secrets and linked credential parts of every document."""
    return secret_links.digest(secret_links.scan(table(spark, sf_dir, "documents")))


@_query
def op8_mix_sources(spark, sf_dir):
    """Words that a mix to target weights takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "rate", F.col("copies").cast("long").alias("copies"))


@_query
def op4_warc_index(spark, sf_dir):
    """Pages written as WARC records and read back through the capture index."""
    records = warc.read_all(warc.archive(spark, table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


# All pairs that share a shingle, then the smallest id that links lead to.
SQL["op9_ngram_jaccard_join"] = r"""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents),
      w AS (SELECT doc_id, len(ws) AS words, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM t),
      five AS (SELECT doc_id, words, i, concat_ws(' ', x, lead(x, 1) OVER d, lead(x, 2) OVER d, lead(x, 3) OVER d, lead(x, 4) OVER d) AS shingle
        FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
      s AS MATERIALIZED (SELECT DISTINCT doc_id, shingle FROM five WHERE i = 1 OR i + 4 <= words),
      n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
      links AS MATERIALIZED (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
      reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
    SELECT d.doc_id, cast(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.least AS component_id FROM documents d LEFT JOIN n USING (doc_id)
    JOIN (SELECT x, min(y) AS least FROM reach GROUP BY 1) m ON m.x = d.doc_id"""


@_query
def op9_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose word shingles are alike."""
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


@_query
def op10_toxicity(spark, sf_dir):
    """Toxicity of every document by a factorization machine fitted on the labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@_query
def op2_quality(spark, sf_dir):
    """Quality of every document by attention over its passages, fitted on the labels."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@_query
def op3_token_ids(spark, sf_dir):
    """Token ids of every document, written as grammar-compressed shards and read back."""
    import public_tokenizers

    return repair.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op1_decontamination(spark, sf_dir):
    """Benchmark items that documents hold."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op5_nearest_neighbours(spark, sf_dir):
    """The five nearest vectors of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(neighbours.build(vectors), vectors.where("vec_id % 50 = 0"), 5)


@_query
def op11_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@_query
def op12_periodic_runs(spark, sf_dir):
    """Periodic runs of words of every document, repetition brought into some of them by their ids."""
    return runs.digests(runs.periodic_runs(table(spark, sf_dir, "documents"), alter=runs.altered))


# A phrase is its words joined by a space, which no word holds.
SQL["op13_collocations"] = r"""
    WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
      pieces AS (SELECT d, lang, generate_subscripts(ps, 1) AS p, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM t),
      w AS (SELECT d, lang, p, unnest(ws) AS x1, generate_subscripts(ws, 1) AS i FROM pieces),
      four AS MATERIALIZED (SELECT lang, x1, lead(x1, 1) OVER o AS x2, lead(x1, 2) OVER o AS x3, lead(x1, 3) OVER o AS x4
        FROM w WINDOW o AS (PARTITION BY d, p ORDER BY i)),
      f AS MATERIALIZED (SELECT lang, phrase, count(*) AS f FROM (
        SELECT lang, x1 AS phrase FROM four UNION ALL SELECT lang, x1 || ' ' || x2 FROM four
        UNION ALL SELECT lang, x1 || ' ' || x2 || ' ' || x3 FROM four
        UNION ALL SELECT lang, x1 || ' ' || x2 || ' ' || x3 || ' ' || x4 FROM four) WHERE phrase IS NOT NULL GROUP BY 1, 2),
      total AS (SELECT lang, count(*) AS n FROM four GROUP BY 1),
      c AS MATERIALIZED (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE f >= 30 AND contains(phrase, ' ')),
      places AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest
        FROM c, (SELECT unnest([1, 2, 3]) AS k) WHERE k < len(ws)),
      cuts AS (SELECT places.*, x.f AS l, y.f AS r, cast(cast(2000000 AS HUGEINT) * a // (x.f + y.f) AS BIGINT) AS score FROM places
        JOIN f x ON x.lang = places.lang AND x.phrase = head JOIN f y ON y.lang = places.lang AND y.phrase = rest),
      lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
      parts AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS part FROM c, (SELECT unnest([2, 3]) AS m),
        (SELECT unnest([1, 2, 3]) AS i) WHERE m < len(ws) AND i + m - 1 <= len(ws)),
      inside AS (SELECT lang, part, max(a) AS most FROM parts GROUP BY 1, 2),
      kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND part = phrase
        WHERE most IS NULL OR cast(100 AS HUGEINT) * most < cast(80 AS HUGEINT) * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN total USING (lang)
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


@_query
def op13_collocations(spark, sf_dir):
    """The first 2000 phrases of each language."""
    found = collocations.phrases(table(spark, sf_dir, "documents"))
    return found.withColumn("rank", F.col("rank").cast("long"))
