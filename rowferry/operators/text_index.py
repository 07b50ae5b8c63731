"""Substring search in a growing log through an index of its trigrams.

Each batch of entries is numbered and written by day. For every trigram of a
day's texts a bitmap tells which of up to 32,768 numbered entries have it. A
search reads the bitmaps of the trigrams of its text only, intersects them, opens
the days that are left and verifies the entries by the plain search. No trigram
gathers a list: one that all entries have is one bitmap per 32,768 of them.
Bitmaps are made from whole columns of texts, by numpy in the tasks that read them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.operators.listings import search_log
from rowferry.operators.sizing import broadcast_if_small

#: Columns the log search looks at.
LOG_TEXTS = ("action", "pipeline_name", "details")
#: A search whose hits are spread over more days than this leaves the pruning of days to the join.
DAYS = 3660
GRAM = 3
#: Entries of a bitmap, as Spark's bitmap functions have them.
BITS = 32_768
#: Trigrams of one bitmap's entries that a task holds, and bitmaps that it makes at a time.
HELD, AT_ONCE = 4_000_000, 128
_GRAMS = "gram string, bucket bigint, bits binary, batch int, log_day string"


def _grams(text: Column) -> Column:
    """The distinct pieces of three characters of a text."""
    chars = F.transform(F.array(F.split(text, "")), lambda c: F.transform(
        c, lambda x, i: F.concat(x, F.get(c, i + 1), F.get(c, i + 2))))[0]
    return F.array_distinct(F.array_compact(chars))


def _triples(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all trigrams, three of 21 bits in a number, and the places of their texts."""
    texts = texts.to_pylist()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if len(points) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    inside = owner[:-2] == owner[2:]
    return codes[inside], owner[:-2][inside]


def _bitmaps(day: str, bucket: int, codes: list[np.ndarray], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    codes, places = np.concatenate(codes), np.concatenate(places)
    order = np.argsort(codes)
    codes, places = codes[order], places[order]
    begin = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])[:len(codes)]
    ends = np.r_[begin[1:], len(codes)]
    for a in range(0, len(begin), AT_ONCE):
        first, last = begin[a:a + AT_ONCE], ends[a:a + AT_ONCE]
        bits = np.zeros((len(first), BITS), bool)
        bits[np.repeat(np.arange(len(first)), last - first), places[first[0]:last[-1]]] = True
        packed = np.packbits(bits, axis=1, bitorder="little")
        mask = (1 << 21) - 1
        grams = ["".join(map(chr, (c >> 42, c >> 21 & mask, c & mask))) for c in codes[first].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([day] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array([bucket] * len(grams), pa.int64()),
             pa.array([row.tobytes() for row in packed], pa.binary())], ["log_day", "gram", "bucket", "bits"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the entries (``log_day``, ``log_no``, ``text``); those of one bitmap follow each other for the most part."""
    at, codes, places, held = None, [], [], 0
    for batch in batches:
        days = pc.dictionary_encode(batch.column(0))
        day, no = days.indices.to_numpy(), batch.column(1).to_numpy() - 1
        bucket = no // BITS
        cuts = np.flatnonzero(np.r_[True, (day[1:] != day[:-1]) | (bucket[1:] != bucket[:-1])])[:len(no)]
        for a, b in zip(cuts, np.r_[cuts[1:], len(no)], strict=False):
            here = days.dictionary[int(day[a])].as_py(), int(bucket[a]) + 1
            if held and (here != at or held > HELD):
                yield from _bitmaps(*at, codes, places)
                codes, places, held = [], [], 0
            at = here
            found, owner = _triples(batch.column(2).slice(a, b - a))
            codes.append(found)
            places.append((no[a:b] % BITS)[owner])
            held += len(found)
    if held:
        yield from _bitmaps(*at, codes, places)


def index_batch(entries: DataFrame, place: str, batch: int, ts: str = "ts", texts: Sequence[str] = LOG_TEXTS) -> None:
    """Add the entries of one batch to the index below ``place``.

    A batch that is repeated replaces itself. Entries without a time stand under
    a day of their own. Texts are compared in lower case; NULL ones have no
    trigrams. The columns of the last batch are those a search returns.
    """
    day = F.coalesce(F.to_date(ts).cast("string"), F.lit("none"))
    log, grams = f"{place}/log/batch={batch}", f"{place}/grams/batch={batch}"
    # Entries of a day get numbers near each other, so its bitmaps are few; a large day is spread over several tasks.
    dealt = entries.withColumn("log_day", day).repartitionByRange(F.col("log_day"), F.xxhash64(*texts, ts))
    numbered = dealt.sortWithinPartitions("log_day").withColumn("log_no", F.monotonically_increasing_id() + 1)
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("log_day").parquet(log)
    numbered.limit(0).write.mode("overwrite").parquet(f"{place}/columns")
    text = F.lower(F.concat_ws("\n", *texts))
    each = entries.sparkSession.read.schema(numbered.schema).parquet(log).select("log_day", "log_no", text.alias("text"))
    posted = each.mapInArrow(_posted, "log_day string, gram string, bucket bigint, bits binary")
    posted = posted.groupBy("log_day", "gram", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    # Sorted by trigram, so that row groups are skipped by their bounds.
    posted.repartitionByRange("log_day", "gram").sortWithinPartitions("log_day", "gram").write.mode("overwrite").option(
        "partitionOverwriteMode", "static").partitionBy("log_day").parquet(grams)


def search_index(spark: SparkSession, place: str, text: str, status: str = "all") -> DataFrame:
    """The entries that :func:`search_log` finds in all batches, read from the days that can have them.

    Texts of less than three characters have no trigram; for them, all entries are scanned.
    """
    kept = spark.read.parquet(f"{place}/columns").schema
    log = spark.read.schema(kept.add("batch", T.IntegerType())).parquet(f"{place}/log")
    columns = [c for c in log.columns if c not in ("log_day", "log_no", "batch")]
    needle = text.lower()
    pieces = spark.range(1).select(_grams(F.lit(needle)).alias("g")).first().g if needle else []
    pieces = [p for p in pieces if p]
    if len(needle) < GRAM or not pieces:
        return search_log(log, text, status).select(*columns)
    found = spark.read.schema(_GRAMS).parquet(f"{place}/grams").where(F.col("gram").isin(pieces)).groupBy("batch", "log_day", "bucket").agg(
        F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n")).where(
        (F.col("n") == len(pieces)) & (F.bitmap_count("bits") > 0)).drop("n")
    days = [r.log_day for r in found.select("log_day").distinct().limit(DAYS + 1).collect()]
    if len(days) <= DAYS:
        log = log.where(F.col("log_day").isin(days))
    at = F.bitmap_bit_position("log_no")
    byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = log.withColumn("bucket", F.bitmap_bucket_number("log_no")).join(
        broadcast_if_small(found), ["batch", "log_day", "bucket"])
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2.0), at % 8)), F.lit(2)) == 1
    return search_log(near.where(hit), text, status).select(*columns)
