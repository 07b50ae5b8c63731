"""Phrases whose words belong together, mined with stripes.

A stripe is keyed by the words before and counts the words that come next: the
stripe of no words counts single words, that of one word its pairs, and so on.
Tasks fill stripes over a few megabytes of text, Spark merges them element by
element, and the merged stripes hold all there is to know: a phrase is an
element of its prefix's stripe, the total of a prefix is its own element one
stripe earlier, and the largest element is the largest phrase that begins with
the prefix.

Nearly all elements are rare, and a frequent phrase has only frequent parts.
So a first pass counts hashes of words and pairs, exactly enough never to miss
a frequent one, and keeps those found often enough in a filter of fixed size. A
second pass does so with phrases of three and four words whose pairs the filter
lets through. The last pass fills stripes, with the words themselves, where the
filter lets a phrase and all its parts through; what came through by chance
falls away when the counts are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowferry.llm.words import buffers, cut_out, groups, hashes, mix, spans, trimmed
from rowferry.session import stage

#: Candidates occur at least so often and have 2 to ``LONGEST`` words.
LEAST, LONGEST = 30, 4
#: A candidate goes if a longer one holds it in at least this share (in percent) of its places.
SUBSUMED = 80
#: Phrases reported for each language.
TOP = 2000
#: Scores are counted in millionths.
UNIT = 1_000_000
#: Texts are counted together up to about this many bytes; of a longer one, parts that end where a piece ends.
CHUNK_BYTES = 4 << 20
#: Bytes of text for one range of hashes.
RANGE_BYTES = 24 << 20
#: The filter has two to this power bits, whatever the input.
FILTER_BITS = 28
#: Phrases of a language are ranked in so many lots first.
LOTS = 64
#: Stripes are cut by a hash of the next word into so many, by the number of words before.
SLICES = (4096, 64, 16, 16)
UNKNOWN = "und"

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_WORD = ~_PIECE
_WORD[[0x20, 9]] = False


def _parts(lang, text: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """One text in parts of about :data:`CHUNK_BYTES`, cut where a piece ends."""
    data, _ = buffers(text)
    at = 0
    while at < len(data):
        end = at + CHUNK_BYTES
        while end < len(data):
            cut = np.flatnonzero(_PIECE[data[end:end + CHUNK_BYTES]])
            if len(cut):
                end += int(cut[0])
                break
            end += CHUNK_BYTES
        yield lang, pa.array([data[at:end].tobytes()], pa.binary()).cast(pa.large_string())
        at = end


def _chunks(batches) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Languages and texts, about :data:`CHUNK_BYTES` at a time."""
    held, size = [], 0
    for batch in batches:
        for piece in groups(batch, 1):
            mine = piece.column(1).nbytes
            if piece.num_rows == 1 and mine > CHUNK_BYTES:
                yield from _parts(piece.column(0), piece.column(1))
                continue
            held.append(piece)
            size += mine
            if size >= CHUNK_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                yield tuple(table.column(i).combine_chunks() for i in range(2))
                held, size = [], 0
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield tuple(table.column(i).combine_chunks() for i in range(2))


class _Words:
    """The words of a chunk: ``at`` numbers each in the order of the text, distinct by language."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        data, offsets = buffers(texts)
        starts, ends, first = spans(data, offsets, kind=_WORD)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        piece = np.cumsum(_PIECE[data])[starts]
        #: Whether the next word follows within the piece.
        self.joined = np.r_[(piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1]), False][:len(starts)]
        coded = pc.dictionary_encode(cut_out(_LOWER[data], starts, ends))
        words = coded.dictionary
        codes = pc.dictionary_encode(pc.fill_null(langs.cast(pa.large_string()), UNKNOWN))
        lang_of = codes.indices.to_numpy().astype(np.int64)[doc]
        both, self.at, self.count = np.unique(
            lang_of * max(1, len(words)) + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
        self.lang_at, word = both // max(1, len(words)), both % max(1, len(words))
        self.langs, self.word = codes.dictionary, words.take(pa.array(word))
        #: Words by language.
        self.totals = np.bincount(lang_of, minlength=len(self.langs))

        def hashed(strings: pa.Array) -> np.ndarray:
            d, o = buffers(strings)
            return hashes(d, o[:-1], o[1:])

        self.hash = mix(hashed(words)[word] ^ mix(hashed(self.langs))[self.lang_at]) if len(words) else np.zeros(0, _U)

    def phrases(self, let_through: _Filter) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Distinct phrases that pass the filter, by the number ``k`` of words before the last, from 1.

        Gives ``k``, the number of each phrase's beginning among the phrases
        given before (a word's own number for ``k`` = 1), its last word, its
        hash and its count, sorted by beginning.
        """
        n = max(1, len(self.word))
        hashed = self.hash
        often = let_through(hashed, 1)
        stands = np.where(often[self.at], self.at, -1) if len(self.at) else self.at
        place = np.flatnonzero(self.joined)
        place = place[(stands[place] >= 0) & (stands[place + 1] >= 0)]
        for k in range(1, LONGEST):
            both, name, count = np.unique(stands[place] * n + self.at[place + k], return_inverse=True, return_counts=True)
            first, last = both // n, both % n
            hashed = mix(hashed[first] * _U(3) + mix(self.hash[last]))
            good = let_through(hashed, k + 1)
            yield k, first[good], last[good], hashed[good], count[good]
            if k == LONGEST - 1 or not good.any():
                return
            # Those kept are numbered; the next ones begin and end with one of them.
            number = np.where(good, np.cumsum(good) - 1, -1)
            hashed = hashed[good]
            stands = np.full(len(self.at) + 1, -1, np.int64)
            stands[place] = number[name]
            place = place[(stands[place] >= 0) & (stands[place + 1] >= 0)]


class _Filter:
    """Tells hashes that may be frequent, of phrases of up to ``known`` words; lets all longer ones through."""

    def __init__(self, held: bytes | None, known: int):
        self.table = np.frombuffer(held, np.uint8) if known else None
        self.known = known
        self.bits = (8 * len(held or b"")).bit_length() - 1

    def __call__(self, hashed: np.ndarray, words: int) -> np.ndarray:
        if words > self.known:
            return np.ones(len(hashed), bool)
        place = (hashed >> _U(64 - self.bits)).astype(np.int64)
        return (self.table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _sketched(docs: DataFrame, bits: int, held, known: int) -> DataFrame:
    """Hashes of words and pairs, or with a filter of longer phrases, with their counts up to :data:`LEAST`.

    They are packed by range of hashes.
    """
    def run(batches):
        let_through = _Filter(held.value if held else None, known)
        for langs, texts in _chunks(batches):
            w = _Words(langs, texts)
            tokens, counts = ([w.hash], [w.count]) if known == 0 else ([], [])
            for k, _, _, hashed, count in w.phrases(let_through):
                if k >= known:
                    tokens.append(hashed)
                    counts.append(count)
                if k == (1 if known == 0 else LONGEST - 1):
                    break
            if not tokens:
                continue
            token, count = np.concatenate(tokens), np.minimum(np.concatenate(counts), LEAST).astype(np.uint8)
            order = np.argsort(token)
            token, count = token[order], count[order]
            part = (token >> _U(64 - bits)).astype(np.int64)
            short = (token >> _U(32 - bits)).astype(np.uint32)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])[:len(part)]
            ends = np.r_[cut[1:], len(part)][:len(cut)]
            for at in range(0, len(cut), 64):
                some = list(zip(cut[at:at + 64], ends[at:at + 64], strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(part[cut[at:at + 64]]), pa.array([short[a:b].tobytes() for a, b in some], pa.binary()),
                    pa.array([count[a:b].tobytes() for a, b in some], pa.binary())], ["range", "tokens", "counts"])

    return docs.mapInArrow(trimmed(run), "range long, tokens binary, counts binary")


def _frequent(bits: int):
    def run(group: pa.Table) -> pa.Table:
        token = np.concatenate([np.frombuffer(x, np.uint32) for x in group.column("tokens").to_pylist()])
        count = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("counts").to_pylist()])
        order = np.argsort(token, kind="stable")
        token, count = token[order], count[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        often = token[first[np.add.reduceat(count, first) >= LEAST]].astype(np.uint64)
        whole = _U(group.column("range")[0].as_py()) << _U(64 - bits) | often << _U(32 - bits)
        return pa.table({"place": (whole >> _U(64 - FILTER_BITS)).astype(np.int64)})

    return run


def _filter(docs: DataFrame, bits: int):
    """Broadcast bits for the leading bits of each frequent hash; their size is fixed."""
    held, shared = np.zeros((1 << FILTER_BITS) // 8, np.uint8), None
    for known in (0, 2):
        places = _sketched(docs, bits, shared, known).groupBy("range").applyInArrow(_frequent(bits), "place long")
        number = F.col("place") + 1
        for bucket, bitmap in places.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(
                F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")).collect():
            held[(bucket - 1) * 4096:bucket * 4096] |= np.frombuffer(bitmap, np.uint8)
        if shared is not None:
            shared.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(held.tobytes())
    return shared


_STRIPES = "lang string, k int, prefix string, nexts array<string>, counts array<long>"


def _stripe_rows(w: _Words, k: int, prefix: pa.Array, key: np.ndarray, following: np.ndarray,
                 count: np.ndarray) -> pa.RecordBatch:
    """Stripes of ``k`` words before; elements come sorted by ``key``, the row of ``prefix``."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[:len(key)]
    offsets = pa.array(np.r_[cut, len(key)].astype(np.int32))
    lang = w.langs.take(pa.array(w.lang_at[following[cut]]))
    nexts = w.word.take(pa.array(following)).cast(pa.string())
    return pa.RecordBatch.from_arrays([
        lang.cast(pa.string()), pa.array(np.full(len(cut), k, np.int32)), prefix.take(pa.array(key[cut])).cast(pa.string()),
        pa.ListArray.from_arrays(offsets, nexts), pa.ListArray.from_arrays(offsets, pa.array(count))],
        [c.split()[0] for c in _STRIPES.split(", ")])


def _chunk_stripes(w: _Words, let_through: _Filter) -> Iterator[pa.RecordBatch]:
    blank = pa.array([""] * len(w.langs), pa.large_string())
    # All words of a language are counted under the empty word.
    yield pa.RecordBatch.from_arrays([
        w.langs.cast(pa.string()), pa.array(np.zeros(len(w.langs), np.int32)), blank.cast(pa.string()),
        pa.array([[""]] * len(w.langs), pa.list_(pa.string())),
        pa.array([[int(t)] for t in w.totals], pa.list_(pa.int64()))], [c.split()[0] for c in _STRIPES.split(", ")])
    at = np.flatnonzero(let_through(w.hash, 1))
    if not len(at):
        return
    yield _stripe_rows(w, 0, blank, w.lang_at[at], at, w.count[at])
    begin = w.word
    for k, key, following, _, count in w.phrases(let_through):
        if not len(key):
            return
        yield _stripe_rows(w, k, begin, key, following, count)
        begin = pc.binary_join_element_wise(
            begin.take(pa.array(key)), w.word.take(pa.array(following)), pa.scalar(" ", pa.large_string()))


def stripes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Merged stripes: ``lang, k, prefix, slice, nexts, most`` for prefixes of up to three words.

    ``nexts`` maps each next word to how often it follows the ``k`` words of
    ``prefix`` within a piece, for those that do so at least :data:`LEAST`
    times; ``most`` is the largest of these counts. A stripe of many words is
    cut into slices by their hashes. The stripe of no words counts single words,
    and under the empty word all words of the language.
    """
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, min(31, int(total // RANGE_BYTES).bit_length()))
    held = _filter(rows, bits)

    def run(batches):
        let_through = _Filter(held.value, LONGEST)
        for langs, texts in _chunks(batches):
            yield from _chunk_stripes(_Words(langs, texts), let_through)

    filled = rows.mapInArrow(trimmed(run), _STRIPES)
    merged = filled.select("lang", "k", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("one")).groupBy(
        "lang", "k", "prefix", F.col("one.nexts").alias("next")).agg(F.sum("one.counts").alias("n")).where(
        (F.col("n") >= LEAST) | (F.col("next") == ""))
    slices = F.element_at(F.array(*map(F.lit, SLICES)), F.col("k") + 1)
    return merged.groupBy("lang", "k", "prefix", F.pmod(F.xxhash64("next"), slices).alias("slice")).agg(
        F.map_from_entries(F.collect_list(F.struct("next", "n"))).alias("nexts"),
        F.max(F.when(F.col("next") != "", F.col("n"))).alias("most"))


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Phrases of 2 to 4 words that occur at least :data:`LEAST` times within
    pieces of text are scored by ``2 a / (l + r)`` in millionths, where ``a``
    is how often the phrase occurs and ``l`` and ``r`` how often its two parts
    do, for the cut that gives least. Those that mostly stand in a longer one
    are left out. ASCII letters are lower-cased. A null language is ``und``,
    null and empty texts have no words, repeated rows count as often as they
    come, an empty table gives an empty result. Other columns are not read.
    """
    table = stage(stripes(docs, lang_col, text_col), "stripes")
    counts = table.select("lang", "k", "prefix", F.explode("nexts").alias("next", "a")).where("next <> ''").select(
        "lang", (F.col("k") + 1).alias("words"), "a",
        F.when(F.col("k") == 0, F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")).alias("phrase"))
    totals = table.where("k = 0").select("lang", F.element_at("nexts", F.lit("")).alias("n")).where("n is not null")
    found = counts.where("words > 1")
    # A phrase in a longer one is in one that is longer by a word, at least as often.
    longer = table.where("k > 1").select("lang", F.col("prefix").alias("phrase"), F.col("most").alias("cover")).union(
        found.where("words > 2").select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)"), "a"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("cover").alias("cover"))
    wide = "decimal(20,0)"
    kept = found.join(longer, ["lang", "phrase"], "left").where(
        F.col("cover").isNull() | (F.col("cover").cast(wide) * 100 < F.col("a").cast(wide) * SUBSUMED))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")).withColumn(
        "left", F.expr("substring_index(phrase, ' ', cut)")).withColumn(
        "right", F.expr("substring(phrase, length(left) + 2)"))
    parts = counts.where(F.col("words") < LONGEST)
    both = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"]).join(
        parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    score = F.expr(f"cast(a as {wide}) * {2 * UNIT} div (cast(l as {wide}) + cast(r as {wide}))")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("least")).select("lang", "phrase", "a", "least.*")
    # The first of each of a language's lots go on to its own ranking, so that this sees a bounded number of rows.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    lot = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(LOTS))).orderBy(*order)
    first = scored.withColumn("rank", F.row_number().over(lot)).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(
        F.col("rank") <= top).join(
        totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
