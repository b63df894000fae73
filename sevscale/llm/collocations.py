"""Phrase collocations: the longest windows are counted, shorter phrases follow by ROLLUP.

Each word opens one window: itself and the next words of its piece as lead columns, padded
where the piece ends.  Equal windows are counted once; a ROLLUP over their columns then sums
ever shorter prefixes, so the counts of all phrases come from one aggregation and no shorter
n-gram is exploded.

Most windows of a large corpus are unique and hold no frequent phrase.  A phrase that occurs
``min_count`` times consists of pairs and triples of words that do, so windows end before one
that is rarer.  Frequent pairs, then the triples made of them, are counted by a 64-bit hash and
handed to the tasks as bitmaps: a false positive lets a window run on, which costs a row and
changes no count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sevscale.llm.frames import Scratch
from sevscale.llm.words import scramble, spelled_numbers

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
ABSORB = 100  # percent of a phrase's occurrences that lie inside one longer phrase
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
# A bitmap has this many bits for each frequent hash, within these limits (32 kB to 128 MB).
BITS_PER_HASH, LEAST_BITS, MOST_BITS = 16, 1 << 18, 1 << 30
CHUNK_BITS = 1 << 18
COUNT = "decimal(16,0)"  # so that 1000 * a * n fits a decimal of 38 digits
BATCH_BYTES = 2 << 20  # text looked at in one go, some 40 bytes of memory each; a longer text is a batch of its own

_END, _BLANK, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_END[list(PIECE_ENDS)] = True
_BLANK[list(BLANKS)] = True
_LOWER[65:91] += 32
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class BatchWords:
    """The words of a batch of texts, as arrays over all of them.

    ``words`` holds them with A-Z lowered, ``lang`` their language; ``follows`` is true for a word
    that has a neighbour before it in its piece, and ``pairs`` holds such a pair's number, per language.
    """

    def __init__(self, langs: pa.Array, texts: pa.Array):
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]]
        ends = ends - ends[0]
        end = _END[raw]
        inside = ~(end | _BLANK[raw])
        opens = np.zeros(len(raw) + 1, bool)  # first bytes of texts
        opens[ends[:-1]] = True
        before = np.concatenate(([False], inside[:-1])) & ~opens[:-1]
        starts = np.flatnonzero(inside & ~before)
        letters = raw[inside]
        place = np.cumsum(inside) - 1
        at = np.append(place[starts], len(letters)) if len(starts) else np.zeros(1, np.int64)
        self.words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters))
        text = np.searchsorted(ends, starts, "right") - 1
        codes = langs.dictionary_encode()
        names = [x.encode() for x in codes.dictionary.to_pylist()]
        salt = np.array([np.frombuffer(hashlib.sha256(x).digest(), np.uint64)[0] for x in names], np.uint64)
        code = codes.indices.to_numpy()[text]
        self.lang = pa.DictionaryArray.from_arrays(pa.array(code, pa.int32()), codes.dictionary)
        piece = np.cumsum(end)[starts] if len(raw) else starts
        self.follows = np.zeros(len(starts), bool)
        self.follows[1:] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
        numbers = spelled_numbers(letters, at)
        later = np.flatnonzero(self.follows)
        self.pairs = np.zeros(len(starts), np.uint64)
        self.pairs[later] = scramble(numbers[later - 1] * _LEFT + numbers[later] * _RIGHT + salt[code[later]])

    def joined(self, table: np.ndarray) -> np.ndarray:
        """Which words make a frequent pair with the word before them."""
        out = self.follows.copy()
        out[out] = _held(table, self.pairs[out])
        return out

    def triples(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last words of triples made of two frequent pairs, and the triples' numbers."""
        last = np.flatnonzero(joined[1:] & joined[:-1]) + 1
        return last, scramble(self.pairs[last - 1] * _RIGHT + self.pairs[last] * _LEFT)


def _held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes % np.uint64(len(table) * 8)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[BatchWords]:
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1).cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + BATCH_BYTES, "right")) - 1)
            yield BatchWords(langs.slice(first, last - first), texts.slice(first, last - first))
            first = last


def texts_by_lang(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def frequent_hashes(texts: DataFrame, min_count: int, pairs: np.ndarray | None = None) -> DataFrame:
    """(hash) of word pairs that occur at least ``min_count`` times; given those, of triples."""
    table = None if pairs is None else texts.sparkSession.sparkContext.broadcast(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batches(batches):
            hashes = held.pairs[held.follows] if table is None else held.triples(held.joined(table.value))[1]
            hashes, n = np.unique(hashes.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n.astype(np.int64))], names=["hash", "n"])

    counts = texts.mapInArrow(count, "hash long, n long")
    return counts.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("hash")


def hash_bitmap(hashes: DataFrame, n_hashes: int) -> np.ndarray:
    """The bits of all given hashes.  Tasks build chunks of it; its size has a fixed limit."""
    bits = LEAST_BITS
    while bits < min(n_hashes * BITS_PER_HASH, MOST_BITS):
        bits *= 2

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, low in zip(batch.column(0).to_numpy().tolist(), batch.column(1).to_numpy().tolist()):
                held.setdefault(number, np.zeros(CHUNK_BITS // 8, np.uint8))[low >> 3] |= 1 << (low & 7)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["chunk", "data"])

    at = F.pmod(F.col("hash"), F.lit(bits))
    spread = hashes.select(F.floor(at / CHUNK_BITS).cast("bigint").alias("chunk"), F.pmod(at, F.lit(CHUNK_BITS)).cast("bigint").alias("low"))
    out = np.zeros(bits // 8, np.uint8)
    for row in spread.repartition(min(bits // CHUNK_BITS, 256), "chunk").mapInArrow(chunk, "chunk long, data binary").toLocalIterator():
        start = row["chunk"] * (CHUNK_BITS // 8)
        out[start:start + CHUNK_BITS // 8] |= np.frombuffer(row["data"], np.uint8)
    return out


def frequent_runs(texts: DataFrame, pairs: np.ndarray, triples: np.ndarray) -> DataFrame:
    """(lang, words, opens, n): pieces cut so that all pairs and triples of a run are frequent.

    Where a triple is rare the next run begins with its middle word, the last of the run before; the
    first ``opens`` words of a run open windows, so each word does so once.  Words left alone
    are counted within their batch; other runs are one row each.
    """
    tables = texts.sparkSession.sparkContext.broadcast((pairs, triples))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batches(batches):
            n = len(held.words)
            if not n:
                continue
            joined = held.joined(tables.value[0])
            last, numbers = held.triples(joined)
            middle = last[~_held(tables.value[1], numbers)] - 1
            again = np.zeros(n + 1, bool)  # words that open a run and end the one before
            again[middle] = True
            starts = np.flatnonzero(~joined | again[:n])
            ends = np.append(starts[1:], n)
            opens = ends - starts
            sizes = opens + again[ends]
            alone, longer = sizes == 1, np.flatnonzero(sizes > 1)
            single = pa.table({"lang": held.lang.take(pa.array(starts[alone])).cast(pa.string()), "word": held.words.take(pa.array(starts[alone]))})
            counted = single.group_by(["lang", "word"]).aggregate([([], "count_all")])
            one = np.ones(len(counted), np.int64)
            yield _run_rows(counted["lang"].combine_chunks(), counted["word"].combine_chunks(),
                            np.arange(len(counted) + 1), one, counted["count_all"].combine_chunks())
            edges = np.concatenate(([0], np.cumsum(sizes[longer])))
            place = np.arange(edges[-1]) + np.repeat(starts[longer] - edges[:-1], sizes[longer])
            yield _run_rows(held.lang.take(pa.array(starts[longer])).cast(pa.string()), held.words.take(pa.array(place)),
                            edges, opens[longer], pa.array(np.ones(len(longer), np.int64)))

    return texts.mapInArrow(cut, "lang string, words array<string>, opens long, n long")


def _run_rows(lang: pa.Array, words: pa.Array, ends: np.ndarray, opens: np.ndarray, n: pa.Array) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.cast(pa.string()))
    return pa.RecordBatch.from_arrays([lang, lists, pa.array(opens.astype(np.int64)), n], names=["lang", "words", "opens", "n"])


def longest_windows(runs: DataFrame, width: int) -> DataFrame:
    """(lang, w1 ... w<width>, n): every word with the words after it, padded by ``''``."""
    at = runs.select("lang", "words", "opens", "n", F.posexplode("words").alias("pos", "w1")).where(F.col("pos") < F.col("opens"))
    leads = [F.coalesce(F.get("words", F.col("pos") + k), F.lit("")).alias(f"w{k + 1}") for k in range(1, width)]
    columns = [f"w{k}" for k in range(1, width + 1)]
    return at.select("lang", "w1", *leads, "n").groupBy("lang", *columns).agg(F.sum("n").alias("n"))


def phrase_counts(windows: DataFrame, width: int, min_count: int) -> DataFrame:
    """(lang, size, phrase, f): phrases of up to ``width`` words with ``min_count`` occurrences.

    Size 0 is the number of all words of a language.  One ROLLUP sums the windows that share a
    prefix; a level whose last word is padding is the shorter phrase over again and is left out.
    """
    columns = [f"w{k}" for k in range(1, width + 1)]
    rolled = windows.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # bits set from the right: columns summed away
    size = F.lit(width) - F.bit_count(F.col("g").bitwiseAND((1 << width) - 1))
    last = F.coalesce(*[F.col(c) for c in reversed(columns)], F.lit("-"))
    return (
        rolled.where(F.col("g") < (1 << width)).select("lang", size.cast("int").alias("size"), *columns, "f")
        .where((last != "") & ((F.col("size") == 0) | (F.col("f") >= min_count)))
        .select("lang", "size", F.concat_ws(" ", *columns).alias("phrase"), F.col("f").cast("bigint").alias("f"))
    )


def _part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def score_phrases(counts: DataFrame) -> DataFrame:
    """(lang, size, phrase, a, l, r, n, score) of phrases of two words and more.

    Each cut's score is floor(1000 * a * n / (l * r)) in decimals of 38 digits; the lowest counts,
    ties to the shortest first part.
    """
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    parts = counts.where("size > 0").select(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase"), F.col("f").alias("__f"))
    words = F.split("phrase", " ")
    cuts = counts.where("size > 1").select(
        "lang", "size", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select("*", _part(words, F.lit(1), F.col("k")).alias("left"), _part(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts, (F.col("lang") == F.col("__lang")) & (F.col(side) == F.col("__phrase"))).drop(
            "__lang", "__phrase").withColumnRenamed("__f", name)
    exact = {c: F.col(c).cast(COUNT) for c in "alrn"}
    over = F.lit(1000).cast("decimal(4,0)") * exact["a"] * exact["n"]
    scored = cuts.join(F.broadcast(totals), "lang").withColumns({"__over": over, "__under": exact["l"] * exact["r"]}).withColumn(
        "score", F.expr("__over div __under"))
    return scored.groupBy("lang", "size", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")
    ).select("lang", "size", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def not_absorbed(scored: DataFrame, percent: int = ABSORB) -> DataFrame:
    """Without phrases that ``percent`` of the time lie inside one longer phrase."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    inside = scored.where("size > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("longer"))
    most = inside.groupBy(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase")).agg(F.max("longer").alias("longer"))
    same = (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__phrase"))
    return scored.join(most, same & (100 * F.col("longer") >= percent * F.col("a")), "left_anti")


def mine_collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
    top: int = TOP, absorb: int = ABSORB,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Ties go to the larger count, then to the smaller phrase in byte order.  A null text counts as
    empty, a null language as ``und``; repeated rows count each time.  A table without a phrase
    frequent enough, or without rows, gives none.  Texts are read whole, whatever their length;
    other columns are not read.
    """
    scratch = Scratch(df.sparkSession)
    texts = texts_by_lang(df, text_col, lang_col)
    bitmaps: list[np.ndarray] = []
    for name in ("frequent_pairs", "frequent_triples"):
        hashes = scratch.keep(frequent_hashes(texts, min_count, *bitmaps), name)
        bitmaps.append(hash_bitmap(hashes, hashes.count()))
    runs = frequent_runs(texts, *bitmaps)
    counts = scratch.keep(phrase_counts(longest_windows(runs, max_words), max_words, min_count), "phrase_counts")
    scored = scratch.keep(score_phrases(counts), "scored_phrases")
    # a limit per language is taken in every task before rows of one language come together
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = not_absorbed(scored, absorb).withColumn("rank", F.row_number().over(place).cast("bigint")).where(F.col("rank") <= top)
    return scratch.finish(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
