"""Best-fit packing of token sequences by exact complements.

Only a histogram of lengths (at most one count per length up to the capacity) is planned on
the driver: for each length, longest first, single, pair and triple sums that fill the rest
exactly are looked up in hashed indexes and consumed as often as their counts allow; what is
left goes best-fit into the fullest sequence that takes it.  The plan is a short list of
(length, ranks, sequences, offset); pieces meet it by their rank among pieces of their length.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sevscale.llm.frames import Scratch, per_batch

CAPACITY = 2048
END = 0  # the token after each document
BUCKETS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, rank_from long, rank_to long, sequence_from long, offset long"


@lru_cache(maxsize=2)
def _encoding(vocabulary: str) -> tiktoken.Encoding:
    """Byte-level BPE from a tokenizer file: its vocabulary in byte letters, its split pattern.

    Ids of such a vocabulary rise in merge order, so they serve as merge ranks.
    """
    with open(vocabulary, encoding="utf-8") as f:
        whole = json.load(f)
    model, added = whole["model"], whole.get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at their neighbours are not supported")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    merged = {a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
    ranks = {
        bytes(letters[c] for c in word): i for word, i in model["vocab"].items()
        if len(word) == 1 or word in merged
    }
    # Fixed value: the vocabulary's split pattern.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks,
                             special_tokens={t["content"]: t["id"] for t in added})


def token_ids(text: str, vocabulary: str, added: bool = False) -> np.ndarray:
    """Ids of one text and the end token, little-endian 32-bit.

    With ``added``, the file's added tokens are cut out first and get their own ids.
    """
    encoding = _encoding(vocabulary)
    ids = encoding.encode(text, allowed_special="all") if added else encoding.encode_ordinary(text)
    ids.append(END)
    return np.array(ids, "<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, before them what is over."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def document_pieces(
    df: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    added: bool = False,
) -> DataFrame:
    """One row per piece of each document; a null text counts as empty (the end token alone)."""

    def rows(batch: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc, text in zip(batch["doc_id"], batch["text"]):
            ids = token_ids(text or "", vocabulary, added)
            for i, (start, length) in enumerate(cut(len(ids), capacity)):
                for c, v in zip(out, (doc, i, start, length, zlib.crc32(ids[start:start + length].tobytes()))):
                    out[c].append(v)
        return out

    return per_batch(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), PIECES, rows)


class Planner:
    """Turns a histogram of lengths into runs of equal sequences."""

    def __init__(self, histogram: dict[int, int], capacity: int, parts: int):
        self.capacity, self.parts = capacity, parts
        self.left = Counter({k: n for k, n in histogram.items() if n > 0})
        self.used: Counter = Counter()
        self.sequences = 0
        self.plan: list[tuple[int, int, int, int, int]] = []

    def run(self) -> None:
        self._exact()
        self._best_fit()

    def _emit(self, lengths: list[int], times: int) -> None:
        offset = 0
        for length in lengths:
            start = self.used[length]
            self.plan.append((length, start, start + times, self.sequences, offset))
            self.used[length] += times
            offset += length
        self.sequences += times

    def _enough(self, *lengths: int) -> bool:
        return all(self.left[k] >= lengths.count(k) for k in lengths)

    def _pair(self, total: int, *beside: int) -> tuple[int, int] | None:
        """Two available lengths of this sum, the most uneven first.

        The index of a sum is made on first use; entries whose lengths have run out leave it.
        """
        if total not in self.pairs:
            half = np.arange(1, total // 2 + 1)
            there = self.there[half] & self.there[total - half]
            self.pairs[total] = half[there][::-1].tolist()
        shorts = self.pairs[total]
        while shorts and not (self.left[shorts[-1]] and self.left[total - shorts[-1]]):
            shorts.pop()
        for a in reversed(shorts):
            if self._enough(a, total - a, *beside):
                return a, total - a
        return None

    def _complement(self, length: int) -> list[int] | None:
        """Available lengths that fill the gap beside one of this length exactly."""
        gap = self.capacity - length
        if gap == 0:
            return []
        if self._enough(length, gap):
            return [gap]
        if self.parts >= 2 and (pair := self._pair(gap, length)):
            return list(pair)
        if self.parts < 3:
            return None
        self.order = [k for k in self.order if self.left[k]]
        for third in self.order:
            if third < gap and (pair := self._pair(gap - third, third, length)):
                return [third, *pair]
        return None

    def _exact(self) -> None:
        """Single, pair and triple complements, longest first, as often as counts allow."""
        self.order = sorted(self.left, reverse=True)
        self.there = np.zeros(self.capacity + 1, bool)
        self.there[self.order] = True
        self.pairs: dict[int, list[int]] = {}
        for length in list(self.order):
            while self.left[length]:
                parts = self._complement(length)
                if parts is None:
                    break
                need = Counter([length, *parts])
                times = min(self.left[k] // n for k, n in need.items())
                self.left.subtract({k: n * times for k, n in need.items()})
                self._emit([length, *parts], times)

    def _best_fit(self) -> None:
        """Longest first into the fullest open sequences that take it, equal ones at once."""
        room: dict[int, list[tuple[list[int], int]]] = {}
        for length in sorted(self.left, reverse=True):
            todo = self.left[length]
            while todo:
                fit = min((r for r in room if r >= length), default=None)
                if fit is None:
                    each = min(self.capacity // length, todo)
                    times = todo // each
                    lengths, todo = [length] * each, todo - times * each
                    room.setdefault(self.capacity - each * length, []).append((lengths, times))
                    continue
                lengths, times = room[fit].pop()
                if not room[fit]:
                    del room[fit]
                each = min(fit // length, todo)
                now = min(times, todo // each)
                if times > now:
                    room.setdefault(fit, []).append((lengths, times - now))
                room.setdefault(fit - each * length, []).append((lengths + [length] * each, now))
                todo -= now * each
            self.left[length] = 0
        for groups in room.values():
            for lengths, times in groups:
                self._emit(lengths, times)


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows of PLAN: pieces of a length with ranks in a range, their sequences and offset.

    Sums of up to three parts are tried first; where short pieces are scarce and run out on
    them, fewer parts can leave better residuals, so the plan with fewest sequences is taken.
    """
    planners = []
    for parts in (3, 2, 1):
        planner = Planner(histogram, capacity, parts)
        planner.run()
        planners.append(planner)
        if planner.sequences <= -(-sum(k * n for k, n in histogram.items()) // capacity):
            break
    return min(planners, key=lambda p: p.sequences).plan


def pack(
    df: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    added: bool = False,
) -> DataFrame:
    """Per piece: the columns of PIECES, ``sequence_id`` and ``offset``.

    Every row is packed, also rows that repeat others and rows without id.  Null and empty
    texts are one end token.  Texts are tokenized once, whole, and staged as pieces.  No
    rows in, no rows out.  Only the two named columns are read.
    With ``added``, ids are the tokenizer's as loaded; else added tokens are read as plain text.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.keep(document_pieces(df, vocabulary, capacity, id_col, text_col, added), "pieces")
    keyed = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)))
    sizes = keyed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    # At most capacity rows reach the driver, whatever the input.
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    plan = spark.createDataFrame(plan_sequences(histogram, capacity), PLAN)
    earlier = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("length").alias("__l"), F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        keyed.withColumn("__row", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), (F.col("length") == F.col("__l")) & (F.col("__bucket") == F.col("__b")))
        .withColumn("__rank", F.col("__before") + F.col("__row"))
    )
    at = plan.withColumnRenamed("length", "__pl")
    return ranked.join(
        F.broadcast(at),
        (F.col("length") == F.col("__pl")) & (F.col("__rank") >= F.col("rank_from")) & (F.col("__rank") < F.col("rank_to")),
    ).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence_from") + F.col("__rank") - F.col("rank_from")).alias("sequence_id"), "offset",
    )
