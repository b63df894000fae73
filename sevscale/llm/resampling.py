"""Importance resampling: draw documents whose hashed features look like a target corpus.

The tokenizer library's pre-tokenisation, an untrained split by a pattern, cuts the text (ASCII
letters lowered) into words with byte offsets.  Windows over one and over two consecutive
offset pairs are the features; a feature's bucket is the CRC of its words, joined by a space.
Each text is split once: its buckets are packed in two bytes each, and both the histograms and
the sums of gains are read from the packed rows.  The driver sees the histograms alone, at most
``buckets`` rows each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex
from tokenizers.pre_tokenizers import Split

from sevscale.llm.frames import Scratch, as_bytes, per_batch
from sevscale.operators.ranking import before_part, range_positions

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25

_split = None


def word_offsets(text: str | None, pattern: str = WORDS) -> tuple[bytes, list[tuple[int, int]]]:
    """The lowered UTF-8 text and the (start, end) bytes of its words."""
    global _split
    if _split is None or _split[0] != pattern:
        _split = pattern, Split(Regex(pattern), behavior="removed", invert=True)
    data = as_bytes(text).lower()  # of bytes, so A-Z only
    pieces = PreTokenizedString(data.decode())
    _split[1].pre_tokenize(pieces)
    return data, [at for _, at, _ in pieces.get_splits(offset_referential="original", offset_type="byte")]


def feature_crcs(data: bytes, offsets: list[tuple[int, int]]) -> list[int]:
    """CRC of each window of one offset pair, then of each window of two."""
    crc32 = zlib.crc32
    words = [data[start:end] for start, end in offsets]
    single = [crc32(w) for w in words]
    return single + [crc32(w, crc32(b" ", before)) for before, w in zip(single, words[1:])]


def hashed_features(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, id_col: str | None = None) -> DataFrame:
    """(doc_id, n_words, features): the bucket of every feature, packed; a null text has none."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def rows(batch: dict[str, list]) -> dict[str, object]:
        n_words, packed = [], []
        for text in batch["text"]:
            data, offsets = word_offsets(text)
            crcs = np.array(feature_crcs(data, offsets), np.int64)
            n_words.append(len(offsets))
            packed.append((crcs % buckets).astype(kind).tobytes())
        return {"doc_id": batch["doc_id"], "n_words": n_words, "features": packed}

    id_ = F.lit(None).cast("bigint") if id_col is None else F.col(id_col)
    return per_batch(df.select(id_.alias("doc_id"), F.col(text_col).alias("text")),
                     "doc_id long, n_words long, features binary", rows)


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences per bucket: each task adds its rows up, so at most ``buckets`` rows leave it."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_py(), kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counts = features.select("features").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, floored."""
    n, s, t = len(source), source.astype(float), target.astype(float)
    ratio = ((t + 1) * float(int(source.sum()) + n)) / ((s + 1) * float(int(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def feature_weights(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each row's features."""
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"

    def rows(batch: dict[str, list]) -> dict[str, object]:
        n_features, weight = [], []
        for packed in batch["features"]:
            held = np.frombuffer(packed, kind)
            n_features.append(len(held))
            weight.append(int(gains[held].sum()) // len(held) if len(held) else 0)
        return {"doc_id": batch["doc_id"], "n_words": batch["n_words"], "n_features": n_features, "weight": weight}

    return per_batch(features, "doc_id long, n_words long, n_features long, weight long", rows)


def gumbel_noise(id_: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw that depends on the id alone; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def importance_resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) per row of ``df``.

    Score is weight plus noise; among rows of at least ``least_words`` words the ``percent`` of
    highest scores are drawn and ranked from 1, ties to the smaller id.  Other rows have no
    rank.  A null or empty text has no features, weight 0 and is not drawn; a null id comes last
    among equal scores; repeated rows are drawn one by one.  An empty target leaves the gains to
    the smoothing; an empty table gives no rows.  Texts are read whole, whatever their length.
    Other columns are not read.
    """
    scratch = Scratch(df.sparkSession)
    features = scratch.keep(hashed_features(df, text_col, buckets, id_col), "features")
    wanted = histogram(hashed_features(target, target_col, buckets), buckets)
    weighed = feature_weights(features, bucket_gains(histogram(features, buckets), wanted))
    scored = scratch.keep(weighed.withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed)), "scored")

    enough = F.col("n_words") >= least_words
    pool = scored.where(enough)
    drawn = F.floor(pool.agg(F.count("*") * percent).scalar() / 100)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = range_positions(pool, order, "resample_order")
    sizes = F.broadcast(before_part(placed, F.count("*")))  # one row per range
    place = (F.col("__before") + F.col("__pos")).cast("bigint")
    ranked = placed.join(sizes, "__part").withColumn("rank", F.when(place <= drawn, place))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("bigint"))
    return scratch.finish(ranked.select(*columns).unionByName(rest.select(*columns)), "resampled")
