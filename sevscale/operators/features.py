"""Text features in long form.

Rows are (id, gram, ...).  Texts are moved once, hashed by id; counting words, then grams,
per text happens where the text already is.  A gram row is many times larger than the
characters it came from, so the texts travel and the gram rows do not.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sevscale.functions import matrix_batches
from sevscale.functions.gram_batches import counted, different, frequencies, scored, weighed
from sevscale.functions.grams import PIECE, padded, pieces
from sevscale.functions.text import words

LO, HI = 4, 6
MIN_DF, MAX_DF = 3, 0.5
LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 26  # of hashed grams: 8 kB to 8 MB as bits

# Ids that stand for no word.
PAD, START, END, UNKNOWN, FIRST_WORD = 0, 1, 2, 3, 4
BATCH_CHARS = 16_000_000  # of texts to fit on
MATRIX = "batch int, block int, slots binary, ids array<{}>, norms binary, sizes binary, grams binary, tfs binary"


def by_id(df: DataFrame, id_col: str) -> DataFrame:
    """Hash the rows by id; later groupings on (id, anything) need no further shuffle."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, id_col)


def _bucket(gram: Column, buckets: int) -> Column:
    return F.xxhash64(gram).bitwiseAND(buckets - 1)


def bucket_count(df: DataFrame) -> int:
    """Buckets for a corpus: about one per byte of its plan's size, a power of two in fixed limits."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, 1 << size.bit_length()))


def frequent_buckets(
    df: DataFrame, text_col: str, min_df: int, buckets: int, lo: int = LO, hi: int = HI
) -> Column:
    """A bit per bucket of hashed grams: 1 where the bucket's grams occur ``min_df`` times or more.

    Words are counted first, then the grams of different words add up by bucket.  A gram in
    ``min_df`` texts always falls in a bucket marked 1, so leaving out the others loses none;
    several rare grams that share a bucket only let each other through.  The bits come
    together as one array of ``buckets / 64`` numbers, a fixed size.
    """
    per_word = df.select(F.explode(F.array_distinct(words(F.col(text_col)))).alias("word")).groupBy("word").agg(
        F.count("*").alias("n")).select(F.lit(0).alias("id"), "n", "word")
    held = (
        _gram_rows(per_word, lo, hi).groupBy(_bucket(F.col("gram"), buckets).alias("bucket"))
        .agg(F.sum("n").alias("n")).where(F.col("n") >= min_df)
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bucket").bitwiseAND(63).cast("int"))
    cells = held.groupBy(F.shiftright("bucket", 6).alias("cell")).agg(F.bit_or(bit).alias("bits"))
    dense = df.sparkSession.range(buckets // 64).join(cells, F.col("id") == F.col("cell"), "left")
    cell = F.struct("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["bits"])).scalar()


def gram_counts(
    df: DataFrame, id_col: str, text_col: str, lo: int = LO, hi: int = HI, min_df: int = 1,
    buckets: int | None = None, packed: bool = False,
) -> DataFrame:
    """(id, gram, tf): word-bounded character n-grams and their counts per text.

    ``id_col`` must identify texts.  Words repeat, within a text and between texts, so each distinct
    word of a block of texts is cut into grams once.  With ``min_df``, grams that cannot be in
    so many texts are left out where they arise, before they are counted or moved; some
    rarer ones stay, so document frequencies are still to be looked at.  ``packed`` gives one row
    (id, grams, tfs) per text that has grams, whatever their document frequency.
    """
    placed = _placed(df, id_col, text_col)
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    rows = _by_words(placed).mapInArrow(counted(lo, hi), f"id {id_type}, grams array<string>, tfs array<bigint>")
    if packed:
        return rows
    rows = rows.select("id", "tfs", F.posexplode("grams").alias("at", "gram")).select("id", "gram", F.get("tfs", F.col("at")).alias("tf"))
    if min_df > 1:
        buckets = buckets or bucket_count(df)
        bits = frequent_buckets(placed, "text", min_df, buckets, lo, hi)  # the texts are moved once for both
        at = _bucket(F.col("gram"), buckets)
        cell = F.get(bits, F.shiftright(at, 6).cast("int"))
        rows = rows.where(F.getbit(cell, at.bitwiseAND(63).cast("int")) == 1)
    return rows


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _placed(df: DataFrame, id_col: str, text_col: str, parts: int | None = None) -> DataFrame:
    """(batch, id, text): texts dealt out by a hash of their id, all of a batch in one place."""
    parts = parts or shuffle_parts(df.sparkSession)
    batch = batch_of(F.col(id_col), batch_marks(df.sparkSession, parts)).alias("batch")
    return df.select(batch, F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition(parts, "batch")


def batch_of(id_col: Column, marks: Sequence[int]) -> Column:
    return F.get(F.array(*map(F.lit, marks)), F.pmod(F.hash(id_col), F.lit(len(marks))))


@cache
def batch_marks(spark: SparkSession, parts: int) -> list[int]:
    """Names of batches that Spark's hash deals to a different partition each, so that none gets several."""
    tried = spark.range(parts * (16 + 2 * parts.bit_length())).select(F.col("id").cast("int").alias("mark"))
    first = tried.groupBy(F.pmod(F.hash("mark"), F.lit(parts)).alias("part")).agg(F.min("mark").alias("mark"))
    return sorted(r["mark"] for r in first.collect())


def _by_words(placed: DataFrame) -> DataFrame:
    """(id, words) with rows of equal ids next to each other; texts are sorted, not their grams."""
    return placed.sortWithinPartitions("id").select("id", words(F.col("text")).alias("words"))


def _gram_rows(per_word: DataFrame, lo: int, hi: int) -> DataFrame:
    """(id, n, gram) rows of (id, word, n): one row per window start, then one per length.

    Plain generators stay in generated code, unlike nested array functions.
    """
    size, start = F.char_length("piece"), F.col("start")
    last = F.greatest(F.lit(1), F.least(F.lit(PIECE), size - lo + 1))
    windows = [F.substring("piece", start, F.lit(lo))] + [
        F.when(start + (n - 1) <= size, F.substring("piece", start, F.lit(n)))
        for n in range(lo + 1, hi + 1)
    ]
    return (
        per_word.select("id", "n", F.explode(pieces(padded(F.col("word")), lo, hi)).alias("piece"))
        .select("id", "n", "piece", F.explode(F.sequence(F.lit(1), last)).alias("start"))
        .select("id", "n", F.explode(F.array(*windows)).alias("gram"))
        .where(F.col("gram").isNotNull())
    )


def gram_vocab(
    counts: DataFrame, n_docs: Column, min_df: int = MIN_DF, max_df: float = MAX_DF
) -> DataFrame:
    """(gram, df) for grams in at least ``min_df`` texts and at most a ``max_df`` share."""
    return _frequent(counts.groupBy("gram").agg(F.count("*").alias("df")), n_docs, min_df, max_df)


def _frequent(frequencies: DataFrame, n_docs: Column, min_df: int, max_df: float) -> DataFrame:
    return frequencies.where((F.col("df") >= min_df) & (F.col("df") <= n_docs * max_df))


def gram_idf(vocab: DataFrame, n_docs: Column) -> DataFrame:
    """Smoothed inverse document frequency plus one."""
    return vocab.withColumn("idf", F.ln((n_docs + 1) / (F.col("df") + 1)) + 1)


def n_rows(df: DataFrame) -> Column:
    return df.agg(F.count("*")).scalar()


def fit_idf(
    df: DataFrame, id_col: str, text_col: str, min_df: int = MIN_DF, max_df: float = MAX_DF, prune: bool = False,
) -> DataFrame:
    """The text model of a corpus: (gram, df, idf).

    ``prune`` leaves out rare grams where they arise, at the price of a pass over the words.  It
    pays where most grams are rare, as with names, addresses and typing errors.
    """
    total = n_rows(df)
    if prune:
        counts = gram_counts(df, id_col, text_col, min_df=min_df)
        return gram_idf(gram_vocab(counts, total, min_df, max_df), total)
    # blocks of texts sum up their own grams: no row per text and gram leaves them
    held = _by_words(_placed(df, id_col, text_col)).mapInArrow(frequencies(LO, HI), "gram string, n bigint")
    return gram_idf(_frequent(held.groupBy("gram").agg(F.sum("n").alias("df")), total, min_df, max_df), total)


def tfidf_transform(model: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, gram, tf, weight): tf * idf, unit length per text; unknown grams vanish.

    Other columns of the model than ``df``, such as its ``slot`` or coefficients, come along.  Gram
    rows never move: what the model says of the different grams of a batch of texts is sent to
    the batch, and its texts are weighed there.
    """
    extra = [c for c in model.columns if c not in ("gram", "df", "idf")]
    both, types = _with_known(model.select("gram", "idf", *extra), df, id_col, text_col)
    out = ", ".join(f"`{c}` {types[c]}" for c in ["id", *extra])
    return both.groupBy("batch").applyInArrow(_group(weighed(LO, HI, extra)), f"{out}, gram string, tf bigint, weight double").select(
        "id", "gram", *extra, "tf", "weight")


def blank(kind: str) -> Column:
    """A value for rows that have none of this type.

    Not null for arrays: on its way to Python, Spark asks for the batch's size at every row, which walks all null lists before it.
    """
    return F.array() if kind.startswith("array") else F.lit(None)


def _with_known(
    known: DataFrame, df: DataFrame, id_col: str, text_col: str, parts: int | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """Batches of texts as (batch, kind, id, words), before them the rows of ``known`` with a gram of the batch."""
    columns = [c for c in known.columns if c != "gram"]
    parts = parts or shuffle_parts(df.sparkSession)
    placed = _placed(df, id_col, text_col, parts)
    texts = placed.select("batch", "id", words(F.col("text")).alias("words"))
    wanted = texts.select("batch", "words").groupBy("batch").applyInArrow(
        _group(different(LO, HI)), "batch int, gram string")
    # sizes of gram tables are underestimated from the texts', so neither side may be broadcast
    sent = wanted.join(known.hint("merge"), "gram").repartition(parts, "batch")
    types = {f.name: f.dataType.simpleString() for f in [*placed.schema, *known.schema]}
    none = {"id": types["id"], "words": "array<string>", "gram": "string", **{c: types[c] for c in columns}}

    def shaped(rows: DataFrame, kind: int) -> DataFrame:
        return rows.select("batch", F.lit(kind).alias("kind"), *[
            (F.col(c) if c in rows.columns else blank(t)).cast(t).alias(c) for c, t in none.items()])

    return shaped(sent, 0).unionByName(shaped(texts, 1)).sortWithinPartitions("batch", "kind", "id"), types


def text_scores(
    known: DataFrame, df: DataFrame, id_col: str, text_col: str, parts: Sequence[tuple[str, Sequence[str]]],
) -> DataFrame:
    """(id, one column per summed column): for texts, the sums of tf-idf weights times coefficients.

    ``known`` holds (gram, columns of numbers); a part names the column of a model's idf and those of its
    coefficients, null where a gram is not the model's.  The texts are cut once for all parts, and only their sums leave the batch.
    """
    both, types = _with_known(known, df, id_col, text_col)
    parts = [(idf, list(columns)) for idf, columns in parts]
    out = ", ".join(f"`{c}` double" for _, columns in parts for c in columns)
    return both.groupBy("batch").applyInArrow(_group(scored(LO, HI, parts)), f"id {types['id']}, {out}")


def matrix_parts(df: DataFrame, text_col: str) -> int:
    """Batches of texts to fit on: the fewer, the fewer slots two of them share, so about ``BATCH_CHARS`` each, two a core at least."""
    chars = df.agg(F.sum(F.char_length(text_col))).first()[0] or 0
    wanted = max(2 * df.sparkSession.sparkContext.defaultParallelism, chars // BATCH_CHARS + 1)
    return min(shuffle_parts(df.sparkSession), wanted)


def text_matrix(model: DataFrame, df: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """The tf-idf weights of texts under a model (gram, idf, slot), packed in ``parts`` batches."""
    both, types = _with_known(model.select("gram", "idf", "slot"), df, id_col, text_col, parts)
    return both.groupBy("batch").applyInArrow(keyed(matrix_batches.packed(LO, HI)), MATRIX.format(types["id"]))


def entry_matrix(df: DataFrame, parts: int) -> DataFrame:
    """The weights of (id, slot, x), packed in ``parts`` batches."""
    batch = batch_of(F.col("id"), batch_marks(df.sparkSession, parts)).alias("batch")
    placed = df.select(batch, "id", F.col("slot").cast("bigint"), F.col("x").cast("double")).repartition(parts, "batch").sortWithinPartitions("batch", "id")
    return placed.groupBy("batch").applyInArrow(
        keyed(matrix_batches.packed_entries()), MATRIX.format(df.schema["id"].dataType.simpleString()))


def _group(run):
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    return group


def keyed(run):
    """A function of one group's key and rows."""
    def group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(key, batches)

    return group


def linear_scores(
    weights: DataFrame, coefs: DataFrame, ids: DataFrame, models: Sequence[str],
    intercepts: Sequence[float] | None = None, key: str = "gram",
) -> DataFrame:
    """One score column per model for every id, from one join of all models' coefficients.

    ``coefs`` holds (``key``, one column per model); weights that carry those columns already need no
    join.  Texts without a known gram still get
    the intercepts.
    """
    if not models:
        raise ValueError("no models to score with")
    known = set(models) <= set(weights.columns)
    # gram rows are far more than their texts let Spark expect: never broadcast
    summed = (
        (weights if known else weights.join(coefs.select(key, *models).hint("merge"), key))
        .groupBy("id")
        .agg(*[F.sum(F.col("weight") * F.col(m)).alias(m) for m in models])
    )
    return with_intercepts(summed, ids, models, intercepts)


def with_intercepts(
    summed: DataFrame, ids: DataFrame, models: Sequence[str], intercepts: Sequence[float] | None = None,
) -> DataFrame:
    """Sums of texts plus the intercepts; texts without sums get the intercepts."""
    base = list(intercepts) if intercepts is not None else [0.0] * len(models)
    return ids.select("id").join(summed, "id", "left").select(
        "id", *[(F.coalesce(m, F.lit(0.0)) + b).alias(m) for m, b in zip(models, base)]
    )


def score_models(scored: DataFrame, models: Sequence[str]) -> DataFrame:
    """The models' mean next to each model's own score."""
    total = F.col(models[0])
    for m in models[1:]:
        total = total + F.col(m)
    return scored.select("id", (total / len(models)).alias("pred"), *models)


def word_vocab(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """(word, word_id): the most frequent words of whole texts, ties by word."""
    top = (
        df.select(F.explode(words(F.col(text_col))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(size)
    )
    # at most ``size`` rows are numbered
    place = F.row_number().over(Window.orderBy(F.desc("n"), "word"))
    return top.select("word", (place + (FIRST_WORD - 1)).cast("int").alias("word_id"))


def encode_fixed(
    df: DataFrame, id_col: str, text_col: str, vocab: DataFrame, max_len: int
) -> DataFrame:
    """(id, ids, mask): start, words, end, then padding, all of length ``max_len``.

    ``vocab`` is as large as the caller asked for, so Spark chooses the join by its size.
    Cutting at ``max_len`` is what the encoding means; only the words that fit are looked up.
    """
    room = max_len - 2
    placed = by_id(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    kept = placed.select(
        "id", F.posexplode_outer(F.slice(words(F.col("text")), 1, room)).alias("pos", "word")
    )
    found = kept.join(vocab, "word", "left").groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(
            F.col("pos").isNotNull(),
            F.struct("pos", F.coalesce("word_id", F.lit(UNKNOWN)).alias("w")),
        ))).alias("found")
    )
    body = F.concat(
        F.array(F.lit(START)), F.transform("found", lambda s: s["w"]), F.array(F.lit(END))
    )
    fill = F.array_repeat(F.lit(PAD), max_len - F.size("body"))
    return (
        found.select("id", body.alias("body"))
        .select("id", F.concat("body", fill).alias("ids"), F.size("body").alias("used"))
        .select(
            "id", "ids",
            F.concat(
                F.array_repeat(F.lit(1), F.col("used")),
                F.array_repeat(F.lit(0), max_len - F.col("used")),
            ).alias("mask"),
        )
    )


def truncation_profile(df: DataFrame, text_col: str, max_len: int) -> DataFrame:
    """Share of texts longer than ``max_len`` after the two marks, and length quantiles."""
    lengths = (
        df.select((F.size(words(F.col(text_col))) + 2).alias("len"))
        .groupBy("len")
        .agg(F.count("*").alias("n"))
    )  # as many rows as there are different lengths
    cut = F.sum(F.when(F.col("len") > max_len, F.col("n")).otherwise(0))
    q = F.expr("percentile(len, array(0.5D, 0.9D, 0.99D), n)")
    return lengths.agg(
        F.sum("n").cast("bigint").alias("n_texts"),
        (cut.cast("double") / F.sum("n")).alias("share_cut"),
        F.max("len").cast("bigint").alias("max_len"),
        q.alias("q"),
    ).select(
        "n_texts", "share_cut", "max_len",
        F.col("q")[0].alias("q50"), F.col("q")[1].alias("q90"), F.col("q")[2].alias("q99"),
    )


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def head_score(
    df: DataFrame, vector: str, weights: Sequence[float], bias: float = 0.0,
    activation: str | None = None, eps: float = 1e-5, out: str = "score",
) -> DataFrame:
    """Normalize each vector to zero mean and unit variance, then a linear head."""
    if activation not in (None, "silu"):
        raise ValueError(f"activation must be None or 'silu', not {activation!r}")
    zero = F.lit(0.0)
    x = F.transform(vector, lambda v: v.cast("double"))
    mean = F.aggregate("__x", zero, lambda a, v: a + v) / F.size("__x")
    var = F.aggregate(
        "__x", zero, lambda a, v: a + (v - F.col("__mean")) * (v - F.col("__mean"))
    ) / F.size("__x")
    dot = F.aggregate(
        F.zip_with(
            "__x", F.array(*[F.lit(float(w)) for w in weights]),
            lambda v, w: (v - F.col("__mean")) * w,
        ),
        zero, lambda a, v: a + v,
    ) / F.sqrt(F.col("__var") + eps)
    score = dot + bias
    if activation == "silu":
        score = silu(score)
    return (
        df.withColumn("__x", x).withColumn("__mean", mean).withColumn("__var", var)
        .withColumn(out, score).drop("__x", "__mean", "__var")
    )
