"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a linear ramp of that weight over the training time 0..1.  The
sources share the whole size by weight; a source's target stops at a multiple of its size and
the excess goes to the others.  A source's demand up to time t is the integral of its ramp,
scaled to the target.  Its documents, in hashed order and as often as the target asks, are
laid along that demand; inverting it gives each one its training position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sevscale.llm.frames import count_words, numbered, text_digest
from sevscale.operators.ranking import hash_order

WEIGHTS = (5, 2, 1)
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))  # weight at the start and at the end, in turn
MOST_REPEATS = 3
HEX_DIGITS = 2  # 256 buckets of each source's hashed order


def _turn(values: Sequence[float], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (at % len(values) + 1).cast("int"))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS,
    ramps: Sequence[tuple[float, float]] = RAMPS,
) -> DataFrame:
    """Target, ramp and size of each source, from one row per (source, bucket).

    Targets are min(most * size, share * weight) with the one share that makes them add up
    to all sizes.  Sorted by size per weight, the sources that stop at their multiple come
    first; the share is what the others have left, by weight.  The only unpartitioned
    window is over this table of one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("__at", F.row_number().over(by_name) - 1).select(
        "source", "source_size", _turn(weights, F.col("__at")).alias("weight"),
        _turn([r[0] for r in ramps], F.col("__at")).alias("ramp_from"),
        _turn([r[1] for r in ramps], F.col("__at")).alias("ramp_to"),
    )
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(upto), F.lit(0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    shares = ranked.withColumn("__share", left / open_weight)
    # The first source that does not stop fixes the share of all that follow.
    stops = most * F.col("source_size") <= F.col("__share") * F.col("weight")
    share = F.min(F.when(~stops, F.struct(F.col("source_size") / F.col("weight"), F.col("__share").alias("s"))))
    return shares.withColumn("__s", share.over(whole)["s"]).select(
        "source", "source_size", "weight", "ramp_from", "ramp_to",
        F.least(
            (most * F.col("source_size")).cast("double"),
            F.coalesce(F.col("__s") * F.col("weight"), (most * F.col("source_size")).cast("double")),
        ).alias("target"),
    )


def _time_of(demand: Column, start: Column, end: Column) -> Column:
    """The time t at which the ramp's integral reaches this share (0..1) of its whole."""
    slope, whole = end - start, (start + end) / 2
    root = F.sqrt(F.greatest(start * start + 2 * slope * demand * whole, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-12, demand).otherwise((root - start) / slope)


def curriculum(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS,
    ramps: Sequence[tuple[float, float]] = RAMPS, seed: int = 0, keep: Sequence[str] = (),
) -> DataFrame:
    """Per row: size, source_size, target, taken words, and the positions of its uses.

    Size is the number of words (null text: 0).  Null is a source of its own, named last.
    ``taken`` is size times the full rounds through the source plus what the last round still
    takes of the document, so a source's taken words add up to its target rounded down.
    ``positions`` has one time per round that takes any of it.  Documents without words take
    nothing.  Repeated rows are separate uses, ordered by id and size; ids may be null.
    A source without words has target 0.  Documents lie in the order of md5(seed:id).  Only the named columns are read.
    Columns in ``keep`` come along and order rows of one id and size.
    """
    rows = df.select(
        *keep,
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(count_words(F.col(text_col)), F.lit(0)).cast("bigint").alias("size"),
    ).withColumn("__order", hash_order("doc_id", seed)).withColumn("__bucket", F.substring("__order", 1, HEX_DIGITS))
    sizes = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sizes.withColumn("__before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .join(source_targets(sizes, weights, most, ramps).withColumnRenamed("source", "__s"),
              F.col("source").eqNullSafe(F.col("__s")))
        .select(F.col("source").alias("__s"), F.col("__bucket").alias("__b"), "__before",
                "source_size", "target", "ramp_from", "ramp_to")
    )
    inside = (
        Window.partitionBy("source", "__bucket").orderBy("__order", "doc_id", "size", *keep)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    laid = (
        rows.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("__s")) & F.col("__bucket").eqNullSafe(F.col("__b")))
        .withColumn("__start", F.col("__before") + F.col("__inside"))
        .withColumn("__wanted", F.floor("target"))
        .withColumn("__rounds", F.coalesce(F.floor(F.col("__wanted") / F.nullif("source_size", F.lit(0))), F.lit(0)))
        .withColumn("__last", F.col("__wanted") - F.col("__rounds") * F.col("source_size"))
        .withColumn("__part", F.least(F.greatest(F.col("__last") - F.col("__start"), F.lit(0)), F.col("size")))
    )
    uses = F.col("__rounds") + F.when(F.col("__part") > 0, 1).otherwise(0)
    middle = lambda k: (k * F.col("source_size") + F.col("__start") + F.col("size") / 2) / F.col("target")
    times = F.transform(
        F.when((uses > 0) & (F.col("size") > 0), F.sequence(F.lit(0).cast("bigint"), uses - 1)).otherwise(F.array()),
        lambda k: _time_of(F.least(middle(k), F.lit(1.0)), F.col("ramp_from"), F.col("ramp_to")),
    )
    return laid.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("__rounds") * F.col("size") + F.col("__part")).cast("bigint").alias("taken"),
        times.alias("positions"), *keep,
    )


def by_position(df: DataFrame) -> DataFrame:
    """Range-sorted by training position; rows without a use come last."""
    first = F.get(F.col("positions"), F.lit(0))
    order = [first.asc_nulls_last(), F.col("doc_id").asc()]
    return df.withColumn("position", first).repartitionByRange(*order).sortWithinPartitions(
        F.col("position").asc_nulls_last(), "doc_id"
    )


def mixed_rows(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents' rows in training order, each as often as the mix uses it.

    A use stands for the whole document; of the one document in which a source's last round
    ends, the use stays if at least half of it was wanted.  Rows are told apart
    by a staged number, so they may repeat an id or have none.
    """
    rows = numbered(df)
    text = F.col(options.get("text_col", "text"))
    plan = curriculum(rows.withColumn("__text_sha256", text_digest(text)), id_col, keep=["__text_sha256", "__row"], **options)
    half = F.greatest(F.floor(F.col("taken") / F.nullif("size", F.lit(0)) + 0.5), F.lit(0)).cast("int")
    used = plan.select(
        "__row", F.explode(F.slice("positions", F.lit(1), half)).alias("__position")
    )
    return (
        rows.join(used, "__row")
        .repartitionByRange("__position", id_col)
        .sortWithinPartitions("__position", id_col)
        .select(*df.columns)
    )
