"""Global positions without a single-task window (W1 and the base of W2-W5).

A window without partition keys puts all rows in one task.  Here rows first fall in
ordered buckets; a row's position is the size of all earlier buckets plus its place inside
its own.  Only the bucket sizes, at most a few thousand rows, are ever brought together.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sevscale.sources.staging import stage, stage_at, staged_path, unstage

HEX_DIGITS = 3  # 4096 buckets of a hashed order

_BUCKET, _ORDER, _BEFORE = "__bucket", "__order", "__before"


def hash_order(id_col: str, seed: int | str) -> Column:
    """A reproducible shuffle key: the same on any cluster and in any engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _bucketed_position(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str
) -> DataFrame:
    """1-based position inside each ``by`` group; ``__bucket`` must be monotone in ``order``."""
    before = (
        Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = (
        df.groupBy(*by, _BUCKET)
        .agg(F.count("*").alias("__n"))
        .withColumn(_BEFORE, F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .select(*[F.col(c).alias(f"__by_{c}") for c in by],
                F.col(_BUCKET).alias("__b"), _BEFORE)
    )
    if not by:
        sizes = F.broadcast(sizes)  # one row per bucket, a fixed number of buckets
    match = F.col(_BUCKET) == F.col("__b")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    inside = Window.partitionBy(*by, _BUCKET).orderBy(*order)
    return (
        df.join(sizes, match)
        .withColumn(out, (F.col(_BEFORE) + F.row_number().over(inside)).cast("bigint"))
        .drop("__b", _BUCKET, _BEFORE, _ORDER, *[f"__by_{c}" for c in by])
    )


def hashed_rank(
    df: DataFrame, id_col: str, seed: int | str, out: str = "rank", by: Sequence[str] = ()
) -> DataFrame:
    """Position in the hashed order, over all rows or inside each ``by`` group.

    ``id_col`` must identify rows.  The buckets are the leading hash digits, so they are
    even whatever the data, and a dominant group is spread over all of them.
    """
    keyed = df.withColumn(_ORDER, hash_order(id_col, seed)).withColumn(
        _BUCKET, F.substring(_ORDER, 1, HEX_DIGITS)
    )
    return _bucketed_position(keyed, by, [F.col(_ORDER), F.col(id_col)], out)


def hash_cutoffs(
    df: DataFrame, id_col: str, seed: int | str, positions: Sequence[Column]
) -> Column:
    """The (hash, id) keys standing at the given 1-based positions of the hashed order.

    Bucket sizes tell which bucket holds each position; only those few buckets are ordered.
    The result is a scalar array in order, without positions that do not exist.
    """
    keyed = df.select(
        F.col(id_col).alias("__id"), hash_order(id_col, seed).alias(_ORDER)
    ).withColumn(_BUCKET, F.substring(_ORDER, 1, HEX_DIGITS))
    upto = Window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = (
        keyed.groupBy(_BUCKET).agg(F.count("*").alias("__n"))
        .withColumn("__upto", F.sum("__n").over(upto))
        .select(
            F.col(_BUCKET).alias("__b"), (F.col("__upto") - F.col("__n")).alias(_BEFORE),
            F.explode(F.array(*[p.cast("bigint") for p in positions])).alias("__at"),
            "__upto",
        )
        .where((F.col("__at") > F.col(_BEFORE)) & (F.col("__at") <= F.col("__upto")))
        .groupBy("__b").agg(F.first(_BEFORE).alias(_BEFORE), F.collect_set("__at").alias("__ats"))
    )
    inside = Window.partitionBy(_BUCKET).orderBy(_ORDER, "__id")
    placed = (
        keyed.join(F.broadcast(held), F.col(_BUCKET) == F.col("__b"))
        .withColumn("__place", F.col(_BEFORE) + F.row_number().over(inside))
        .where(F.array_contains("__ats", F.col("__place")))
    )
    keys = F.collect_list(F.struct(F.col(_ORDER).alias("h"), F.col("__id").alias("i")))
    return placed.agg(F.array_sort(keys)).scalar()


def hash_key(id_col: str, seed: int | str) -> Column:
    """A row's own key, comparable with ``hash_cutoffs``."""
    return F.struct(hash_order(id_col, seed).alias("h"), F.col(id_col).alias("i"))


def among_first(df: DataFrame, id_col: str, seed: int | str, wanted: Column) -> Column:
    """True for exactly the first ``wanted`` rows of the hashed order (all, if fewer).

    The rows themselves are neither moved nor sorted: each is compared with one key.
    """
    total = df.agg(F.count("*")).scalar()
    last = hash_cutoffs(df, id_col, seed, [wanted])
    inside = F.when(F.size(last) == 0, False).otherwise(hash_key(id_col, seed) <= F.get(last, F.lit(0)))
    return (wanted >= total) | inside


def in_id_ranges(df: DataFrame, id_col: str, out: str = _BUCKET) -> DataFrame:
    """Rows in ordered id ranges of about equal size, staged; ``out`` numbers the range.

    The cuts are sampled from the ids, so far outliers and gaps do not matter.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(parts, id_col).withColumn(out, F.spark_partition_id()), "id_ranges")


def id_rank(
    df: DataFrame, id_col: str, out: str = "rank", by: Sequence[str] = ()
) -> DataFrame:
    """Position in ascending order of a unique whole-number id."""
    return _bucketed_position(in_id_ranges(df, id_col), by, [F.col(id_col)], out)


def range_positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Rows in range partitions, staged, with ``__part`` and the place ``__pos`` in it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1),
        name,
    )


def before_part(staged: DataFrame, size: Column) -> DataFrame:
    """Total of ``size`` over all earlier parts; one row per part."""
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        staged.groupBy("__part")
        .agg(size.alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias(_BEFORE))
    )


def ordinal_rank(df: DataFrame, score: str, id_col: str, out: str = "rank") -> DataFrame:
    """Unique rank 1..N by ascending score, ties by id, missing scores last.

    Ranges are cut on (score, id), so even one score shared by most rows spreads over all
    tasks.  The sorted rows are staged before their sizes are read: the sizes and the rows
    then always come from the same cut.
    """
    order = [F.col(score).asc_nulls_last(), F.col(id_col).asc()]
    staged = range_positions(df, order, "ordinal_rank")
    sizes = before_part(staged, F.count("*"))
    return (
        staged.join(F.broadcast(sizes), "__part")
        .withColumn(out, (F.col(_BEFORE) + F.col("__pos")).cast("bigint"))
        .drop("__part", "__pos", _BEFORE)
    )


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """One row of linearly interpolated quantiles, columns q0, q1, ...; missing skipped.

    Without a sketch all distinct values are put in order.
    """
    values = df.select(F.col(value).cast("double").alias("v"))
    got = bracketed_quantiles(values, probs, {"v": [(float("-inf"), float("inf"))]})["v"]
    schema = ", ".join(f"q{i} double" for i in range(len(probs)))
    return df.sparkSession.createDataFrame([tuple(got)], schema)


def _slot(value: Column, brackets: Sequence[tuple[float, float]]) -> Column:
    """Odd inside bracket ``slot // 2``, even in the gap before it; numbers rise with the value."""
    slot = F.lit(0)
    for low, high in brackets:
        slot = slot + (value >= low).cast("int") + (value > high).cast("int")
    return slot


def _merged(brackets: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _closed_gap(brackets: Sequence[tuple[float, float]], slot: int) -> list[tuple[float, float]]:
    """The brackets with the gap ``slot`` taken in, together with its neighbours."""
    at = slot // 2
    low = brackets[at - 1][0] if at > 0 else float("-inf")
    high = brackets[at][1] if at < len(brackets) else float("inf")
    return _merged([*brackets, (low, high)])


def bracketed_quantiles(
    df: DataFrame, probs: Sequence[float], sketches: Mapping[str, Sequence[tuple[float, float]]]
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of several columns of doubles, from brackets.

    ``sketches`` holds per column the stretches of values where its quantiles are expected, say
    from a quantile sketch.  One scan serves all columns: values inside a bracket are counted by
    value, the others by the gap they lie in.  Only brackets that hold a wanted position are then
    ordered.  Brackets need not be right: where a position turns out to lie in a gap, the gap is
    taken in and the scan repeated, so the result is exact whatever the brackets.  Null values
    are skipped; a column without values has null quantiles.  The driver sees the sizes of
    brackets and gaps, and two values per quantile.
    """
    names = list(sketches)
    brackets = [_merged(sketches[c]) for c in names]
    path = staged_path(df.sparkSession, "bracketed")
    while True:
        cells = []
        for i, c in enumerate(names):
            slot = _slot(F.col(c), brackets[i])
            kept = F.when(slot % 2 == 1, F.col(c))
            cells.append(F.when(F.col(c).isNotNull(), F.struct(
                F.lit(i).alias("c"), slot.alias("slot"), kept.alias("v"))))
        counted = stage_at(
            df.select(F.explode(F.array(*cells)).alias("x")).where("x IS NOT NULL")
            .groupBy("x.c", "x.slot", "x.v").agg(F.count("*").alias("n")),
            path,
        )
        sizes = {(r["c"], r["slot"]): r["n"] for r in
                 counted.groupBy("c", "slot").agg(F.sum("n").alias("n")).collect()}
        wanted, missed = [], False  # (column, quantile, side, slot, place in the slot)
        for i in range(len(names)):
            total = sum(n for (c, _), n in sizes.items() if c == i)
            gaps = set()
            for j, p in enumerate(probs if total else ()):
                for k, at in enumerate((math.floor((total - 1) * p), math.ceil((total - 1) * p))):
                    slot = 0
                    while at >= sizes.get((i, slot), 0):
                        at -= sizes.get((i, slot), 0)
                        slot += 1
                    wanted.append((i, j, k, slot, at))
                    gaps |= {slot} if slot % 2 == 0 else set()
            if gaps:
                missed = True
                closed = [b for slot in gaps for b in _closed_gap(brackets[i], slot)]
                brackets[i] = _merged(closed)
        if not missed:
            break
    if not wanted:
        unstage(df.sparkSession, path)
        return {c: [None] * len(probs) for c in names}

    held = sorted({(i, slot) for i, _, _, slot, _ in wanted})
    starts, upto = {}, 0  # of the held slots, one after the other
    for key in held:
        starts[key], upto = upto, upto + sizes[key]
    inside = counted.where(F.struct("c", "slot").isin(
        [F.struct(F.lit(i).alias("c"), F.lit(slot).alias("slot")) for i, slot in held]))
    staged = range_positions(inside, [F.col("c"), F.col("slot"), F.col("v")], "bracket_order")
    by_part = Window.partitionBy("__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    spans = staged.join(F.broadcast(before_part(staged, F.sum("n"))), "__part").select(
        "v", "n", (F.col(_BEFORE) + F.sum("n").over(by_part)).alias("hi"))
    places = sorted({starts[i, slot] + at for i, _, _, slot, at in wanted})
    here = F.filter(
        F.array(*[F.lit(at).cast("bigint") for at in places]),
        lambda at: (at < F.col("hi")) & (at >= F.col("hi") - F.col("n")))
    found = {r["at"]: r["v"] for r in spans.select("v", F.explode(here).alias("at")).collect()}
    unstage(df.sparkSession, path)

    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in names}
    for i, j, _, slot, at in (w for w in wanted if w[2] == 0):
        total = sum(n for (c, _), n in sizes.items() if c == i)
        share = (total - 1) * probs[j] - math.floor((total - 1) * probs[j])
        low = found[starts[i, slot] + at]
        high_slot, high_at = next(w[3:] for w in wanted if w[:3] == (i, j, 1))
        high = found[starts[i, high_slot] + high_at]
        out[names[i]][j] = low if low == high or not share else low + (high - low) * share
    return out
