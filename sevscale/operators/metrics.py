"""Ensembles, losses, scoreboards and the metric log."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sevscale.operators.ranking import in_id_ranges
from sevscale.operators.splits import assign_batches
from sevscale.sources.staging import stage


def fold_mean(preds: DataFrame, key: str = "id", out: str = "pred") -> DataFrame:
    """Mean over the models, per row."""
    return preds.groupBy(key).agg(F.avg("pred").alias(out))


def fold_mean_round(preds: DataFrame, key: str = "id", out: str = "pred") -> DataFrame:
    return preds.groupBy(key).agg(F.rint(F.avg("pred")).alias(out))


def pair_scores(pairs: DataFrame, scores: DataFrame, key: str = "id", score: str = "pred") -> DataFrame:
    """Attach both texts' scores to each pair (joined by id; positions do not exist)."""
    side = scores.select(F.col(key).alias("__id"), F.col(score).alias("__score"))
    less = side.select(F.col("__id").alias("less_id"), F.col("__score").alias("p1"))
    more = side.select(F.col("__id").alias("more_id"), F.col("__score").alias("p2"))
    return pairs.join(less, "less_id").join(more, "more_id")


def judged(scored: DataFrame) -> DataFrame:
    """Gap and verdict per pair; a tie counts as wrong."""
    return scored.withColumn("diff", F.abs(F.col("p2") - F.col("p1"))).withColumn(
        "correct", (F.col("p1") < F.col("p2")).cast("int")
    )


def right_share() -> Column:
    return F.avg((F.col("p1") < F.col("p2")).cast("double"))


def pair_accuracy(scored: DataFrame) -> DataFrame:
    """Share of pairs in the right order, as ratio and as rounded percentage."""
    return scored.agg(right_share().alias("accuracy")).withColumn(
        "accuracy_pct", F.round(F.col("accuracy") * 100, 2)
    )


def hard_pairs(scored: DataFrame, k: int = 30, key: str = "pair_id") -> DataFrame:
    """The k wrongly ordered pairs with the smallest gap."""
    return judged(scored).where("correct = 0").orderBy("diff", key).limit(k)


def _squared_error(y: str, pred: str) -> Column:
    return (F.col(pred) - F.col(y)) * (F.col(pred) - F.col(y))


def mse(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg(_squared_error(y, pred)).alias("mse"))


def rmse(y: str = "y", pred: str = "pred") -> Column:
    return F.sqrt(F.avg(_squared_error(y, pred)))


def fold_rmse(df: DataFrame, y: str = "y", pred: str = "pred", fold: str = "fold") -> DataFrame:
    """Root mean squared error per fold, and the plain mean over folds (fold NULL)."""
    per_fold = df.groupBy(fold).agg(rmse(y, pred).alias("rmse"))
    return per_fold.rollup(fold).agg(F.avg("rmse").alias("rmse"))


def fold_report(oof: DataFrame, fold_pairs: DataFrame) -> DataFrame:
    """Scoreboard: per fold RMSE and pair accuracy; overall (fold NULL) their means.

    ``oof`` holds (fold, y, pred), ``fold_pairs`` holds (pair_id, fold, p1, p2).  The overall
    row also gets the accuracy of the fold-averaged scores.
    """
    errors = oof.groupBy("fold").agg(rmse().alias("rmse"))
    verdicts = fold_pairs.groupBy("fold").agg(right_share().alias("pair_accuracy"))
    mean_scores = fold_pairs.groupBy("pair_id").agg(F.avg("p1").alias("p1"), F.avg("p2").alias("p2"))
    ensemble = mean_scores.agg(right_share()).scalar()
    return (
        errors.join(verdicts, "fold")
        .rollup("fold")
        .agg(F.avg("rmse").alias("rmse"), F.avg("pair_accuracy").alias("pair_accuracy"))
        .withColumn("ensemble_accuracy", F.when(F.col("fold").isNull(), ensemble))
    )


def hinge(margin: float) -> Column:
    return F.greatest(F.lit(0.0), F.lit(margin) - (F.col("p2") - F.col("p1")))


def margin_loss(scored: DataFrame, margin: float = 0.7) -> DataFrame:
    return scored.agg(F.avg(hinge(margin)).alias("loss"))


def batched_mean(df: DataFrame, value: Column, size: int, id_col: str = "id") -> DataFrame:
    """Plain mean of batch means: rows of a short last batch weigh more."""
    loss = df.select(id_col, value.alias("value"))
    per_batch = assign_batches(loss, size, id_col=id_col).groupBy("batch").agg(
        F.avg("value").alias("value")
    )
    return per_batch.agg(F.avg("value").alias("value"))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(
        F.count("*").alias("n")
    )


def f1_micro(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Micro F1 of single-label classes, which is their accuracy."""
    hit = F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0))
    return confusion(df, y, pred).agg((hit.cast("double") / F.sum("n")).alias("f1"))


def f1_macro(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Plain mean of per-class F1 over all classes seen as label or prediction."""
    cells = confusion(df, y, pred).select(
        F.explode(F.array(
            F.struct(F.col("y").alias("c"), F.col("n").alias("t"), F.lit(0).alias("p")),
            F.struct(F.col("pred").alias("c"), F.lit(0).alias("t"), F.col("n").alias("p")),
        )).alias("s"),
        F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"),
    )
    per_class = cells.groupBy("s.c").agg(
        (F.sum("hit").cast("double") / F.sum(F.col("s.t") + F.col("s.p"))).alias("f1")
    )  # each hit appears on both sides, so this is 2TP / (2TP + FP + FN)
    return per_class.agg(F.avg("f1").alias("f1"))


def to_wide(preds: DataFrame, models: Sequence[int], key: str = "id") -> DataFrame:
    """One column m0, m1, ... per model; of several predictions of one model the largest."""
    wide = preds.groupBy(key).pivot("fold", list(models)).agg(F.max("pred"))
    return wide.select(key, *[F.col(f"`{m}`").alias(f"m{m}") for m in models])


def _pair_sums(columns: Sequence[str], shift: Sequence[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task and column pair: rows, sums, squares and product over rows that have both."""
    m = len(columns)
    first, second = np.triu_indices(m, 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, p, odd = (np.zeros((m, m)) for _ in range(5))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:m]]) - shift
            have = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[:m]])
            bad = have & ~np.isfinite(x)
            x = np.where(have & ~bad, x, 0.0)
            mask = have.astype(float)
            n += mask.T @ mask
            s += x.T @ mask  # sum of the row's column where the other one is there
            q += (x * x).T @ mask
            p += x.T @ x
            odd += bad.astype(float).T @ mask
        i, j = first, second
        yield pa.RecordBatch.from_arrays([
            pa.array(v) for v in (i.astype(np.int64), j.astype(np.int64), n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], p[i, j], odd[i, j] + odd[j, i])
        ], names=PAIR_SUMS)

    return add


PAIR_SUMS = ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy", "odd"]


def corr_upper(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absolute Pearson correlation of every column pair, in one pass; NULL if constant.

    Each task multiplies its rows as matrices and hands on one row of sums per pair, so the plan
    does not grow with the number of columns.  Sums are taken of distances from the first row,
    which keeps them exact where values are large and close together.  A pair with a value that is not
    a number has none.
    """
    if len(columns) < 2:
        raise ValueError("needs at least two columns")
    values = wide.select(*[F.col(f"`{c}`").cast("double") for c in columns])
    head = values.first()
    shift = [x if x is not None and math.isfinite(x) else 0.0 for x in (head or [0.0] * len(columns))]
    schema = "i long, j long, " + ", ".join(f"{c} double" for c in PAIR_SUMS[2:])
    total = values.mapInArrow(_pair_sums(columns, shift), schema).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in PAIR_SUMS[2:]])
    names = F.array(*[F.lit(c) for c in columns])
    var_x, var_y = (F.col(f"s{a}{a}") - F.col(f"s{a}") * F.col(f"s{a}") / F.col("n") for a in "xy")
    # what is left of a constant column after rounding is no spread
    flat = (var_x <= F.col("sxx") * 1e-14) | (var_y <= F.col("syy") * 1e-14)
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(var_x * var_y)
    return total.select(
        F.get(names, F.col("i").cast("int")).alias("col_i"), F.get(names, F.col("j").cast("int")).alias("col_j"),
        F.when(F.col("odd") > 0, float("nan")).when((F.col("n") == 0) | flat, None).otherwise(F.abs(r)).alias("r"),
    )


def correlated_columns(
    wide: DataFrame, columns: Sequence[str], threshold: float = 0.95
) -> DataFrame:
    """Columns correlated above the threshold with any column before them."""
    upper = corr_upper(wide, columns).where(F.col("r") > threshold)
    return upper.select(F.col("col_j").alias("column")).distinct()


def metric_mean(log: DataFrame) -> DataFrame:
    return log.groupBy("metric").agg(
        F.sum("value").alias("total"),
        F.count("value").cast("bigint").alias("n"),
        F.avg("value").alias("mean"),
    )


def running_mean(log: DataFrame) -> DataFrame:
    """Mean of each run's metric after every step.

    Steps fall in ranges first; each range starts from the totals of the ranges before it,
    so a run that holds most of the log is still spread over many tasks.
    """
    group = ["run", "metric"]
    keyed = in_id_ranges(log, "step", "__b")
    earlier = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*group, "__b").agg(
        F.sum("value").alias("__s"), F.count("value").alias("__n")
    ).select(
        *group, "__b",
        F.coalesce(F.sum("__s").over(earlier), F.lit(0.0)).alias("__s0"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
    )
    inside = Window.partitionBy(*group, "__b").orderBy("step").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    total = F.col("__s0") + F.coalesce(F.sum("value").over(inside), F.lit(0.0))
    count = F.col("__n0") + F.count("value").over(inside)
    return keyed.join(starts, [*group, "__b"]).select(
        *group, "step", "value", F.try_divide(total, count).alias("running_mean")
    )


def score_ceiling(scored: DataFrame, source: str = "source") -> DataFrame:
    """Per corpus the largest score either side of any pair got."""
    return scored.groupBy(source).agg(F.max(F.greatest("p1", "p2")).alias("ceiling"))


def epoch_values(log: DataFrame) -> DataFrame:
    """Mean of each metric per run, fold and epoch."""
    return log.groupBy("run", "fold", "metric", "epoch").agg(F.avg("value").alias("value"))


def best_epoch(epochs: DataFrame, keys: Sequence[str], mode: str = "min") -> DataFrame:
    """Best epoch of each group; of equal values the latest epoch wins."""
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be 'min' or 'max', not {mode!r}")
    signed = F.col("value") if mode == "min" else -F.col("value")
    best = F.min(F.struct(signed.alias("v"), (-F.col("epoch")).alias("e"), F.col("value")))
    return epochs.groupBy(*keys).agg(best.alias("b")).select(
        *keys, (-F.col("b.e")).alias("epoch"), F.col("b.value").alias("value")
    )


def best_by_fold(epochs: DataFrame, mode: str = "min", model: str = "model") -> DataFrame:
    """The best epoch of each run and fold, with the artefact name it was kept under."""
    return best_epoch(epochs, ["run", "fold"], mode).withColumn(
        "artefact",
        F.concat(F.lit(f"{model}_"), F.col("epoch"), F.lit("_epoch_f"), F.col("fold") + 1),
    )


STOP_BLOCK = 1 << 16  # checks of one series that come together


def _positions(epochs: DataFrame, keys: Sequence[str], signed: Column) -> DataFrame:
    """(keys, epoch, v, i): the checks of each series numbered from 1, by epoch ranges."""
    keyed = in_id_ranges(epochs.select(*keys, "epoch", signed.alias("v")), "epoch", "__b")
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*keys, "__b").agg(F.count("*").alias("__n")).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__b").alias("__at"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
    )
    same = F.col("__b") == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    line = Window.partitionBy(*keys, "__b").orderBy("epoch")
    return keyed.join(starts, same).select(
        *keys, "epoch", "v", (F.col("__n0") + F.row_number().over(line)).alias("i"))


def early_stop(
    epochs: DataFrame, keys: Sequence[str], min_delta: float = 0.001, patience: int = 5,
    mode: str = "min", block: int = STOP_BLOCK,
) -> DataFrame:
    """Epoch at which each group stops (NULL: never) and the best value by then.

    The best only moves on an improvement of more than ``min_delta``; ``patience`` checks
    in a row without one stop the run.  So a move leads to a move at most ``patience`` checks
    later, whatever came before it.  Blocks of ``block`` checks therefore say apart from each
    other, for each of their first ``patience`` checks, where a best that stands there leads:
    to a check at the start of the next block, or to its last move.  A series is then walked
    block by block; no task holds more of it than one block or one row per block.
    """
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be 'min' or 'max', not {mode!r}")
    if patience < 1:
        raise ValueError("patience must be at least 1")
    block = max(block, patience)
    signed = F.col("value") if mode == "min" else -F.col("value")
    series = stage(_positions(epochs, keys, signed.cast("double")), "early_stop")

    def check(i: Column, v: Column, at: Column) -> Column:
        return F.struct(at.cast("bigint").alias("b"), F.struct(i.cast("bigint").alias("i"), v.alias("v")).alias("c"))

    # check 0 stands for the start, with an infinite value; a block also sees the next one's start
    i, v, own = F.col("i"), F.col("v"), F.floor(F.col("i") / block)
    none = F.lit(None).cast("struct<b:bigint,c:struct<i:bigint,v:double>>")
    seen = series.select(*keys, F.inline(F.filter(F.array(
        check(i, v, own),
        F.when((i % block < patience) & (own > 0), check(i, v, own - 1)).otherwise(none),
        F.when(i == 1, check(F.lit(0), F.lit(float("inf")), F.lit(0))).otherwise(none),
    ), lambda s: s.isNotNull())))

    end = (F.col("b") + 1) * block

    def step(heads: Column, row: Column) -> Column:
        def move(head: Column) -> Column:
            better = (head["i"] < end) & (row["i"] > head["i"]) & (row["i"] - head["i"] <= patience) & (
                row["v"] < head["v"] - min_delta)
            return F.when(better, row).otherwise(head)

        return F.transform(heads, move)

    checks = F.array_sort(F.collect_list("c"))
    led = seen.groupBy(*keys, "b").agg(checks.alias("checks")).select(
        *keys, "b", F.aggregate("checks", F.slice("checks", 1, patience), step).alias("heads"))

    def onward(head: Column, row: Column) -> Column:
        here = F.floor(head["i"] / block) == row["b"]
        return F.when(here, F.get(row["heads"], (head["i"] % block).cast("int"))).otherwise(head)

    begin = F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(float("inf")).alias("v"))
    walked = led.groupBy(*keys).agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("b", "heads"))), begin, onward).alias("end")
    ).withColumn("stop_i", F.col("end.i") + patience)
    named = series.select(*[F.col(k).alias(f"__{k}") for k in keys], "i",
                          F.col("epoch").alias("stopped_epoch"))
    match = F.col("stop_i") == F.col("i")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    best = F.col("end.v") if mode == "min" else -F.col("end.v")
    return walked.join(named, match, "left").select(
        *keys, F.col("stopped_epoch").cast("bigint").alias("stopped_epoch"),
        best.alias("best_value"),
    )


def ranked_with_text(ranks: DataFrame, texts: DataFrame, key: str = "comment_id") -> DataFrame:
    """Ranks joined to their texts, best first."""
    return ranks.join(texts, key).orderBy(F.desc("score"))
