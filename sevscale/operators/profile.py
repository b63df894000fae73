"""Corpus profiling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sevscale.functions.labels import SIX_FLAGS, any_label, present
from sevscale.operators.ranking import bracketed_quantiles


def _shares(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key combination and their share of all rows of ``df`` carrying a label."""
    total = df.agg(F.count_if(any_label())).scalar()
    return (
        rows.groupBy(*keys)
        .agg(F.count("id").cast("bigint").alias("count"))
        .withColumn("perc", F.try_divide(F.col("count").cast("double"), total))
    )


def label_combo_topk(df: DataFrame, k: int = 10, flags: Sequence[str] = SIX_FLAGS) -> DataFrame:
    """The k most frequent label combinations among rows with any label."""
    return _shares(df, df.where(any_label(flags)), flags).orderBy(F.desc("count"), *flags).limit(k)


def label_pair_share(df: DataFrame) -> DataFrame:
    rows = df.where((F.col("toxic") == 1) | (F.col("severe_toxic") == 1))
    return _shares(df, rows, ["toxic", "severe_toxic"])


def subtype_only_combos(df: DataFrame, flags: Sequence[str] = SIX_FLAGS) -> DataFrame:
    """Combinations of rows with a specific label but not the general one."""
    rows = df.where((F.col("toxic") == 0) & any_label(flags))
    return _shares(df, rows, flags).orderBy(F.desc("count"), *flags)


def duplicate_count(df: DataFrame, col: str) -> DataFrame:
    """Rows beyond the first of each value; missing values equal each other.

    Texts stay where they are: their SHA-256 is counted instead.
    """
    value = F.unhex(F.sha2(col, 256)) if dict(df.dtypes)[col] == "string" else F.col(col)
    per_value = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    return per_value.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates")
    )


FACTS = "column string, count long, mean double, std double, min double, max double, q25 double, q50 double, q75 double"
QUARTILES = (0.25, 0.5, 0.75)
SKETCH_ACCURACY = 10_000
SKETCH_MARGIN = 5 / SKETCH_ACCURACY  # on either side; wider than the sketch errs


def describe_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, max, q25, q50, q75) of numeric columns, one row each.

    Two scans serve all columns: the first takes the plain facts and, by a mergeable sketch, a
    narrow bracket around each quartile; the second counts below and inside the brackets, and
    only what is inside is put in order.  Quartiles are exact.  Missing values and NaN are
    skipped; a column without values has count 0 and nulls.
    """
    values = df.select(*[present(c).alias(c) for c in cols])
    sides = [min(1.0, max(0.0, p + d)) for p in QUARTILES for d in (-SKETCH_MARGIN, SKETCH_MARGIN)]
    facts = values.agg(*[
        F.struct(
            F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"), F.max(c).alias("max"),
            F.percentile_approx(c, sides, SKETCH_ACCURACY).alias("sides"),
        ).alias(f"f{i}")
        for i, c in enumerate(cols)
    ]).first()
    brackets = {
        c: list(zip(f.sides[::2], f.sides[1::2])) if f.sides else [] for c, f in zip(cols, facts)
    }
    quartiles = bracketed_quantiles(values, QUARTILES, brackets)
    rows = [(c, f["count"], f["mean"], f["std"], f["min"], f["max"], *quartiles[c]) for c, f in zip(cols, facts)]
    return df.sparkSession.createDataFrame(rows, FACTS)


def describe_col(df: DataFrame, col: str) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles, max of a numeric column."""
    return describe_columns(df, [col]).drop("column")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def class_share(df: DataFrame, col: str) -> DataFrame:
    """Share of rows per value; rows without a value count in the whole, not as a class."""
    total = df.agg(F.count("*")).scalar()
    return (
        df.where(F.col(col).isNotNull()).groupBy(col)
        .agg((F.count("*").cast("double") / total).alias("share"))
    )


def fold_sizes(df: DataFrame, fold: str = "kfold") -> DataFrame:
    return df.groupBy(fold).agg(F.count("*").cast("bigint").alias("n"))


def n_distinct(df: DataFrame, col: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(col) if approximate else F.countDistinct(col)
    return df.agg(count.cast("bigint").alias("n"))


def count_where(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """One pass, one column per named condition."""
    return df.agg(*[F.count_if(c).cast("bigint").alias(n) for n, c in conditions.items()])


class StageCounts:
    """Rows after each stage, known once an action has run on the last one."""

    def __init__(self, stages: Mapping[str, Observation]):
        self._stages = stages

    def rows(self) -> list[tuple[str, int]]:
        return [(name, seen.get["n"]) for name, seen in self._stages.items()]


def counted_stages(
    df: DataFrame, steps: Mapping[str, Callable[[DataFrame], DataFrame]]
) -> tuple[DataFrame, StageCounts]:
    """Apply named steps one after the other, counting rows on the way.

    The counts come from the action that does the work, so nothing is read for their sake.  A task
    that is run again after its executor was lost in a later stage may count its rows again.
    """
    seen = {}
    for name, step in steps.items():
        seen[name] = Observation()
        df = step(df).observe(seen[name], F.count(F.lit(1)).alias("n"))
    return df, StageCounts(seen)


def stage_counts(df: DataFrame, steps: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(stage, n): row counts after each named step, from one run through all of them."""
    last, counts = counted_stages(df, steps)
    last.select(F.lit(1)).write.format("noop").mode("overwrite").save()
    return df.sparkSession.createDataFrame(counts.rows(), "stage string, n long")
