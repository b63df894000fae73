"""Label construction over whole frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sevscale.functions import labels as L
from sevscale.operators.ranking import ordinal_rank


def severity_sum(df: DataFrame, weights: Mapping[str, float] = L.SUM_WEIGHTS) -> DataFrame:
    return df.withColumn("y", L.severity_sum(weights))


def severity_class(df: DataFrame, id_col: str = "id", text_col: str = "comment_text") -> DataFrame:
    """Text with its severity as a class number."""
    return df.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), L.severity_sum().alias("y")
    )


def severity_max_weighted(df: DataFrame) -> DataFrame:
    return df.withColumn("y", L.severity_max_weighted())


def severity_gated(df: DataFrame, gate: float = L.SCORE_GATE) -> DataFrame:
    return df.withColumn("y", L.severity_gated(gate=gate))


def clamp_floor(df: DataFrame, col: str, out: str = "y") -> DataFrame:
    return df.withColumn(out, L.clamp_floor(L.present(col)))


def scale_max(df: DataFrame, col: str = "y") -> DataFrame:
    """Divide by the largest value of the frame; NULL where that is 0."""
    value = L.present(col)
    return df.withColumn(col, F.try_divide(value, df.agg(F.max(value)).scalar()))


def scale_minmax(df: DataFrame, col: str = "y") -> DataFrame:
    """Map the value range to 0..1; NULL for a constant column."""
    value = L.present(col)
    low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    return df.withColumn(col, F.try_divide(value - low, high - low))


def to_text_y(
    df: DataFrame, text_col: str, y_col: str, id_col: str = "id", source: str | None = None
) -> DataFrame:
    """The common training layout: id, text, y and, if named, the corpus it came from."""
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(y_col).alias("y")]
    if source is not None:
        columns.append(F.lit(source).alias("source"))
    return df.select(*columns)


def label_flags(df: DataFrame, flags: Sequence[str] = L.SIX_FLAGS) -> DataFrame:
    return df.withColumn("toxic_subtype_sum", L.label_sum(flags)).withColumn(
        "toxic_behaviour", L.any_label(flags)
    )


def encode_class(df: DataFrame, col: str = "y", out: str = "class_id") -> DataFrame:
    """Dense ids 0..C-1 for the classes seen, in class order.

    The distinct values are numbered in range partitions and staged, however many they are.
    """
    seen = df.where(F.col(col).isNotNull()).select(F.col(col).alias("__class")).distinct()
    table = ordinal_rank(seen, "__class", "__class", "__rank").select(
        F.col("__class").alias(col), (F.col("__rank") - 1).cast("bigint").alias(out)
    )
    return df.join(table, col, "left")


def join_labels(texts: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    return texts.join(labels, key, "inner")


def drop_unscored(df: DataFrame, col: str = "toxic", sentinel: int = -1) -> DataFrame:
    """Drop rows carrying the sentinel; a missing label is not a sentinel."""
    return df.where((F.col(col) != sentinel) | F.col(col).isNull())


def min_annotators(
    df: DataFrame, more_than: int = 5, col: str = "toxicity_annotator_count"
) -> DataFrame:
    return df.where(F.col(col) > more_than)


def stack_corpora(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Put corpora in (id, text, y) layout under each other, each row marked by source."""
    frames = [
        df.select("id", "text", F.col("y").cast("double").alias("y"),
                  F.lit(name).alias("source"))
        for name, df in parts.items()
    ]
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame)
    return stacked


def append_parts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Append by column name; columns one side lacks are filled with NULL."""
    return first.unionByName(second, allowMissingColumns=True)


def prepare_regression(
    flags: DataFrame | None = None, offences: DataFrame | None = None,
    more_flags: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Scaled (id, text, y) frames for the corpora given; any may be left out."""
    out = {}
    for name, df in (("flags", flags), ("more_flags", more_flags)):
        if df is not None:
            out[name] = to_text_y(scale_max(severity_sum(df)), "comment_text", "y")
    if offences is not None:
        scaled = scale_minmax(offences, "offensiveness_score")
        out["offences"] = to_text_y(scaled, "txt", "offensiveness_score")
    return out


def prepare_classes(
    flags: DataFrame | None = None, more_flags: DataFrame | None = None
) -> dict[str, DataFrame]:
    """(id, text, class) frames for the corpora given; any may be left out."""
    given = {"flags": flags, "more_flags": more_flags}
    return {name: severity_class(df) for name, df in given.items() if df is not None}
