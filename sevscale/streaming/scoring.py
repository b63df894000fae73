"""Cleaning and scoring of unbounded text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sevscale.functions.text import clean_text
from sevscale.operators.features import linear_scores, score_models, tfidf_transform


def clean_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Clean the text column; stateless, any output mode."""
    return stream.withColumn(text_col, clean_text(F.col(text_col)))


def score_batch(
    batch: DataFrame, model: DataFrame, coefs: DataFrame, models: Sequence[str],
    id_col: str = "id", text_col: str = "text",
) -> DataFrame:
    """Clean and score one bounded set of texts: mean and per-model scores."""
    rows = clean_stream(batch, text_col).withColumnRenamed(id_col, "id")
    weights = tfidf_transform(model, rows, "id", text_col)
    return score_models(linear_scores(weights, coefs, rows, models), models)


def write_scores(
    stream: DataFrame, model: DataFrame, coefs: DataFrame, models: Sequence[str], out: str,
    checkpoint: str, id_col: str = "id", text_col: str = "text", **trigger,
) -> StreamingQuery:
    """Score every micro-batch with fixed text model and coefficients.

    Each micro-batch owns one folder that a retry overwrites, so results appear once.
    """

    def write(batch: DataFrame, number: int) -> None:
        scores = score_batch(batch, model, coefs, models, id_col, text_col)
        scores.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
