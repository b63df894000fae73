"""Frames derived from the given tables: labelled corpora, pairs, scores, metric log.

Each mirrors one SQL definition in ``sevscale.plans.frames_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sevscale.operators.ranking import id_rank
from sevscale.sources.tables import read_table

FOLDS = 5
MODELS = 7  # five folds, one linear copy of fold 0, one constant


def _every(n: int, base: Column) -> Column:
    return base & (F.col("doc_id") % n == 0)


def _flags(spark: SparkSession, sf_dir: str, *texts: Column) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", *texts)
    rated = docs.join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    toxic = F.col("toxic") == 1
    mild = (F.col("toxic") == 0) & (F.col("quality") == 0)
    hits = {
        "severe_toxic": _every(5, toxic),
        "obscene": _every(2, toxic),
        "threat": _every(7, toxic),
        "insult": _every(3, toxic) | _every(4, mild),
        "identity_hate": _every(11, toxic),
    }
    return rated.select(
        F.col("doc_id").alias("id"),
        *[c for c in docs.columns if c != "doc_id"],
        F.coalesce("toxic", F.lit(-1)).alias("toxic"),
        *[
            F.when(F.col("toxic").isNull(), -1).when(hit, 1).otherwise(0).alias(name)
            for name, hit in hits.items()
        ],
    )


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and six 0/1 flags per document; -1 everywhere for a document nobody labelled."""
    return _flags(spark, sf_dir, F.col("text").alias("comment_text"))


def flag_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)


def flag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("comment_text")
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractional scores per document and the number of annotators behind them."""
    doc = F.col("doc_id")

    def share(factor: int, modulus: int) -> Column:
        return (doc * factor % modulus).cast("double") / 100

    return read_table(spark, sf_dir, "documents").select(
        doc.alias("id"),
        F.col("text").alias("comment_text"),
        (share(37, 101) * share(37, 101)).alias("toxicity"),
        share(13, 53).alias("severe_toxicity"),
        share(29, 71).alias("obscene"),
        share(17, 31).alias("sexual_explicit"),
        share(41, 43).alias("identity_attack"),
        F.when(doc % 9 == 0, None).otherwise(share(7, 61)).alias("insult"),
        share(19, 37).alias("threat"),
        (doc % 12).alias("toxicity_annotator_count"),
    )


def offences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed offence scores per conversation turn."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return read_table(spark, sf_dir, "conversations").select(
        (conv * 100 + turn).alias("id"),
        F.col("text").alias("txt"),
        ((conv * 31 + turn * 17) % 201 - 100).cast("double").alias("raw"),
    ).select("id", "txt", (F.col("raw") / 100).alias("offensiveness_score"))


def pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled non-toxic document against a toxic one, in folds; ids only."""
    rated = (
        read_table(spark, sf_dir, "labels")
        .select("doc_id", "toxic")
        .join(read_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    )
    more = rated.where("toxic = 1").select(F.col("doc_id").alias("more_id"))
    less = rated.where("toxic = 0").select(F.col("doc_id").alias("less_id"))
    n_more = more.agg(F.count("*")).scalar()
    more = id_rank(more, "more_id", "rn").select("more_id", (F.col("rn") - 1).alias("slot"))
    less = id_rank(less, "less_id", "rn").withColumn("pair_id", F.col("rn") - 1)
    return (
        less.withColumn("slot", F.col("pair_id") % n_more)
        .join(more, "slot")
        .select("pair_id", "less_id", "more_id", (F.col("pair_id") % FOLDS).alias("kfold"))
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return (
        pair_ids(spark, sf_dir)
        .join(docs.select(F.col("doc_id").alias("less_id"), F.col("text").alias("less_toxic")),
              "less_id")
        .join(docs.select(F.col("doc_id").alias("more_id"), F.col("text").alias("more_toxic")),
              "more_id")
        .select("pair_id", "less_id", "more_id", "less_toxic", "more_toxic", "kfold")
    )


def to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, sf_dir).where("toxic = -1").select(
        F.col("id").alias("comment_id"), F.col("comment_text").alias("text")
    )


def preds(spark: SparkSession, sf_dir: str, models: int = FOLDS) -> DataFrame:
    """Stand-in scores: one row per document and model."""

    def score(fold: int) -> Column:
        base = (F.col("doc_id") * 7919 + fold * 104729) % 10007
        return base.cast("double") / 10007

    columns = [score(f) for f in range(FOLDS)] + [2 * score(0) + 1, F.lit(0.5)]
    return (
        read_table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("id"),
                F.posexplode(F.array(*columns[:models])).alias("fold", "pred"))
        .withColumn("fold", F.col("fold").cast("bigint"))
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("run"),
        (F.col("user_id") % 5).alias("fold"),
        F.floor(F.col("event_id") / 1000).cast("bigint").alias("epoch"),
        F.col("event_id").alias("step"),
        F.col("event_type").alias("metric"),
        "value",
    )
