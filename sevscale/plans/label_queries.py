"""Queries over severity labels, filters, joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sevscale.functions.labels import stratum_round, stratum_tenths
from sevscale.operators import labels as ops
from sevscale.plans.catalog import query
from sevscale.plans.frames_sql import over
from sevscale.sources import frames


def rated(spark, sf_dir):
    return ops.drop_unscored(frames.flags(spark, sf_dir))


def rated_labels(spark, sf_dir):
    return ops.drop_unscored(frames.flag_labels(spark, sf_dir))


def flag_parts(df):
    """A train and a test part of the labelled corpus."""
    return df.where("id % 4 <> 0"), df.where("id % 4 = 0")


def gated(spark, sf_dir):
    return ops.severity_gated(ops.min_annotators(frames.rates(spark, sf_dir)))


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


@query("join_labels", over("flags", """
    SELECT id, comment_text, toxic::BIGINT AS toxic, severe_toxic::BIGINT AS severe_toxic,
      obscene::BIGINT AS obscene, threat::BIGINT AS threat, insult::BIGINT AS insult,
      identity_hate::BIGINT AS identity_hate FROM flags"""))
def join_labels(spark, sf_dir):
    joined = ops.join_labels(frames.flag_texts(spark, sf_dir), frames.flag_labels(spark, sf_dir))
    return joined.select("id", "comment_text", *big(*ops.L.SIX_FLAGS))


@query("drop_unscored", over("rated", """
    SELECT id, toxic::BIGINT AS toxic, severe_toxic::BIGINT AS severe_toxic FROM rated"""))
def drop_unscored(spark, sf_dir):
    return rated_labels(spark, sf_dir).select("id", *big("toxic", "severe_toxic"))


@query("min_annotators", over("rates", """
    SELECT id, toxicity, toxicity_annotator_count FROM rates
    WHERE toxicity_annotator_count > 5"""))
def min_annotators(spark, sf_dir):
    return ops.min_annotators(frames.rates(spark, sf_dir)).select(
        "id", "toxicity", "toxicity_annotator_count"
    )


@query("severity_sum", over("summed", "SELECT id, y FROM summed"))
def severity_sum(spark, sf_dir):
    return ops.severity_sum(rated_labels(spark, sf_dir)).select("id", *big("y"))


@query("severity_class", over("summed", "SELECT id, comment_text AS text, y FROM summed"))
def severity_class(spark, sf_dir):
    return ops.severity_class(rated(spark, sf_dir)).select("id", "text", *big("y"))


@query("severity_max_weighted", over("severity", "SELECT id, y FROM severity"))
def severity_max_weighted(spark, sf_dir):
    return ops.severity_max_weighted(rated_labels(spark, sf_dir)).select("id", "y")


@query("severity_gated", over("gated", "SELECT id, round(y, 6) AS y FROM gated"))
def severity_gated(spark, sf_dir):
    return gated(spark, sf_dir).select("id", F.round("y", 6).alias("y"))


@query("clamp_floor", over("offences", """
    SELECT id, CASE WHEN offensiveness_score <= 0 THEN 0.0::DOUBLE
      ELSE offensiveness_score END AS y FROM offences"""))
def clamp_floor(spark, sf_dir):
    return ops.clamp_floor(frames.offences(spark, sf_dir), "offensiveness_score").select("id", "y")


@query("scale_max", over("summed", """
    SELECT id, round(y / (SELECT max(y) FROM summed)::DOUBLE, 6) AS y FROM summed"""))
def scale_max(spark, sf_dir):
    scaled = ops.scale_max(ops.severity_sum(rated_labels(spark, sf_dir)))
    return scaled.select("id", F.round("y", 6).alias("y"))


@query("scale_minmax", over("offences", """
    SELECT id, round((offensiveness_score - lo) / (hi - lo), 6) AS y FROM offences,
      (SELECT min(offensiveness_score) AS lo, max(offensiveness_score) AS hi FROM offences)"""))
def scale_minmax(spark, sf_dir):
    scaled = ops.scale_minmax(frames.offences(spark, sf_dir), "offensiveness_score")
    return scaled.select("id", F.round("offensiveness_score", 6).alias("y"))


@query("to_text_y", over("offences", """
    SELECT id, txt AS text, offensiveness_score AS y, 'offences' AS source FROM offences"""))
def to_text_y(spark, sf_dir):
    return ops.to_text_y(
        frames.offences(spark, sf_dir), "txt", "offensiveness_score", source="offences"
    )


@query("label_flags", over("rated", """
    SELECT id, (toxic + severe_toxic + obscene + threat + insult + identity_hate)::BIGINT
      AS toxic_subtype_sum,
      toxic + severe_toxic + obscene + threat + insult + identity_hate > 0 AS toxic_behaviour
    FROM rated"""))
def label_flags(spark, sf_dir):
    return ops.label_flags(rated_labels(spark, sf_dir)).select(
        "id", "toxic_subtype_sum", "toxic_behaviour"
    )


@query("encode_class", over("summed", """
    SELECT id, y, (dense_rank() OVER (ORDER BY y) - 1)::BIGINT AS class_id FROM summed"""))
def encode_class(spark, sf_dir):
    coded = ops.encode_class(ops.severity_sum(rated_labels(spark, sf_dir)))
    return coded.select("id", *big("y"), "class_id")


@query("stratum_keys", over("severity gated offences", """
    SELECT 'flags' AS source, id, round_even(y, 0)::BIGINT AS stratum FROM severity
    UNION ALL SELECT 'rates', id, round_even(y * 10, 0)::BIGINT FROM gated
    UNION ALL SELECT 'offences', id,
      round_even(greatest(offensiveness_score, 0) * 10, 0)::BIGINT FROM offences"""))
def stratum_keys(spark, sf_dir):
    y = F.col("y")
    parts = [
        ("flags", ops.severity_max_weighted(rated_labels(spark, sf_dir)), stratum_round(y)),
        ("rates", gated(spark, sf_dir), stratum_tenths(y)),
        ("offences", ops.clamp_floor(frames.offences(spark, sf_dir), "offensiveness_score"),
         stratum_tenths(y)),
    ]
    out = None
    for name, df, key in parts:
        part = df.select(F.lit(name).alias("source"), "id", key.alias("stratum"))
        out = part if out is None else out.unionByName(part)
    return out


def rate_flags(spark, sf_dir):
    """The fractional scores as flags, for a second corpus in the layout of flags."""
    named = {"toxicity": "toxic", "severe_toxicity": "severe_toxic", "obscene": "obscene", "threat": "threat",
             "insult": "insult", "identity_attack": "identity_hate"}
    return frames.rates(spark, sf_dir).select(
        "id", "comment_text", *[(F.col(c) >= 0.5).cast("int").alias(n) for c, n in named.items()])


@query("stack_corpora", over("summed rates offences", """
    WITH more AS (
      SELECT id, comment_text, (toxicity >= 0.5)::INT + 2 * (severe_toxicity >= 0.5)::INT + (obscene >= 0.5)::INT
        + (threat >= 0.5)::INT + coalesce((insult >= 0.5)::INT, 0) + (identity_attack >= 0.5)::INT AS y FROM rates)
    SELECT 'flags' AS source, id, comment_text AS text,
      round(y / (SELECT max(y) FROM summed)::DOUBLE, 6) AS y FROM summed
    UNION ALL SELECT 'more_flags', id, comment_text, round(y / (SELECT max(y) FROM more)::DOUBLE, 6) FROM more
    UNION ALL SELECT 'offences', id, txt, round((offensiveness_score - lo) / (hi - lo), 6)
    FROM offences,
      (SELECT min(offensiveness_score) AS lo, max(offensiveness_score) AS hi FROM offences)"""))
def stack_corpora(spark, sf_dir):
    parts = ops.prepare_regression(
        flags=rated(spark, sf_dir), more_flags=rate_flags(spark, sf_dir), offences=frames.offences(spark, sf_dir)
    )
    return ops.stack_corpora(parts).select("source", "id", "text", F.round("y", 6).alias("y"))


@query("append_parts", over("flags", """
    SELECT id, comment_text, toxic::BIGINT AS toxic FROM flags WHERE toxic <> -1
    UNION ALL SELECT id, comment_text, NULL FROM flags WHERE toxic = -1"""))
def append_parts(spark, sf_dir):
    rest = frames.to_score(spark, sf_dir).withColumnsRenamed(
        {"comment_id": "id", "text": "comment_text"}
    )
    both = ops.append_parts(
        rated(spark, sf_dir).select("id", "comment_text", "toxic"), rest
    )
    return both.select("id", "comment_text", *big("toxic"))
