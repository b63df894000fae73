"""Queries that profile the corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from sevscale.functions.labels import SIX_FLAGS
from sevscale.operators import labels as ops
from sevscale.operators import profile
from sevscale.plans.catalog import query
from sevscale.plans.frames_sql import over
from sevscale.plans.label_queries import big, gated, rated_labels
from sevscale.sources import frames

ANY = "toxic + severe_toxic + obscene + threat + insult + identity_hate > 0"
FLAG_COLUMNS = ", ".join(f"{f}::BIGINT AS {f}" for f in SIX_FLAGS)
TOTAL = f"(SELECT count(*) FROM rated WHERE {ANY})"


def shares(df, keys):
    return df.select(*big(*keys), "count", F.round("perc", 6).alias("perc"))


@query("label_combo_topk", over("rated", f"""
    SELECT {FLAG_COLUMNS}, count(*) AS count,
      round(count(*)::DOUBLE / {TOTAL}, 6) AS perc
    FROM rated WHERE {ANY} GROUP BY {', '.join('rated.' + f for f in SIX_FLAGS)}
    ORDER BY count(*) DESC, {', '.join('rated.' + f for f in SIX_FLAGS)} LIMIT 10"""))
def label_combo_topk(spark, sf_dir):
    return shares(profile.label_combo_topk(rated_labels(spark, sf_dir)), SIX_FLAGS)


@query("label_pair_share", over("rated", f"""
    SELECT toxic::BIGINT AS toxic, severe_toxic::BIGINT AS severe_toxic, count(*) AS count,
      round(count(*)::DOUBLE / {TOTAL}, 6) AS perc
    FROM rated WHERE toxic = 1 OR severe_toxic = 1 GROUP BY rated.toxic, rated.severe_toxic"""))
def label_pair_share(spark, sf_dir):
    return shares(
        profile.label_pair_share(rated_labels(spark, sf_dir)), ["toxic", "severe_toxic"]
    )


@query("subtype_only_combos", over("rated", f"""
    SELECT {FLAG_COLUMNS}, count(*) AS count,
      round(count(*)::DOUBLE / {TOTAL}, 6) AS perc
    FROM rated WHERE toxic = 0 AND {ANY}
    GROUP BY {', '.join('rated.' + f for f in SIX_FLAGS)}"""))
def subtype_only_combos(spark, sf_dir):
    return shares(profile.subtype_only_combos(rated_labels(spark, sf_dir)), SIX_FLAGS)


@query("duplicate_count", """
    SELECT (count(*) - count(DISTINCT text))::BIGINT AS duplicates FROM documents""")
def duplicate_count(spark, sf_dir):
    return profile.duplicate_count(frames.flag_texts(spark, sf_dir), "comment_text")


DESCRIBE = """
    SELECT count(y) AS count, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std,
      min(y)::DOUBLE AS min, max(y)::DOUBLE AS max,
      round(quantile_cont(y::DOUBLE, 0.25), 6) AS q25,
      round(quantile_cont(y::DOUBLE, 0.5), 6) AS q50,
      round(quantile_cont(y::DOUBLE, 0.75), 6) AS q75 FROM """


def described(df, col):
    facts = profile.describe_col(df, col)
    return facts.select("count", "min", "max", *[
        F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "q50", "q75")
    ])


@query("describe_severity", over("summed", DESCRIBE + "summed"))
def describe_severity(spark, sf_dir):
    return described(ops.severity_sum(rated_labels(spark, sf_dir)), "y")


@query("describe_offence", over("offences", DESCRIBE + """
    (SELECT offensiveness_score AS y FROM offences)"""))
def describe_offence(spark, sf_dir):
    return described(frames.offences(spark, sf_dir), "offensiveness_score")


RATED = ["toxicity", "severe_toxicity", "insult"]


@query("describe_ratings", over("rates", " UNION ALL ".join(
    f"SELECT '{c}' AS column, * FROM ({DESCRIBE} (SELECT {c} AS y FROM rates))" for c in RATED)))
def describe_ratings(spark, sf_dir):
    facts = profile.describe_columns(frames.rates(spark, sf_dir), RATED)
    return facts.select("column", "count", "min", "max", *[
        F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "q50", "q75")
    ])


@query("distinct_values", over("offences", "SELECT DISTINCT offensiveness_score FROM offences"))
def distinct_values(spark, sf_dir):
    return profile.distinct_values(frames.offences(spark, sf_dir), "offensiveness_score")


@query("class_share", over("summed", """
    SELECT y, round(count(*)::DOUBLE / (SELECT count(*) FROM summed), 6) AS share
    FROM summed GROUP BY y"""))
def class_share(spark, sf_dir):
    out = profile.class_share(ops.severity_sum(rated_labels(spark, sf_dir)), "y")
    return out.select(*big("y"), F.round("share", 6).alias("share"))


@query("fold_sizes", over("pairs", "SELECT kfold, count(*) AS n FROM pairs GROUP BY kfold"))
def fold_sizes(spark, sf_dir):
    return profile.fold_sizes(frames.pair_ids(spark, sf_dir))


@query("n_distinct", over("summed", "SELECT count(DISTINCT y) AS n FROM summed"))
def n_distinct(spark, sf_dir):
    return profile.n_distinct(ops.severity_sum(rated_labels(spark, sf_dir)), "y")


@query("count_where", over("gated", """
    SELECT count(*) FILTER (y > 0.5) AS high, count(*) FILTER (y <= 0.5) AS low,
      count(*) FILTER (toxicity > 0.5 AND y <= 0.5) AS gated_low FROM gated"""))
def count_where(spark, sf_dir):
    y, t = F.col("y"), F.col("toxicity")
    return profile.count_where(gated(spark, sf_dir), {
        "high": y > 0.5, "low": y <= 0.5, "gated_low": (t > 0.5) & (y <= 0.5),
    })


@query("stage_counts", over("flags", """
    SELECT 'read' AS stage, count(*) AS n FROM flags
    UNION ALL SELECT 'scored', count(*) FROM flags WHERE toxic <> -1
    UNION ALL SELECT 'positive', count(*) FROM flags WHERE toxic <> -1 AND toxic
      + severe_toxic + obscene + threat + insult + identity_hate > 0"""))
def stage_counts(spark, sf_dir):
    return profile.stage_counts(frames.flag_labels(spark, sf_dir), {
        "read": lambda df: df,
        "scored": ops.drop_unscored,
        "positive": lambda df: ops.label_flags(df).where("toxic_behaviour"),
    })
