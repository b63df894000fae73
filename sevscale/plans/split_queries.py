"""Queries over samples, folds, batches, ranks and undersampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from sevscale.functions.labels import stratum_round
from sevscale.operators import labels as ops
from sevscale.operators import splits
from sevscale.operators.metrics import fold_mean
from sevscale.operators.ranking import ordinal_rank
from sevscale.plans.catalog import query
from sevscale.plans.frames_sql import over
from sevscale.plans.label_queries import flag_parts, gated, rated_labels
from sevscale.sources import frames
from sevscale.sources.tables import read_table


def doc_ids(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))


@query("sample_n", """
    SELECT doc_id AS id FROM documents ORDER BY md5('1:' || doc_id), doc_id LIMIT 50""")
def sample_n(spark, sf_dir):
    return splits.sample_n(doc_ids(spark, sf_dir), 50)


@query("sample_frac", """
    SELECT doc_id AS id FROM documents
    QUALIFY row_number() OVER (ORDER BY md5('1:' || doc_id), doc_id)
      <= round_even(0.15 * count(*) OVER (), 0)""")
def sample_frac(spark, sf_dir):
    return splits.sample_frac(doc_ids(spark, sf_dir), 0.15)


@query("sample_frac_approximate", """
    SELECT doc_id AS id FROM documents
    WHERE substr(md5('1:' || doc_id), 1, 8) < '19999999'""")
def sample_frac_approximate(spark, sf_dir):
    return splits.sample_frac(doc_ids(spark, sf_dir), 0.1, exact=False)


@query("kfold_assign", """
    WITH ranked AS (SELECT doc_id AS id, count(*) OVER () AS n,
        row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM documents)
    SELECT id, (CASE WHEN place < (n % 3) * (n // 3 + 1) THEN place // (n // 3 + 1)
      ELSE n % 3 + (place - (n % 3) * (n // 3 + 1)) // (n // 3) END)::BIGINT AS fold
    FROM ranked""")
def kfold_assign(spark, sf_dir):
    return splits.kfold(doc_ids(spark, sf_dir), 3)


@query("stratified_kfold", over("severity", """
    WITH classed AS (SELECT id, round_even(y, 0)::BIGINT AS stratum FROM severity),
    firsts AS (SELECT stratum, min(id) AS first_id FROM classed GROUP BY stratum)
    SELECT id, stratum, ((row_number() OVER (
        ORDER BY first_id, md5('123:' || id), id) - 1) % 5)::BIGINT AS fold
    FROM classed JOIN firsts USING (stratum)"""))
def stratified_kfold(spark, sf_dir):
    rows = ops.severity_max_weighted(rated_labels(spark, sf_dir)).select(
        "id", stratum_round(F.col("y")).alias("stratum")
    )
    return splits.stratified_kfold(rows, 5, "stratum")


@query("holdout_split", """
    SELECT doc_id AS id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id)
      <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS part FROM documents""")
def holdout_split(spark, sf_dir):
    return splits.holdout_split(doc_ids(spark, sf_dir), 0.2)


@query("fold_holdout", over("pairs", """
    SELECT pair_id, kfold, h AS holdout, CASE WHEN kfold = h THEN 'valid' ELSE 'train' END AS role
    FROM pairs, (SELECT unnest(range(5)) AS h)"""))
def fold_holdout(spark, sf_dir):
    pairs = frames.pair_ids(spark, sf_dir).select("pair_id", "kfold")
    return splits.fold_holdout(pairs, frames.FOLDS)


@query("assign_batches", """
    SELECT doc_id AS id, ((row_number() OVER (ORDER BY doc_id) - 1) // 64)::BIGINT AS batch,
      ((row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1) // 64)::BIGINT
        AS shuffled_batch FROM documents""")
def assign_batches(spark, sf_dir):
    in_order = splits.assign_batches(doc_ids(spark, sf_dir), 64)
    return splits.assign_batches(in_order, 64, shuffle=True, out="shuffled_batch")


@query("step_budget", """
    SELECT count(*) AS n_rows, (count(*) // 16 + 1)::BIGINT AS steps_plus_one,
      ceil(count(*) / 16.0)::BIGINT AS steps_ceil FROM documents""")
def step_budget(spark, sf_dir):
    return splits.step_budget(doc_ids(spark, sf_dir), 16)


@query("ordinal_rank", over("mean_preds", """
    SELECT id, row_number() OVER (ORDER BY round(pred, 2), id) AS rank FROM mean_preds"""))
def rank_scores(spark, sf_dir):
    means = fold_mean(frames.preds(spark, sf_dir)).select("id", F.round("pred", 2).alias("pred"))
    return ordinal_rank(means, "pred", "id").select("id", "rank")


@query("undersample_flags", over("severity", """
    WITH wanted AS (SELECT floor(1.5 * count(*)) AS n FROM severity WHERE y >= 1),
    drawn AS (SELECT id, y, row_number() OVER (ORDER BY md5('201:' || id), id) AS r
      FROM severity WHERE y = 0)
    SELECT id, y FROM severity WHERE y >= 1
    UNION ALL SELECT id, y FROM drawn, wanted WHERE r <= n"""))
def undersample_flags(spark, sf_dir):
    rows = ops.severity_max_weighted(rated_labels(spark, sf_dir)).select("id", "y")
    return splits.undersample(rows, F.col("y") >= 1, F.col("y") == 0)


@query("undersample_parts", over("severity", """
    WITH parts AS (SELECT id, y, id % 4 = 0 AS part FROM severity),
    wanted AS (SELECT part, floor(1.5 * count(*)) AS n FROM parts WHERE y >= 1 GROUP BY part),
    drawn AS (SELECT id, y, part, row_number() OVER (
        PARTITION BY part ORDER BY md5('201:' || id), id) AS r FROM parts WHERE y = 0)
    SELECT id, y FROM parts WHERE y >= 1
    UNION ALL SELECT d.id, d.y FROM drawn d JOIN wanted USING (part) WHERE r <= n"""))
def undersample_parts(spark, sf_dir):
    """Train and test part drawn on their own, then appended."""
    parts = [
        splits.undersample(
            ops.severity_max_weighted(part).select("id", "y"), F.col("y") >= 1, F.col("y") == 0
        )
        for part in flag_parts(rated_labels(spark, sf_dir))
    ]
    return ops.append_parts(*parts)


@query("undersample_gated", over("gated", """
    WITH wanted AS (SELECT floor(1.5 * count(*)) AS n FROM gated WHERE y > 0.5),
    drawn AS (SELECT id, y, row_number() OVER (ORDER BY md5('201:' || id), id) AS r
      FROM gated WHERE y <= 0.5)
    SELECT id, round(y, 6) AS y FROM gated WHERE y > 0.5
    UNION ALL SELECT id, round(y, 6) FROM drawn, wanted WHERE r <= n"""))
def undersample_gated(spark, sf_dir):
    rows = gated(spark, sf_dir).select("id", "y")
    drawn = splits.undersample(rows, F.col("y") > 0.5, F.col("y") <= 0.5)
    return drawn.select("id", F.round("y", 6).alias("y"))
