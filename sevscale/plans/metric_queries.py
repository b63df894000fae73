"""Queries over predictions, pairs and the metric log."""

from __future__ import annotations

from pyspark.sql import functions as F

from sevscale.operators import labels as ops
from sevscale.operators import metrics as M
from sevscale.operators.models import blend
from sevscale.operators.ranking import ordinal_rank
from sevscale.plans.catalog import query
from sevscale.plans.frames_sql import over
from sevscale.plans.label_queries import rated_labels
from sevscale.sources import frames

MODEL_COLUMNS = [f"m{m}" for m in range(frames.MODELS)]


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def near(*names):
    """Six digits; the nudge settles exact halves, which sums in another order would not."""
    return [F.round(F.col(n) + 1e-9, 6).alias(n) for n in names]


def scored(spark, sf_dir):
    """Pairs with the fold-mean score of both texts."""
    return M.pair_scores(frames.pair_ids(spark, sf_dir), M.fold_mean(frames.preds(spark, sf_dir)))


def fold_scored(spark, sf_dir):
    preds = frames.preds(spark, sf_dir)
    less = preds.select(F.col("id").alias("less_id"), "fold", F.col("pred").alias("p1"))
    more = preds.select(F.col("id").alias("more_id"), "fold", F.col("pred").alias("p2"))
    return (
        frames.pair_ids(spark, sf_dir).join(less, "less_id").join(more, ["more_id", "fold"])
        .select("pair_id", "fold", "p1", "p2")
    )


def labelled_preds(spark, sf_dir):
    y = ops.severity_max_weighted(rated_labels(spark, sf_dir)).select("id", "y")
    return y.join(frames.preds(spark, sf_dir), "id")


def classed(spark, sf_dir):
    """True severity class next to a stand-in predicted class."""
    means = M.fold_mean(frames.preds(spark, sf_dir))
    y = ops.severity_sum(rated_labels(spark, sf_dir)).select("id", "y")
    return y.join(means, "id").select("id", "y", F.floor(F.col("pred") * 8).alias("pred"))


CLASSED = """
    (SELECT s.id, s.y, floor(m.pred * 8)::BIGINT AS pred
     FROM summed s JOIN mean_preds m ON s.id = m.id)"""


@query("fold_mean", over("mean_preds", "SELECT id, round(pred, 6) AS pred FROM mean_preds"))
def fold_mean(spark, sf_dir):
    return M.fold_mean(frames.preds(spark, sf_dir)).select("id", *r6("pred"))


@query("fold_mean_round", over("preds", """
    SELECT id, round_even(avg(pred * 8), 0) AS pred FROM preds GROUP BY id"""))
def fold_mean_round(spark, sf_dir):
    preds = frames.preds(spark, sf_dir).withColumn("pred", F.col("pred") * 8)
    return M.fold_mean_round(preds)


@query("pair_scores", over("scored", """
    SELECT pair_id, less_id, more_id, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM scored"""))
def pair_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("pair_id", "less_id", "more_id", *r6("p1", "p2"))


@query("pair_accuracy", over("scored", """
    SELECT round(avg((p1 < p2)::INT), 6) AS accuracy,
      round(100 * avg((p1 < p2)::INT), 2) AS accuracy_pct FROM scored"""))
def pair_accuracy(spark, sf_dir):
    return M.pair_accuracy(scored(spark, sf_dir)).select(*r6("accuracy"), "accuracy_pct")


@query("hard_pairs", over("scored", """
    SELECT pair_id, round(p1, 6) AS p1, round(p2, 6) AS p2, round(abs(p2 - p1), 6) AS diff
    FROM scored WHERE p1 >= p2 ORDER BY abs(p2 - p1), pair_id LIMIT 30"""))
def hard_pairs(spark, sf_dir):
    return M.hard_pairs(scored(spark, sf_dir)).select("pair_id", *r6("p1", "p2", "diff"))


@query("ranked_with_text", over("to_score mean_preds", """
    SELECT comment_id, text, row_number() OVER (ORDER BY round(pred, 6), id) AS score
    FROM to_score JOIN mean_preds ON comment_id = id"""))
def ranked_with_text(spark, sf_dir):
    texts = frames.to_score(spark, sf_dir)
    means = M.fold_mean(frames.preds(spark, sf_dir)).select(
        F.col("id").alias("comment_id"), *r6("pred")
    )
    wanted = means.join(texts.select("comment_id"), "comment_id", "left_semi")
    ranks = ordinal_rank(wanted, "pred", "comment_id", "score")
    return M.ranked_with_text(ranks.select("comment_id", "score"), texts)


@query("mse", over("severity mean_preds", """
    SELECT round(avg((pred - y) * (pred - y)), 6) AS mse
    FROM severity s JOIN mean_preds m ON s.id = m.id"""))
def mse(spark, sf_dir):
    y = ops.severity_max_weighted(rated_labels(spark, sf_dir)).select("id", "y")
    means = M.fold_mean(frames.preds(spark, sf_dir))
    return M.mse(y.join(means, "id")).select(*r6("mse"))


@query("fold_rmse", over("severity preds", """
    WITH per_fold AS (SELECT fold, sqrt(avg((pred - y) * (pred - y))) AS rmse
      FROM severity s JOIN preds p ON s.id = p.id GROUP BY fold)
    SELECT fold, round(rmse, 6) AS rmse FROM per_fold
    UNION ALL SELECT NULL, round(avg(rmse), 6) FROM per_fold"""))
def fold_rmse(spark, sf_dir):
    return M.fold_rmse(labelled_preds(spark, sf_dir)).select("fold", *r6("rmse"))


@query("fold_report", over("severity preds fold_scored", """
    WITH board AS (SELECT fold, rmse, pair_accuracy FROM
      (SELECT fold, sqrt(avg((pred - y) * (pred - y))) AS rmse
       FROM severity s JOIN preds p ON s.id = p.id GROUP BY fold)
      JOIN (SELECT fold, avg((p1 < p2)::INT) AS pair_accuracy FROM fold_scored GROUP BY fold)
      USING (fold)),
    means AS (SELECT avg(p1) AS p1, avg(p2) AS p2 FROM fold_scored GROUP BY pair_id)
    SELECT fold, round(rmse, 6) AS rmse, round(pair_accuracy, 6) AS pair_accuracy,
      NULL::DOUBLE AS ensemble_accuracy FROM board
    UNION ALL SELECT NULL, round(avg(rmse), 6), round(avg(pair_accuracy), 6),
      (SELECT round(avg((p1 < p2)::INT), 6) FROM means) FROM board"""))
def fold_report(spark, sf_dir):
    board = M.fold_report(labelled_preds(spark, sf_dir), fold_scored(spark, sf_dir))
    return board.select("fold", *r6("rmse", "pair_accuracy", "ensemble_accuracy"))


@query("margin_loss", over("scored", """
    SELECT round(avg(greatest(0, 0.7 - (p2 - p1))), 6) AS loss FROM scored"""))
def margin_loss(spark, sf_dir):
    return M.margin_loss(scored(spark, sf_dir)).select(*r6("loss"))


@query("batched_mean", over("scored", """
    WITH numbered AS (SELECT greatest(0, 0.7 - (p2 - p1)) AS loss,
        (row_number() OVER (ORDER BY pair_id) - 1) // 32 AS batch FROM scored)
    SELECT round(avg(m), 6) AS value FROM (SELECT avg(loss) AS m FROM numbered GROUP BY batch)"""))
def batched_mean(spark, sf_dir):
    losses = M.batched_mean(scored(spark, sf_dir), M.hinge(0.7), 32, "pair_id")
    return losses.select(*r6("value"))


@query("f1_micro", over("summed mean_preds", f"""
    SELECT round(avg((y = pred)::INT), 6) AS f1 FROM {CLASSED}"""))
def f1_micro(spark, sf_dir):
    return M.f1_micro(classed(spark, sf_dir)).select(*r6("f1"))


@query("f1_macro", over("summed mean_preds", f"""
    WITH c AS (SELECT * FROM {CLASSED}),
    seen AS (SELECT y AS k FROM c UNION SELECT pred FROM c)
    SELECT round(avg(2.0 * tp / (n_y + n_pred)), 6) AS f1 FROM (
      SELECT k, (SELECT count(*) FROM c WHERE y = k AND pred = k) AS tp,
        (SELECT count(*) FROM c WHERE y = k) AS n_y,
        (SELECT count(*) FROM c WHERE pred = k) AS n_pred FROM seen)"""))
def f1_macro(spark, sf_dir):
    return M.f1_macro(classed(spark, sf_dir)).select(*r6("f1"))


CORR = """
    cells AS (SELECT 'm' || a.fold AS col_i, 'm' || b.fold AS col_j,
      round(abs(covar_pop(a.pred, b.pred)
        / nullif(stddev_pop(a.pred) * stddev_pop(b.pred), 0)), 6) AS r
    FROM all_preds a JOIN all_preds b ON a.id = b.id AND a.fold < b.fold
    GROUP BY a.fold, b.fold)"""


def wide(spark, sf_dir):
    preds = frames.preds(spark, sf_dir, frames.MODELS)
    return M.to_wide(preds, range(frames.MODELS))


@query("corr_upper", over("all_preds", f"WITH {CORR} SELECT col_i, col_j, r FROM cells"))
def corr_upper(spark, sf_dir):
    return M.corr_upper(wide(spark, sf_dir), MODEL_COLUMNS).select("col_i", "col_j", *r6("r"))


@query("correlated_columns", over("all_preds", f"""
    WITH {CORR} SELECT DISTINCT col_j AS "column" FROM cells WHERE r > 0.95"""))
def correlated_columns(spark, sf_dir):
    return M.correlated_columns(wide(spark, sf_dir), MODEL_COLUMNS)


@query("metric_mean", over("metric_log", """
    SELECT metric, round(sum(value), 4) AS total, count(value) AS n, round(avg(value) + 1e-9, 6) AS mean
    FROM metric_log GROUP BY metric"""))
def metric_mean(spark, sf_dir):
    means = M.metric_mean(frames.metric_log(spark, sf_dir))
    return means.select("metric", F.round("total", 4).alias("total"), "n", *near("mean"))


@query("running_mean", over("metric_log", """
    SELECT run, metric, step, round(1e-9 + avg(value) OVER (
      PARTITION BY run, metric ORDER BY step
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_mean FROM metric_log"""))
def running_mean(spark, sf_dir):
    means = M.running_mean(frames.metric_log(spark, sf_dir))
    return means.select("run", "metric", "step", *near("running_mean"))


@query("score_ceiling", over("fold_scored", """
    SELECT fold, round(max(greatest(p1, p2)), 6) AS ceiling FROM fold_scored GROUP BY fold"""))
def score_ceiling(spark, sf_dir):
    return M.score_ceiling(fold_scored(spark, sf_dir), "fold").select("fold", *r6("ceiling"))


BEST = """
    SELECT run, fold, metric, epoch, round(value + 1e-9, 6) AS value FROM epochs
    QUALIFY row_number() OVER (PARTITION BY run, fold, metric
      ORDER BY value {}, epoch DESC) = 1"""


@query("best_epoch", over("epochs", BEST.format("ASC")))
def best_epoch(spark, sf_dir):
    epochs = M.epoch_values(frames.metric_log(spark, sf_dir))
    best = M.best_epoch(epochs, ["run", "fold", "metric"])
    return best.select("run", "fold", "metric", "epoch", *near("value"))


@query("best_epoch_max", over("epochs", BEST.format("DESC")))
def best_epoch_max(spark, sf_dir):
    epochs = M.epoch_values(frames.metric_log(spark, sf_dir))
    best = M.best_epoch(epochs, ["run", "fold", "metric"], "max")
    return best.select("run", "fold", "metric", "epoch", *near("value"))


@query("best_by_fold", over("epochs", """
    SELECT run, fold, epoch, round(value + 1e-9, 6) AS value,
      'model_' || epoch || '_epoch_f' || (fold + 1) AS artefact
    FROM epochs WHERE metric = 'error'
    QUALIFY row_number() OVER (PARTITION BY run, fold ORDER BY value, epoch DESC) = 1"""))
def best_by_fold(spark, sf_dir):
    epochs = M.epoch_values(frames.metric_log(spark, sf_dir).where("metric = 'error'"))
    return M.best_by_fold(epochs).select("run", "fold", "epoch", *near("value"), "artefact")


@query("early_stop", over("epochs", """
    WITH line AS (SELECT *, row_number() OVER (
        PARTITION BY run, fold, metric ORDER BY epoch) AS i FROM epochs),
    walk AS (
      SELECT run, fold, metric, epoch, i, value AS best, 0 AS waited FROM line WHERE i = 1
      UNION ALL
      SELECT l.run, l.fold, l.metric, l.epoch, l.i,
        CASE WHEN l.value < w.best - 0.5 THEN l.value ELSE w.best END,
        CASE WHEN l.value < w.best - 0.5 THEN 0 ELSE w.waited + 1 END
      FROM walk w JOIN line l ON l.run = w.run AND l.fold = w.fold AND l.metric = w.metric
        AND l.i = w.i + 1
      WHERE w.waited < 3)
    SELECT run, fold, metric, max(epoch) FILTER (waited = 3) AS stopped_epoch,
      round(min(best) + 1e-9, 6) AS best_value FROM walk GROUP BY run, fold, metric""", recursive=True))
def early_stop(spark, sf_dir):
    epochs = M.epoch_values(frames.metric_log(spark, sf_dir))
    ends = M.early_stop(epochs, ["run", "fold", "metric"], min_delta=0.5, patience=3)
    return ends.select("run", "fold", "metric", "stopped_epoch", *near("best_value"))


BLEND = """
    parts AS (SELECT * FROM fold_scored WHERE fold < 3),
    tops AS (SELECT fold, max(greatest(p1, p2)) AS ceiling FROM parts GROUP BY fold)"""


def _blended(spark, sf_dir):
    """Three models stand in for three corpora."""
    pair_rows = fold_scored(spark, sf_dir)
    preds = frames.preds(spark, sf_dir)
    sources = {f"model{f}": F.col("fold") == f for f in range(3)}
    return blend(
        {n: pair_rows.where(c).select("pair_id", "p1", "p2") for n, c in sources.items()},
        {n: preds.where(c).select("id", "pred") for n, c in sources.items()},
    )


@query("blend_scores", over("fold_scored", f"""
    WITH {BLEND} SELECT pair_id, round(sum(p1 / ceiling), 6) AS p1,
      round(sum(p2 / ceiling), 6) AS p2
    FROM parts JOIN tops USING (fold) GROUP BY pair_id"""))
def blend_scores(spark, sf_dir):
    return _blended(spark, sf_dir)[0].select("pair_id", *r6("p1", "p2"))


@query("blend_test_scores", over("fold_scored preds", f"""
    WITH {BLEND} SELECT id, round(sum(pred / ceiling), 6) AS pred
    FROM preds JOIN tops USING (fold) GROUP BY id"""))
def blend_test_scores(spark, sf_dir):
    return _blended(spark, sf_dir)[1].select("id", *r6("pred"))
