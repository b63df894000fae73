"""Streaming queries, run over the whole given tables as files that arrive."""

from __future__ import annotations

from pyspark.sql import functions as F

from sevscale.operators import features as V
from sevscale.plans import feature_queries as fq
from sevscale.plans.catalog import query
from sevscale.plans.frames_sql import add_texts, over
from sevscale.plans.metric_queries import near, r6
from sevscale.plans.text_queries import cleaned
from sevscale.sources.staging import stage, staged_path
from sevscale.sources.tables import read_table
from sevscale.streaming.metrics import stream_metric_mean, stream_running_mean, windowed_metric_mean
from sevscale.streaming.scoring import clean_stream, write_scores

add_texts("clean_turn_", f"""
    SELECT conv_id * 100 + turn AS id, {cleaned('text')} AS text FROM conversations""")


def arriving(spark, sf_dir, name):
    """A given table, one file or a folder of them, as a stream of files."""
    # as a pattern the path may name either
    return spark.readStream.schema(read_table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.[p]arquet")


def log_stream(spark, sf_dir):
    return arriving(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric"), "value"
    )


def finished(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@query("stream_metric_mean", over("metric_log", """
    SELECT metric, round(sum(value), 4) AS total, count(value) AS n, round(avg(value) + 1e-9, 6) AS mean
    FROM metric_log GROUP BY metric"""))
def metric_means(spark, sf_dir):
    out = staged_path(spark, "stream_metric_mean")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(out)  # complete mode: the newest replaces all

    finished(
        stream_metric_mean(log_stream(spark, sf_dir)).writeStream.outputMode("complete")
        .foreachBatch(write).option("checkpointLocation", staged_path(spark, "state"))
        .trigger(availableNow=True).start()
    )
    return spark.read.parquet(out).select(
        "metric", F.round("total", 4).alias("total"), "n", *near("mean")
    )


@query("stream_windowed_mean", """
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
      event_type AS metric, count(value) AS n, round(avg(value) + 1e-9, 6) AS mean
    FROM events GROUP BY 1, 2""")
def windowed_means(spark, sf_dir):
    out = staged_path(spark, "stream_windowed_mean")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    finished(
        windowed_metric_mean(log_stream(spark, sf_dir)).writeStream.outputMode("update")
        .foreachBatch(write).option("checkpointLocation", staged_path(spark, "state"))
        .trigger(availableNow=True).start()
    )
    # update mode gives open windows too; of several states of a window the last counts
    last = spark.read.parquet(out).groupBy("window_start", "metric").agg(
        F.max_by(F.struct("n", "mean"), "batch").alias("s")
    )
    return last.select("window_start", "metric", "s.*").select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "metric", "n", *near("mean"),
    )


@query("stream_running_mean", """
    SELECT user_id % 3 AS run, event_type AS metric, event_id AS step, round(1e-9 + avg(value) OVER (
      PARTITION BY user_id % 3, event_type ORDER BY ts, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_mean FROM events""")
def running_means(spark, sf_dir):
    log = arriving(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("run"), F.col("event_type").alias("metric"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("step"), "value")
    out = staged_path(spark, "stream_running_mean")
    finished(
        stream_running_mean(log, "0 seconds").writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", staged_path(spark, "state")).trigger(availableNow=True).start()
    )
    return spark.read.parquet(out).select("run", "metric", "step", *near("running_mean"))


@query("stream_clean_text", f"SELECT doc_id AS id, {cleaned('text')} AS text FROM documents")
def clean_texts(spark, sf_dir):
    out = staged_path(spark, "stream_clean_text")
    docs = arriving(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    finished(
        clean_stream(docs).writeStream.option("path", out)
        .option("checkpointLocation", staged_path(spark, "state"))
        .format("parquet").trigger(availableNow=True).start()
    )
    return spark.read.parquet(out)


@query("stream_score", over("clean_turn_weights", f"""
    WITH s AS (SELECT t.id,
      {', '.join(f'coalesce(sum(weight * {fq.coef_sql(f)}), 0) AS m{f}' for f in range(5))}
      FROM ({fq.TURNS}) t LEFT JOIN clean_turn_weights w ON t.id = w.id GROUP BY t.id)
    SELECT id, round((m0 + m1 + m2 + m3 + m4) / 5, 6) AS pred FROM s"""))
def score_texts(spark, sf_dir):
    model = stage(V.fit_idf(fq.docs(spark, sf_dir), "id", "text"), "idf")
    out = staged_path(spark, "stream_score")
    turns = arriving(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"
    )
    finished(write_scores(
        turns, model, stage(fq.coef_table(model), "coefs"), fq.MODELS, out,
        staged_path(spark, "state"),
    ))
    return spark.read.parquet(out).select("id", *r6("pred"))
