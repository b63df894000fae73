from pyspark.sql import functions as F

from sevscale.functions.text import clean_text
from sevscale.operators import features as V
from sevscale.operators.metrics import metric_mean, running_mean
from sevscale.plans import feature_queries as fq
from sevscale.sources.staging import stage
from sevscale.streaming.metrics import stream_metric_mean, stream_running_mean, windowed_metric_mean
from sevscale.streaming.scoring import clean_stream, score_batch, write_scores


def in_files(spark, df, path):
    """The frame as a stream of several files, one per micro-batch."""
    df.repartition(4).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_metric_means_equal_batch(spark, small, tmp_path):
    log = spark.read.parquet(f"{small}/events.parquet").select(
        F.col("event_type").alias("metric"), "value")
    query = (
        stream_metric_mean(in_files(spark, log, tmp_path / "in")).writeStream
        .outputMode("complete").format("memory").queryName("means")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r.metric: (r.n, round(r.total, 4)) for r in spark.table("means").collect()}
    assert got == {r.metric: (r.n, round(r.total, 4)) for r in metric_mean(log).collect()}


def test_late_rows_and_open_windows(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "m", 1.0), ("2024-01-01 00:50:00", "m", 3.0),
            ("2024-01-01 03:00:00", "m", 5.0)]
    df = spark.createDataFrame(rows, "ts string, metric string, value double").withColumn(
        "ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run():
        query = (
            windowed_metric_mean(stream).writeStream.outputMode("append").format("parquet")
            .option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).select("metric", "n", "mean").collect()

    assert run() == [("m", 2, 2.0)]  # the window at 03:00 is still open
    late = spark.createDataFrame(
        [("2024-01-01 00:20:00", "m", 100.0)], "ts string, metric string, value double"
    ).withColumn("ts", F.to_timestamp("ts"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [("m", 2, 2.0)]  # too late to count


def test_cleaning_equals_batch(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    query = (
        clean_stream(in_files(spark, docs, tmp_path / "in")).writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    want = docs.withColumn("text", clean_text(F.col("text")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_scores_equal_batch(spark, small, tmp_path):
    model = stage(V.fit_idf(fq.docs(spark, small), "id", "text"), "idf")
    coefs, turns = fq.coef_table(model), fq.turns(spark, small)
    write_scores(
        in_files(spark, turns, tmp_path / "in"), model, coefs, fq.MODELS, str(tmp_path / "out"),
        str(tmp_path / "state"),
    ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.batch for r in got.select("batch").distinct().collect()} == {0, 1, 2, 3}
    want = {r.id: round(r.pred, 9) for r in score_batch(turns, model, coefs, fq.MODELS).collect()}
    assert {r.id: round(r.pred, 9) for r in got.collect()} == want


def test_running_mean_with_rows_out_of_order_and_a_restart(spark, tmp_path):
    """Three runs of the query over files that arrive between them; rows are up to 40 seconds late."""
    n = 400
    log = spark.range(n).select(
        (F.col("id") % 2).alias("run"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("metric"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1_000_123).alias("ts"), F.col("id").alias("step"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 101).cast("double")).alias("value"))
    rows = log.collect()
    # within blocks of 40 steps the order is turned round; then come some rows beyond all others
    mixed = [rows[i] for b in range(0, n, 40) for i in reversed(range(b, b + 40))]
    end = [(9, "z", rows[-1].ts.replace(year=2030), 10_000, 0.0)]
    into = str(tmp_path / "in")

    def arrive(part):
        spark.createDataFrame(part, log.schema).coalesce(1).write.mode("append").parquet(into)

    def run():
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(into)
        query = (
            stream_running_mean(stream, "60 seconds").writeStream.outputMode("append").format("parquet")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert query.exception() is None

    arrive(mixed[:90])
    arrive(mixed[90:170])
    run()
    arrive(mixed[170:333])
    run()
    arrive(mixed[333:])
    arrive(end)
    arrive([(0, "a", rows[0].ts, 99_999, 5.0)])  # much too late: dropped
    run()
    out = spark.read.parquet(str(tmp_path / "out")).where("run < 2").select("run", "metric", "step", "running_mean")
    got = sorted((r.run, r.metric, r.step, None if r.running_mean is None else round(r.running_mean, 9)) for r in out.collect())
    want = sorted((r.run, r.metric, r.step, None if r.running_mean is None else round(r.running_mean, 9))
                  for r in running_mean(log).collect())
    assert got == want
