import pytest
from pyspark.sql import functions as F

from sevscale.functions import labels as L
from sevscale.operators import labels as ops
from sevscale.operators import profile
from sevscale.plans.rank_comments import train_flags

NAN = float("nan")


def flags(spark, rows):
    return spark.createDataFrame(
        rows, "id long, toxic int, severe_toxic int, obscene int, threat int, insult int, "
              "identity_hate int"
    )


def values(df, col="y"):
    return [r[col] for r in df.orderBy("id").collect()]


def test_severities(spark):
    df = flags(spark, [(1, 1, 1, 1, 1, 1, 1), (2, 0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 1, 0),
                       (4, 1, 0, None, 0, 0, 0)])
    assert values(ops.severity_sum(df)) == [7, 0, 1, 1]
    assert values(ops.severity_max_weighted(df))[:3] == [8.0, 0.0, 2.0]
    assert df.columns[-1] == "identity_hate"  # the input is as it was


def test_gate_and_missing_values(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 0.9), (2, 0.6, 0.1), (3, None, 0.2), (4, NAN, 0.3), (5, 0.9, NAN)],
        "id long, toxicity double, insult double",
    )
    for c in ("severe_toxicity", "obscene", "sexual_explicit", "identity_attack", "threat"):
        df = df.withColumn(c, F.lit(0.0))
    assert values(ops.severity_gated(df)) == [0.5, 0.1, 0.2, 0.3, 0.0]


def test_clamp(spark):
    df = spark.createDataFrame([(1, -0.5), (2, 0.0), (3, 0.7), (4, None)], "id long, x double")
    assert values(ops.clamp_floor(df, "x")) == [0.0, 0.0, 0.7, None]


def test_scaling_constant_columns(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.0)], "id long, y double")
    assert values(ops.scale_max(df)) == [None, None]
    assert values(ops.scale_minmax(df)) == [None, None]
    df = spark.createDataFrame([(1, 1.0), (2, NAN), (3, 3.0)], "id long, y double")
    assert values(ops.scale_minmax(df)) == [0.0, None, 1.0]


def test_strata_halves_go_to_even(spark):
    df = spark.createDataFrame(
        [(1, 0.5), (2, 1.5), (3, 2.5), (4, 0.15), (5, 0.35)], "id long, y double")
    y = F.col("y")
    assert values(df.withColumn("s", L.stratum_round(y)), "s") == [0, 2, 2, 0, 0]
    assert values(df.withColumn("s", L.stratum_tenths(y)), "s") == [5, 15, 25, 2, 4]


def test_encode_class(spark):
    df = spark.createDataFrame([(1, 7), (2, 0), (3, 3), (4, 7), (5, None)], "id long, y int")
    assert values(ops.encode_class(df), "class_id") == [2, 0, 1, 2, None]
    many = spark.range(12_000).select((F.col("id") * 3).alias("y"))
    assert ops.encode_class(many).where("class_id * 3 = y").count() == 12_000


def test_sentinel_keeps_missing(spark):
    df = spark.createDataFrame([(1, -1), (2, 0), (3, None)], "id long, toxic int")
    assert values(ops.drop_unscored(df), "id") == [2, 3]


def test_preparers_take_any_subset(spark):
    df = flags(spark, [(1, 1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 1, 1)]).withColumn(
        "comment_text", F.lit("t"))
    assert set(ops.prepare_regression(flags=df)) == {"flags"}
    assert ops.prepare_regression() == {}
    assert values(ops.prepare_regression(more_flags=df)["more_flags"]) == [0.5, 1.0]
    assert values(ops.prepare_classes(more_flags=df)["more_flags"]) == [1, 2]


def test_append_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id long, a string")
    b = spark.createDataFrame([(5, 2)], "b int, id long")
    assert ops.append_parts(a, b).orderBy("id").collect() == [(1, "x", None), (2, None, 5)]


def test_duplicates_count_missing_as_equal(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "t string")
    assert profile.duplicate_count(df, "t").first().duplicates == 2
    assert profile.duplicate_count(df.limit(0), "t").first().duplicates == 0


def test_describe(spark):
    import numpy as np

    x = [0.3, 0.1, 0.1, 5.0, -2.0, 0.7, 0.1]
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (NAN,)], "v double")
    got = profile.describe_col(df, "v").first()
    assert got["count"] == 7
    for name, value in (("mean", np.mean(x)), ("std", np.std(x, ddof=1)), ("min", -2), ("max", 5),
                        ("q25", np.quantile(x, 0.25)), ("q50", 0.1), ("q75", np.quantile(x, 0.75))):
        assert got[name] == pytest.approx(value)


def test_describe_many_columns_in_two_scans(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(30_000, 3))
    x[:, 1] = x[:, 1].round(1)
    df = spark.createDataFrame(
        [(*map(float, r), None) for r in x], "a double, b double, c double, none double").repartition(7)
    got = {r.column: r for r in profile.describe_columns(df, df.columns).collect()}
    for i, c in enumerate("abc"):
        assert [got[c].q25, got[c].q50, got[c].q75] == pytest.approx(
            np.quantile(x[:, i], (0.25, 0.5, 0.75)).tolist())
        assert got[c].std == pytest.approx(x[:, i].std(ddof=1))
    assert (got["none"]["count"], got["none"].q50, got["none"].max) == (0, None, None)
    empty = profile.describe_columns(df.limit(0), ["a"]).first()
    assert (empty["count"], empty.mean, empty.q25) == (0, None, None)


def test_class_share_counts_missing_in_the_whole(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "y int")
    assert {r.y: r.share for r in profile.class_share(df, "y").collect()} == {1: 0.5, 2: 0.25}


def test_parts_are_balanced_on_their_own(spark):
    def part(first, positives, negatives):
        rows = [(first + i, 1, 0, 0, 0, 0, 0) for i in range(positives)]
        rows += [(first + positives + i, 0, 0, 0, 0, 0, 0) for i in range(negatives)]
        return flags(spark, rows).withColumn("comment_text", F.lit("t"))

    out = train_flags([part(0, 4, 30), part(1000, 2, 30)])
    assert out.where("y = 0 AND id < 1000").count() == 6
    assert out.where("y = 0 AND id >= 1000").count() == 3
    assert out.where("y >= 1").count() == 6


def test_stage_counts_come_from_one_scan(spark, small):
    from sevscale.operators import profile

    labels = spark.read.parquet(f"{small}/labels.parquet")
    last, counts = profile.counted_stages(labels, {
        "all": lambda df: df, "toxic": lambda df: df.where("toxic = 1"), "none": lambda df: df.where("toxic > 1")})
    assert last._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    assert last.collect() == []
    rows = labels.collect()
    assert counts.rows() == [("all", len(rows)), ("toxic", sum(r.toxic == 1 for r in rows)), ("none", 0)]
