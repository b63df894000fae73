import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sevscale.operators import metrics as M
from sevscale.operators.models import blend


def python_stop(values, min_delta, patience):
    best, waited = math.inf, 0
    for epoch, v in enumerate(values):
        if v < best - min_delta:
            best, waited = v, 0
        else:
            waited += 1
            if waited == patience:
                return epoch, best
    return None, best


def log(spark, series):
    rows = [(run, e, float(v)) for run, vs in series.items() for e, v in enumerate(vs)]
    return spark.createDataFrame(rows, "run int, epoch long, value double")


SERIES = [
    [5, 4, 3, 2, 1], [1, 1, 1, 1], [3, 2, 2.5, 2.4, 2.2, 1], [2, 1.5, 1.0, 0.5],
    [5, 4.9, 4.8, 4.7, 4.6, 4.5, 1], [1, 2, 0.4, 3, 3, 3, 0], [7],
]


@pytest.mark.parametrize("mode", ["min", "max"])
def test_early_stop(spark, mode):
    sign = 1 if mode == "min" else -1
    df = log(spark, {i: [sign * v for v in s] for i, s in enumerate(SERIES)})
    got = {r.run: (r.stopped_epoch, r.best_value) for r in
           M.early_stop(df, ["run"], 0.5, 3, mode).collect()}
    want = {}
    for i, s in enumerate(SERIES):
        stop, best = python_stop(s, 0.5, 3)
        want[i] = (stop, sign * best)
    assert got == want


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=60), min_size=20, max_size=30))
def test_early_stop_property(spark, series):
    df = log(spark, dict(enumerate(series)))
    got = {r.run: (r.stopped_epoch, r.best_value) for r in
           M.early_stop(df, ["run"], 3.0, 4).collect()}
    assert got == {i: python_stop(s, 3.0, 4) for i, s in enumerate(series)}


def test_latest_of_tied_epochs_wins(spark):
    df = log(spark, {1: [3, 1, 2, 1, 5], 2: [4, 4]})
    assert {r.run: r.epoch for r in M.best_epoch(df, ["run"]).collect()} == {1: 3, 2: 1}
    assert {r.run: r.epoch for r in M.best_epoch(df, ["run"], "max").collect()} == {1: 4, 2: 1}
    with pytest.raises(ValueError):
        M.best_epoch(df, ["run"], "x")


def test_running_mean(spark):
    rows = [(1, "m", s, float(s * s % 17)) for s in range(0, 5000, 3)]
    df = spark.createDataFrame(rows, "run int, metric string, step long, value double")
    total = 0.0
    got = [r.running_mean for r in M.running_mean(df.repartition(5)).orderBy("step").collect()]
    for i, (row, mean) in enumerate(zip(rows, got), 1):
        total += row[3]
        assert mean == pytest.approx(total / i)


def scored(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, p1 double, p2 double")


def test_pairs(spark):
    df = scored(spark, [(1, 0.1, 0.2), (2, 0.3, 0.3), (3, 0.9, 0.1), (4, 0.0, 2.0)])
    accuracy = M.pair_accuracy(df).first()
    assert (accuracy.accuracy, accuracy.accuracy_pct) == (0.5, 50.0)  # a tie is wrong
    assert [r.pair_id for r in M.hard_pairs(df).collect()] == [2, 3]
    assert M.margin_loss(df).first().loss == pytest.approx((0.6 + 0.7 + 1.5 + 0.0) / 4)


def test_short_batch_weighs_more(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, v double")
    assert M.batched_mean(df, F.col("v"), 2).first().value == pytest.approx((0.5 + 2.5 + 4) / 3)


def test_f1(spark):
    df = spark.createDataFrame(
        [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (3, 0)], "y long, pred long")
    assert M.f1_micro(df).first().f1 == pytest.approx(0.5)
    per_class = [2 / 4, 2 / 4, 2 / 3, 0]
    assert M.f1_macro(df).first().f1 == pytest.approx(sum(per_class) / 4)


def test_correlation(spark):
    df = spark.createDataFrame(
        [(float(i), 2.0 * i + 1, 5.0, float(i * i % 7)) for i in range(20)],
        "a double, b double, c double, d double")
    r = {(x.col_i, x.col_j): x.r for x in M.corr_upper(df, ["a", "b", "c", "d"]).collect()}
    assert r["a", "b"] == pytest.approx(1) and r["a", "c"] is None and len(r) == 6
    assert [x.column for x in M.correlated_columns(df, ["a", "b", "c", "d"]).collect()] == ["b"]
    with pytest.raises(ValueError):
        M.corr_upper(df, ["a"])


def test_fold_report(spark):
    oof = spark.createDataFrame(
        [(0, 1.0, 0.0), (0, 0.0, 0.0), (1, 1.0, 1.0)], "fold long, y double, pred double")
    pairs = spark.createDataFrame(
        [(1, 0, 0.0, 1.0), (1, 1, 0.5, 0.4), (2, 0, 0.0, 1.0), (2, 1, 9.0, 0.0)],
        "pair_id long, fold long, p1 double, p2 double")
    got = {r.fold: r for r in M.fold_report(oof, pairs).collect()}
    assert got[0].rmse == pytest.approx(math.sqrt(0.5)) and got[1].rmse == 0
    assert got[None].rmse == pytest.approx(math.sqrt(0.5) / 2)
    assert (got[0].pair_accuracy, got[1].pair_accuracy, got[None].pair_accuracy) == (1, 0, 0.5)
    assert got[None].ensemble_accuracy == 0.5


def test_blend(spark):
    a = scored(spark, [(1, 1.0, 2.0), (2, 4.0, 0.0)])
    b = scored(spark, [(1, 0.1, 0.5), (2, 0.2, 0.1)])
    test = spark.createDataFrame([(7, 2.0)], "id long, pred double")
    pairs, scores = blend({"a": a, "b": b}, {"a": test, "b": test})
    got = {r.pair_id: (r.p1, r.p2) for r in pairs.collect()}
    assert got[1] == pytest.approx((0.25 + 0.2, 0.5 + 1.0))
    assert got[2] == pytest.approx((1.0 + 0.4, 0.0 + 0.2))
    assert scores.first().pred == pytest.approx(0.5 + 4.0)


def stop_with_gaps(values, min_delta, patience):
    best, waited, end = math.inf, 0, None
    for i, v in enumerate(values):
        if v is not None and v < best - min_delta:
            best, waited = v, 0
        else:
            waited += 1
            if waited == patience:
                end = i
                break
    return end, best


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 16])
def test_early_stop_by_blocks(spark, block):
    draw = random.Random(block)
    rows, want = [], {}
    for run in range(40):
        values = [None if draw.random() < .1 else round(draw.random() * 10 - i * draw.choice([0, .5, 2]), 3)
                  for i in range(draw.randrange(1, 40))]
        rows += [(run, i * 3, v) for i, v in enumerate(values)]
        end, best = stop_with_gaps(values, 0.7, 3)
        want[run] = (None if end is None else end * 3, best)
    df = spark.createDataFrame(rows, "run int, epoch long, value double").repartition(5)
    got = {r.run: (r.stopped_epoch, r.best_value) for r in M.early_stop(df, ["run"], 0.7, 3, block=block).collect()}
    assert got == want


def test_early_stop_of_a_long_falling_series(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("run"), F.col("id").alias("epoch"), (-F.col("id")).cast("double").alias("value"))
    more = df.unionByName(spark.range(n, n + 9).select(F.lit(1).alias("run"), F.col("id").alias("epoch"), F.lit(0.0).alias("value")))
    ends = M.early_stop(more, ["run"], 0.5, 5)
    assert ends.collect() == [(1, n + 4, 1.0 - n)]
    assert M.early_stop(df, ["run"], 0.5, 5).collect() == [(1, None, 1.0 - n)]


def test_correlation_of_many_columns(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    base = draw.normal(size=(400, 5)) @ draw.normal(size=(5, 300)) + draw.normal(size=(400, 300)) + 1e6
    base[:, 7] = 3.25
    rows = [[None if (i + j) % 17 == 0 else float(x) for j, x in enumerate(r)] for i, r in enumerate(base)]
    names = [f"m{j}" for j in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(4)
    got = {(r.col_i, r.col_j): r.r for r in M.corr_upper(df, names).collect()}
    assert len(got) == 300 * 299 // 2
    x = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for i, j in [(0, 1), (3, 250), (17, 34), (298, 299), (0, 17)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert got[f"m{i}", f"m{j}"] == pytest.approx(abs(np.corrcoef(x[both, i], x[both, j])[0, 1]), abs=1e-9)
    assert got["m3", "m7"] is None


def test_correlation_without_rows_or_numbers(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (2.0, None, float("nan")), (4.0, None, 1.0)], "a double, b double, c double")
    got = {(r.col_i, r.col_j): r.r for r in M.corr_upper(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["b", "c"] is None and math.isnan(got["a", "c"])
    assert all(r.r is None for r in M.corr_upper(df.limit(0), ["a", "b", "c"]).collect())
