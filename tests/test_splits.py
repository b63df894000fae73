from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sevscale.operators import ranking, splits
from sevscale.operators.ranking import bracketed_quantiles, exact_quantiles, hashed_rank, id_rank, ordinal_rank


def ids(spark, n, step=1, start=0):
    return spark.range(start, start + n * step, step)


@pytest.mark.parametrize("n", [1, 2, 5, 100, 5003])
def test_ordinal_rank_is_a_permutation(spark, n):
    # two thirds of all rows share one score
    df = ids(spark, n).withColumn(
        "s", F.when(F.col("id") % 3 != 0, 0.5).otherwise((F.col("id") * 7919 % 101) / 101))
    got = sorted((r.rank, r.s, r.id) for r in ordinal_rank(df, "s", "id").collect())
    assert [g[0] for g in got] == list(range(1, n + 1))
    assert [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_missing_scores_rank_last(spark):
    df = spark.createDataFrame([(1, None), (2, 0.2), (3, 0.1)], "id long, s double")
    assert {r.id: r.rank for r in ordinal_rank(df, "s", "id").collect()} == {3: 1, 2: 2, 1: 3}


@pytest.mark.parametrize("step,start", [(1, 0), (1000003, -50), (7, 10**12)])
def test_id_rank(spark, step, start):
    df = ids(spark, 500, step, start).repartition(5)
    got = sorted((r.id, r.rank) for r in id_rank(df, "id").collect())
    assert [g[1] for g in got] == list(range(1, 501))


def test_hashed_rank_in_groups_with_a_dominant_one(spark):
    df = ids(spark, 3000).withColumn("c", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(1))
    got = hashed_rank(df, "id", 1, by=["c"]).groupBy("c").agg(
        F.countDistinct("rank").alias("n"), F.max("rank").alias("top"))
    assert {r.c: (r.n, r.top) for r in got.collect()} == {1: (2700, 2700), None: (300, 300)}


@pytest.mark.parametrize("n,k", [(10, 3), (523, 5), (2, 5), (1000, 1), (0, 3)])
def test_kfold_sizes(spark, n, k):
    sizes = Counter(r.fold for r in splits.kfold(ids(spark, n), k).collect())
    assert [sizes.get(f, 0) for f in range(k)] == [n // k + (f < n % k) for f in range(k)]


def test_kfold_does_not_depend_on_partitions(spark):
    a = splits.kfold(ids(spark, 1000).coalesce(1), 4).collect()
    b = splits.kfold(ids(spark, 1000).repartition(9), 4).collect()
    assert sorted(a) == sorted(b)


def test_kfold_follows_the_hashed_order(spark):
    df = splits.kfold(hashed_rank(ids(spark, 100), "id", 42), 3)
    folds = [r.fold for r in df.orderBy("rank").collect()]
    assert folds == sorted(folds)


def stratified_counts(y, k):
    """Published allocation: class-sorted positions go to the folds in turn."""
    order = np.sort(np.unique(y, return_inverse=True)[1])
    return [np.bincount(order[f::k], minlength=order.max() + 1).tolist() for f in range(k)]


@pytest.mark.parametrize("k", [3, 5])
def test_stratified_allocation(spark, k):
    df = ids(spark, 523).withColumn(
        "c", F.when(F.col("id") < 7, F.col("id")).when(F.col("id") % 3 == 0, 0)
        .when(F.col("id") % 50 == 1, 5).otherwise(1))
    rows = splits.stratified_kfold(df, k, "c").collect()
    y = [r.c for r in sorted(rows)]
    first = {c: i for i, c in enumerate(dict.fromkeys(y))}
    coded = np.array([first[c] for c in y])
    want = stratified_counts(coded, k)
    got = [[0] * len(first) for _ in range(k)]
    for r in rows:
        got[r.fold][first[r.c]] += 1
    assert got == want


def test_holdout_and_samples(spark):
    df = ids(spark, 101)
    parts = Counter(r.part for r in splits.holdout_split(df, 0.2).collect())
    assert parts == {"test": 21, "train": 80}
    assert splits.sample_n(df, 10).count() == 10
    assert splits.sample_n(df, 1000).count() == 101
    assert splits.sample_frac(df, 0.1).count() == 10
    assert splits.sample_frac(df, 0.0).count() == 0
    assert splits.sample_frac(df, 1.0).count() == 101


def test_samples_of_growing_size_contain_each_other(spark):
    df = ids(spark, 500)
    drawn = [{r.id for r in splits.sample_n(df, n).collect()} for n in (50, 51, 400)]
    assert drawn[0] < drawn[1] < drawn[2]
    assert [len(d) for d in drawn] == [50, 51, 400]


def test_one_far_id_does_not_fill_a_bucket(spark):
    df = ids(spark, 4000).union(spark.createDataFrame([(10**15,), (-(2**62),), (2**62,)], "id long"))
    cut = ranking.in_id_ranges(df, "id", "b")
    sizes = [r["count"] for r in cut.groupBy("b").count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    batches = splits.assign_batches(df, 1000).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in batches) == [3, 1000, 1000, 1000, 1000]


def test_holdout_folds_do_not_overlap(spark):
    df = ids(spark, 50).select(F.col("id").alias("pair_id"), (F.col("id") % 5).alias("kfold"))
    all_folds = splits.fold_holdout(df, 5)
    for f in range(5):
        held = all_folds.where(F.col("holdout") == f)
        train, valid = held.where("role = 'train'"), held.where("role = 'valid'")
        assert train.join(valid, "pair_id").count() == 0
        assert train.count() + valid.count() == 50


def test_batches(spark):
    sizes = Counter(r.batch for r in splits.assign_batches(ids(spark, 70), 32, True).collect())
    assert sizes == {0: 32, 1: 32, 2: 6}
    in_order = splits.assign_batches(ids(spark, 70), 32).orderBy("id").collect()
    assert [r.batch for r in in_order] == [i // 32 for i in range(70)]


def labelled(spark, positives, negatives):
    return ids(spark, positives + negatives).withColumn(
        "y", (F.col("id") < positives).cast("int"))


def test_undersample_size(spark):
    df = labelled(spark, 7, 100)
    drawn = splits.undersample(df, F.col("y") == 1, F.col("y") == 0)
    assert Counter(r.y for r in drawn.collect()) == {1: 7, 0: 10}


def test_undersample_short_pool(spark):
    df = labelled(spark, 10, 5)
    capped = splits.undersample(df, F.col("y") == 1, F.col("y") == 0, on_short="cap")
    assert capped.count() == 15
    with pytest.raises(Exception, match="fewer negatives"):
        splits.undersample(df, F.col("y") == 1, F.col("y") == 0).collect()
    with pytest.raises(ValueError):
        splits.undersample(df, F.col("y") == 1, F.col("y") == 0, on_short="x")


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=400), np.full(300, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, "v", probs).first()
    assert list(got) == pytest.approx(np.quantile(x, probs).tolist())


@pytest.mark.parametrize("brackets", [
    [], [(5.0, 6.0)], [(0.2, 0.3)], [(-9.0, -8.0), (0.25, 0.25)], [(0.0, 0.1), (0.05, 0.4), (0.6, 0.7)],
])
def test_wrong_brackets_change_no_quantile(spark, brackets):
    rng = np.random.default_rng(5)
    columns = {"a": rng.normal(size=600).round(2), "b": np.repeat([0.25, 0.5], 300), "c": np.full(600, np.inf)}
    rows = [tuple(float(columns[c][i]) for c in "abc") + (None,) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = bracketed_quantiles(df, probs, dict.fromkeys("abcd", brackets))
    for c in "abc":
        assert got[c] == pytest.approx(np.quantile(columns[c], probs, method="linear").tolist()
                                       if c != "c" else [np.inf] * 5)
    assert got["d"] == [None] * 5


def test_strata_follow_each_other_over_ranges(spark):
    df = ids(spark, 900).withColumn("c", (F.col("id") * 7) % 211)
    rows = splits.stratified_kfold(df, 4, "c").collect()
    got = [[0] * 211 for _ in range(4)]
    first = {c: i for i, c in enumerate(dict.fromkeys(r.c for r in sorted(rows)))}
    for r in rows:
        got[r.fold][first[r.c]] += 1
    assert got == stratified_counts(np.array([first[r.c] for r in sorted(rows)]), 4)
