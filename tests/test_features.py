import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sevscale.functions import gram_batches as B
from sevscale.functions.grams import char_wb_array
from sevscale.operators import features as V


def python_grams(text):
    out = []
    for word in text.lower().split():
        word = f" {word} "
        for n in (4, 5, 6):
            out += [word[i:i + n] for i in range(max(1, len(word) - n + 1))]
            if len(word) <= n:
                break
    return out


TEXTS = ["a bb ccc dddd eeeee ffffff", "", "   ", "tab\tline\nend", "É ü same same",
         "long" * 100, "x" * 126 + " " + "y" * 127 + " " + "z" * 130]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_grams_equal_the_rule(spark, small):
    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = frame(spark, TEXTS + docs).select("text", char_wb_array(F.col("text")).alias("g"))
    for text, grams in rows.collect():
        assert Counter(grams) == Counter(python_grams(text))


def test_gram_counts_equal_the_rule(spark):
    got = {}
    for r in V.gram_counts(frame(spark, TEXTS), "id", "text").collect():
        got.setdefault(r.id, Counter())[r.gram] = r.tf
    want = {i: Counter(python_grams(t)) for i, t in enumerate(TEXTS)}
    assert got == {i: c for i, c in want.items() if c}


def test_tfidf_equals_the_formula(spark):
    texts = ["the cat sat", "the cat ran", "the dog ran", "a cat", ""]
    df = frame(spark, texts)
    model = V.fit_idf(df, "id", "text", min_df=2, max_df=0.6)
    seen = Counter(g for t in texts for g in set(python_grams(t)))
    kept = {g: math.log(6 / (1 + d)) + 1 for g, d in seen.items() if 2 <= d <= 3}
    assert {r.gram: pytest.approx(r.idf) for r in model.collect()} == kept
    got = {(r.id, r.gram): r.weight for r in V.tfidf_transform(model, df, "id", "text").collect()}
    for i, t in enumerate(texts):
        raw = {g: n * kept[g] for g, n in Counter(python_grams(t)).items() if g in kept}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        for g, w in raw.items():
            assert got.pop((i, g)) == pytest.approx(w / norm)
    assert not got


def test_features_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(
        F.col("doc_id").alias("id"), "text")
    facts = [
        V.gram_counts(df, "id", "text").agg(
            F.count("*"), F.sum("tf"), F.sum(F.xxhash64("id", "gram", "tf") % 1000003)).first()
        for df in (docs.coalesce(1), docs.repartition(7))
    ]
    assert facts[0] == facts[1]


def test_unknown_texts_get_the_intercept(spark):
    model = V.fit_idf(frame(spark, ["some words"] * 3), "id", "text", 1, 1.0)
    coefs = model.select("gram", F.lit(1.0).alias("m0"))
    new = frame(spark, ["zzz", "some"])
    weights = V.tfidf_transform(model, new, "id", "text")
    scores = {r.id: r.m0 for r in V.linear_scores(weights, coefs, new, ["m0"], [0.25]).collect()}
    assert scores[0] == 0.25 and scores[1] > 0.25
    with pytest.raises(ValueError):
        V.linear_scores(weights, coefs, new, [])


def test_encoding(spark):
    df = frame(spark, ["b b a", "c a b b b b", "", None])
    vocab = V.word_vocab(df, "text", 2)
    assert {r.word: r.word_id for r in vocab.collect()} == {"b": 4, "a": 5}
    got = {r.id: (list(r.ids), list(r["mask"])) for r in
           V.encode_fixed(df, "id", "text", vocab, 6).collect()}
    assert got[0] == ([1, 4, 4, 5, 2, 0], [1, 1, 1, 1, 1, 0])
    assert got[1] == ([1, 3, 5, 4, 4, 2], [1] * 6)
    assert got[2] == got[3] == ([1, 2, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0])


def test_head(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<float>")
    z = [(x - 2) / math.sqrt(2 / 3 + 1e-5) for x in (1, 2, 3)]
    s = 0.5 * z[0] - 0.25 * z[1] + 2 * z[2] + 0.1
    w = [0.5, -0.25, 2.0]
    assert V.head_score(df, "v", w, 0.1).first().score == pytest.approx(s)
    silu = V.head_score(df, "v", w, 0.1, "silu").first().score
    assert silu == pytest.approx(s / (1 + math.exp(-s)))


def test_rare_grams_leave_before_they_are_counted(spark):
    texts = [f"common words here {i}xq{i * 7919}" for i in range(30)] + ["once only", "", "   "]
    df = frame(spark, texts)
    every = V.gram_counts(df, "id", "text")
    kept = V.gram_counts(df, "id", "text", min_df=3)
    n = V.n_rows(df)
    vocab = lambda counts: sorted(tuple(r) for r in V.gram_vocab(counts, n, 3, 0.95).collect())
    assert vocab(kept) == vocab(every) and vocab(kept)
    assert kept.select("gram").distinct().count() < every.select("gram").distinct().count() / 2


def test_grams_that_share_a_bucket(spark):
    """With 64 buckets for all grams nearly every rare one stays; the vocabulary is the same."""
    texts = [f"common words here {i}xq{i * 7919}" for i in range(30)]
    df = frame(spark, texts)
    n = V.n_rows(df)
    got, want = (sorted(tuple(r) for r in V.gram_vocab(
        V.gram_counts(df, "id", "text", min_df=3, buckets=b), n, 3, 0.95).collect()) for b in (64, 1 << 16))
    assert got == want and got
    assert 64 <= V.LEAST_BUCKETS <= V.bucket_count(df) <= V.MOST_BUCKETS


def test_gram_rows_are_neither_broadcast_nor_moved(spark):
    df = frame(spark, ["some words", "other words", "some other"])
    model = V.fit_idf(df, "id", "text", 1, 1.0).withColumn("m0", F.lit(0.5))
    scores = V.linear_scores(V.tfidf_transform(model, df, "id", "text"), model, df, ["m0"])
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan.split("FlatMapGroupsInArrow", 1)[1]  # grams of small texts may be many
    assert "Window" not in plan
    above = plan.split("FlatMapGroupsInArrow", 1)[0]
    assert all("hashpartitioning(gram" not in line for line in above.splitlines())


def test_rows_of_one_id_count_together(spark, monkeypatch):
    df = spark.createDataFrame([(1, "aa bb"), (2, "cc"), (1, "bb"), (None, "aa"), (None, "dd"), (3, None)], "id long, text string")
    want = {1: Counter(python_grams("aa bb bb")), 2: Counter(python_grams("cc")), None: Counter(python_grams("aa dd"))}
    got = {}
    for r in V.gram_counts(df, "id", "text").collect():
        assert r.gram not in got.setdefault(r.id, Counter())
        got[r.id][r.gram] = r.tf
    assert got == want
    packed = {r.id: Counter(dict(zip(r.grams, r.tfs))) for r in V.gram_counts(df, "id", "text", packed=True).collect()}
    assert packed == want
    model = V.fit_idf(df, "id", "text", 1, 1.0)
    rows = V.tfidf_transform(model, df, "id", "text").collect()
    assert sorted((str(r.id), r.gram) for r in rows) == sorted((str(i), g) for i, c in want.items() for g in c)


def test_blocks_do_not_divide_an_id(monkeypatch):
    monkeypatch.setattr(B, "WORDS", 4)
    rows = [(1, ["a"] * 3), (1, ["b"] * 9), (1, ["c"]), (2, []), (3, ["d"] * 2), (None, ["e"]), (None, ["f"] * 6), (4, None)]
    for size in (1, 2, 8):
        batches = [pa.RecordBatch.from_pydict(
            {"id": pa.array([i for i, _ in rows[a:a + size]], pa.int64()), "words": pa.array([w for _, w in rows[a:a + size]], pa.list_(pa.string()))}
        ) for a in range(0, len(rows), size)]
        got = []
        for ids, text, words in B.blocks(iter(batches)):
            for n, i in enumerate(ids.to_pylist()):
                got.append((i, [w for t, w in zip(text, words.to_pylist()) if t == n]))
        assert got == [(1, ["a"] * 3 + ["b"] * 9 + ["c"]), (2, []), (3, ["d"] * 2), (None, ["e"] + ["f"] * 6), (4, [])]


def test_cuts_equal_the_rule_for_any_letters():
    wide = "".join(chr(0x4E00 + i) for i in range(1500))
    for words in (["a", "bb", "ccc", "é€😀z" * 9], [wide], ["x\0y" * 3], []):
        sizes, numbers, grams = B.cuts(pa.array(words, pa.string()), 4, 6)
        listed, at = grams.to_pylist(), 0
        for word, n in zip(words, sizes):
            assert Counter(listed[g] for g in numbers[at:at + n]) == Counter(python_grams(word))
            at += n


def test_batches_go_to_different_partitions(spark):
    marks = V.batch_marks(spark, 13)
    parts = spark.createDataFrame([(m,) for m in marks], "m int").select(F.pmod(F.hash("m"), F.lit(13))).collect()
    assert len({p[0] for p in parts}) == len(marks) == 13


def test_texts_move_once_for_model_and_weights(spark):
    df = spark.range(30).select("id", F.concat_ws(" ", F.col("id"), F.lit("word")).alias("text"))
    rows = V.tfidf_transform(V.fit_idf(df, "id", "text"), df, "id", "text")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "hashpartitioning(batch" in line and "REPARTITION" in line]
    assert len(moved) == 4  # texts for the model, for their grams and to be weighed; and the grams
    grams = plan.rsplit("FlatMapGroupsInArrow", 1)[1].split("Exchange hashpartitioning(batch", 1)
    assert "Filter" not in grams[1].split("Exchange", 1)[0]  # else the texts are split before they move, and move again


def test_scores_of_texts_equal_summed_gram_rows(spark):
    """Two models at once, repeated and null ids, texts without known grams, other coefficients null."""
    df = spark.createDataFrame(
        [(1, "some words here here"), (2, "some other words"), (3, "some words"), (3, "others here"), (4, ""), (5, "zzzz"), (None, "some")],
        "id long, text string")
    model = V.fit_idf(df, "id", "text", 2, 1.0).withColumn("m0", F.col("df") * 0.5 - F.char_length("gram")).withColumn(
        "m1", F.when(F.col("df") > 2, F.col("df") * 1.0))
    known = model.select("gram", "idf", "m0", "m1").withColumn("idf2", F.when(F.col("m1").isNotNull(), F.col("idf"))).withColumn("m2", F.col("m1"))
    got = {r.id: r for r in V.text_scores(known, df, "id", "text", [("idf", ["m0", "m1"]), ("idf2", ["m2"])]).collect()}
    whole = V.tfidf_transform(model, df, "id", "text").groupBy("id").agg(
        F.sum(F.col("weight") * F.col("m0")).alias("m0"), F.sum(F.col("weight") * F.col("m1")).alias("m1")).collect()
    part = V.tfidf_transform(model.where("m1 IS NOT NULL"), df, "id", "text").groupBy("id").agg(
        F.sum(F.col("weight") * F.col("m1")).alias("m2")).collect()
    assert {r.id for r in whole} == {1, 2, 3, None} and all(i not in got or got[i].m0 is None for i in (4, 5))
    for r in whole:
        assert (got[r.id].m0, got[r.id].m1 or 0) == pytest.approx((r.m0, r.m1 or 0))
    for r in part:
        assert got[r.id].m2 == pytest.approx(r.m2)


def test_scoring_lets_no_gram_rows_leave_the_batches(spark, small):
    from sevscale.plans.feature_queries import score_models

    plan = score_models(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "weight" not in plan and "partial" not in plan


def test_document_frequencies_summed_by_blocks_equal_counted_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "WORDS", 3)
    df = spark.createDataFrame([(i % 7, f"word{i % 4} again again") for i in range(20)], "id long, text string")
    rows = V.gram_vocab(V.gram_counts(df, "id", "text"), V.n_rows(df), 1, 1.0)
    assert sorted(map(tuple, V.fit_idf(df, "id", "text", 1, 1.0).select("gram", "df").collect())) == sorted(map(tuple, rows.collect()))


def test_rows_without_words_carry_an_empty_list(spark):
    """Spark asks a batch for its size at every row, for which null lists are walked again from the first: quadratic."""
    texts = spark.createDataFrame([(i, f"word{i % 3} other") for i in range(6)], "id long, text string")
    known = spark.createDataFrame([(" wor", 1.0), ("word", 2.0)], "gram string, idf double")
    both, _ = V._with_known(known, texts, "id", "text")
    rows = both.collect()
    assert {r.kind for r in rows} == {0, 1} and all(r.words is not None for r in rows)
