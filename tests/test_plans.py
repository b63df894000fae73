"""Physical plans: what must not occur in them, and what must."""

import pytest

from __spark_entry__ import queries
from sevscale.operators import features as V
from sevscale.operators.splits import undersample
from pyspark.sql import functions as F

FITS = {"ridge_fit", "ridge_cv", "rank_comments", "pair_ranker", "severity_classifier"}
LAZY = sorted(n for n in queries() if n not in FITS and not n.startswith("stream_"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_rows_and_no_product(spark, small, name):
    text = plan(queries()[name](spark, small))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_scan_reads_only_what_is_asked(spark, small):
    text = plan(queries()["char_wb_ngrams"](spark, small))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_filter_reaches_the_scan(spark, small):
    text = plan(queries()["min_annotators"](spark, small))
    assert "toxicity_annotator_count" in text
    assert "ReadSchema: struct<doc_id:bigint>" in text


def test_gram_counts_move_texts_once(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "c d")], "id long, text string")
    assert plan(V.gram_counts(texts, "id", "text")).count("Exchange hashpartitioning") == 1


def test_undersampling_does_not_move_the_pool(spark, small):
    rows = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    drawn = undersample(rows, F.col("y") == 1, F.col("y") == 0)
    top = plan(drawn).split("Subquery")[0]
    assert "Exchange" not in top
    assert drawn.count() == 100 + 150
