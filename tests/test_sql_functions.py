"""The SQL functions against the column functions they stand for."""

import pytest
from pyspark.sql import functions as F

from sevscale.functions import labels, sql, text

TEXTS = [
    None, "", "plain words", "see https://a.b/c?d=1 and www.x.org now", '<a href="http://x">word</a> rest',
    "<b>bold</b> &amp; &lt;i&gt; &eacute;t&eacute; &copy 2 &#169; &#xA9; &#0; &#128; &#x1F600; &bogus; &", "a &ampb; &notit; &#55296;",
    "<script>var x = '<b>';</script>kept<style>p{}</style>", "open <!-- comment without end", "<!-- a --> b <script> never closed",
    "1 < 2 > 0 and <3", "emoji \U0001F600 中文 mix", "so   many    spaces", "wow!!!!! noooo??? aaaah a.b.c it's", "line\nbreak\ttab",
    "back\\slash 'quotes' \"double\" $1 {0}", "mark \ufdd0 <b>x</b>", "É<ScRiPt >x</sCrIpT >É", "&#x110000; &#99999999999; &#x00000041;",
]
CLEANERS = {
    "strip_urls": text.strip_urls, "decode_entities": text.decode_entities, "strip_html": text.strip_html,
    "strip_emoji": text.strip_emoji, "strip_specials": text.strip_specials, "squeeze_spaces": text.squeeze_spaces,
    "clean_text": text.clean_text, "clean_text_html_first": lambda t: text.clean_text(t, "html_first"),
    "normalize_punct": text.normalize_punct, "text_words": text.words,
}


@pytest.fixture(scope="module")
def registered(spark):
    return sql.register(spark)


def both(spark, view, name, call, column):
    rows = spark.sql(f"SELECT id, {call} AS v FROM {view}")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapIn" not in plan
    want = spark.table(view).select("id", column.alias("v"))
    assert rows.schema["v"].dataType.simpleString() == want.schema["v"].dataType.simpleString(), name
    return sorted(map(tuple, rows.collect()), key=str), sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("name", CLEANERS)
def test_cleaners(spark, registered, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "id long, body string").createOrReplaceTempView("texts")
    got, want = both(spark, "texts", name, f"{name}(body)", CLEANERS[name](F.col("body")))
    assert got == want


def test_cleaner_on_the_given_tables(spark, small, registered):
    spark.read.parquet(f"{small}/pages.parquet").selectExpr("page_id AS id", "html AS body").createOrReplaceTempView("pages_")
    got, want = both(spark, "pages_", "clean_text", "clean_text(body)", text.clean_text(F.col("body")))
    assert got == want and len(got) > 10


def test_severities(spark, registered):
    nan = float("nan")
    flags = [(1, 0, 1, 0, None, 1), (0, 0, 0, 0, 0, 0), (None,) * 6, (1, 1, 1, 1, 1, 1), (nan, 1, 0, 0, 0, 0)]
    spark.createDataFrame([(i, *map(lambda x: None if x is None else float(x), f)) for i, f in enumerate(flags)],
                          "id long, " + ", ".join(f"{n} double" for n in labels.SIX_FLAGS)).createOrReplaceTempView("flags_")
    named = ", ".join(labels.SIX_FLAGS)
    for name, column in {"severity_sum": labels.severity_sum(), "severity_max_weighted": labels.severity_max_weighted(),
                         "label_sum": labels.label_sum(), "any_label": labels.any_label()}.items():
        got, want = both(spark, "flags_", name, f"{name}({named})", column)
        assert got == want, name


def test_scores_and_strata(spark, registered):
    names = ("toxicity", *labels.SUB_SCORES)
    rows = [(i, x, *[None if (i + j) % 5 == 0 else (i * j % 7) / 10 for j in range(6)])
            for i, x in enumerate([0.1, 0.5, 0.51, None, float("nan"), -1.0, 2.5, 3.5, 0.25, 0.35])]
    spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)).createOrReplaceTempView("scores_")
    got, want = both(spark, "scores_", "severity_gated", f"severity_gated({', '.join(names)})", labels.severity_gated())
    assert got == want
    finite = "SELECT id, toxicity AS y FROM scores_ WHERE NOT isnan(toxicity) OR toxicity IS NULL"
    spark.sql(finite).createOrReplaceTempView("finite_")
    for name, column in {"clamp_floor": labels.clamp_floor(F.col("y")), "stratum_round": labels.stratum_round(F.col("y")),
                         "stratum_tenths": labels.stratum_tenths(F.col("y"))}.items():
        got, want = both(spark, "finite_", name, f"{name}(y)", column)
        assert got == want, name
