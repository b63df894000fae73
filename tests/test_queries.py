"""Every query with SQL against DuckDB; the other ones by shape."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare

FNS, SQLS = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(SQLS))
def test_query_equals_sql(spark, small, name):
    problem, rows = compare(spark, small, name, FNS[name], SQLS[name])
    assert problem is None
    assert rows > 0


def test_entry_runs(spark):
    df = entry(spark)
    assert set(df.columns) == {"comment_id", "text", "score"}
    scores = [r.score for r in df.collect()]
    assert scores == list(range(len(scores), 0, -1))


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(FNS)
