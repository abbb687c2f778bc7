"""Every query of the engine against its SQL on the small tables."""

from __future__ import annotations

import pytest
from compare import rows

from tidelog.queries import expressions, runtime

QUERIES = expressions.queries() | runtime.queries()
SQL = expressions.oracle_sql() | runtime.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(name, spark, duck, sf_dir):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert {r["aggregator_node_id"]: r["pending"] for r in entry.entry(spark).collect()} == {7: 1000, 12: 1000, 19: 1000}
    assert set(entry.oracle_sql()) <= set(entry.queries())
