"""Plans of the engine's operators: what is pushed down, pruned, shuffled and run in Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tidelog.operators import core
from tidelog.plans.compiler import Compiler
from tidelog.queries import expressions, runtime

PYTHON = {"json_get", "json_get_text", "json_get_verbatim", "json_path", "json_path_text", "json_contains", "json_contained_by"}  # no JSON function of the JVM keeps spelling


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_compiled_filters_reach_the_scan(spark, sf_dir):
    df = runtime.table(spark, sf_dir, "events")
    compiler = Compiler(expressions.TABLES["events"])
    told = plan(df.where(compiler.column("value > 50 and event_type in ('click', 'view') and user_id is not null")).select("event_id"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", told)[1]
    assert all(x in pushed for x in ("GreaterThan(value,50.0)", "In(event_type", "IsNotNull(user_id)"))
    assert "props" not in re.search(r"ReadSchema: (.*)", told)[1]


def test_fan_out_and_checks_do_not_shuffle(spark, sf_dir):
    assert "Exchange" not in plan(runtime.fanout_pending(spark, sf_dir))
    assert "Exchange" not in plan(runtime.check_violations(spark, sf_dir))


def test_delivery_is_a_top_k(spark, sf_dir):
    told = plan(runtime.deliver_topk(spark, sf_dir))
    assert "TakeOrderedAndProject" in told and "Exchange" not in told


def test_counts_are_combined_before_the_shuffle(spark, sf_dir):
    assert "partial_count" in plan(core.pending_counts(runtime.pending(spark, sf_dir)))


def test_no_cartesian_products(spark, sf_dir):
    rows, pending = runtime.events(spark, sf_dir), runtime.pending(spark, sf_dir)
    for df in (core.expired(rows, pending, 3, 2, key="event_id"), core.batch(rows, pending, 7, 10, "event_id"), core.stream_stats(pending, [7])):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)


@pytest.mark.parametrize("name", sorted(expressions.SPECS))
def test_python_runs_only_where_spark_has_no_expression(name, spark, sf_dir):
    assert ("Python" in plan(expressions.queries()[name](spark, sf_dir)) or "Arrow" in plan(expressions.queries()[name](spark, sf_dir))) == (name in PYTHON)


def test_an_order_is_total_over_partitions(spark):
    from tidelog.functions.hlc import indexed

    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k")).repartition(8)
    out, n = indexed(rows, [F.col("k")], "i")
    assert n == 20_000 and out.where("i <> k").isEmpty()
