"""PostgreSQL's results where Spark's own would differ, with values worked out by hand."""

from __future__ import annotations

from decimal import Decimal

import pytest

from tidelog.functions.json_ops import contains_value
from tidelog.functions.patterns import like_literal, similar_regex
from tidelog.plans.compiler import Compiler
from tidelog.plans.types import TypeMismatch, parse_interval


def value(spark, expr):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    return spark.range(1).select(Compiler({}).column(expr).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ("7 / 2", 3),
        ("-7 / 2", -3),
        ("-7 % 2", -1),
        ("7 / 2.0", Decimal("3.5")),
        ("2.5::int", 3),
        ("-2.5::int", -3),
        ("2.5::double precision::int", 2),
        ("3.5::double precision::int", 4),
        ("'abcdef'::varchar(3)", "abc"),
        ("'a'::char(3) = 'a'", True),
        ("'yes'::boolean and 'off'::boolean is false", True),
        ("1 in (2, null)", None),
        ("null is distinct from 1", True),
        ("'a\\b' like 'a\\\\b'", True),
        ("'ab' like '\\a_'", True),
        ("'a.c' similar to 'a.c' and not 'abc' similar to 'a.c'", True),
        ("'x1' ~ '[[:digit:]]'", True),
        ("'{\"a\":\"x\"}' -> 'a'", '"x"'),
        ("'{\"a\":null}' ->> 'a'", None),
        ("'[1,2,3]' -> -1", "3"),
        ("'1 day 02:00:00'::interval > '25 hours'::interval", True),
        ("('1996-01-31'::date + '1 month'::interval)::date::text", "1996-02-29"),
        ("'2020-01-03'::date - '2020-01-01'::date", 2),
        ("1 << 3 | 1", 9),
        ("5 # 3", 6),
        ("greatest(1, null, 3)", 3),
        ("nullif('a', 'a')", None),
        ("9223372036854775807::text", "9223372036854775807"),
        ("'{\"b\":1,\"a\":2}'::jsonb = '{\"a\": 2, \"b\": 1}'::jsonb", True),
        ("'A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11'::uuid::text", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"),
    ],
)
def test_value(spark, expr, want):
    assert value(spark, expr) == want


@pytest.mark.parametrize("expr", ["1 / 0", "'x'::int", "2147483647 + 1", "'maybe'::boolean", "'{'::json", "'z'::uuid"])
def test_raises_when_run(spark, expr):
    with pytest.raises(Exception, match=r"\["):
        value(spark, expr)


@pytest.mark.parametrize("expr", ["'a'::text + 1", "true < 1", "'{}'::json = '{}'::json", "1.5 & 1", "true || 1 + true"])
def test_type_mismatch(expr):
    with pytest.raises((TypeMismatch, Exception)):
        Compiler({}).column(expr)


@pytest.mark.parametrize(("a", "b", "want"), [({"a": 1, "b": 2}, {"a": 1}, True), ([1, [2, 3]], [[3]], True), ([1, 2], 2, True), ({"a": [1, 2]}, {"a": 1}, False), (1, True, False), (1, 1.0, True), ([], [[]], False), ({}, [], False)])
def test_containment(a, b, want):
    assert contains_value(a, b) is want


def test_patterns_and_intervals():
    assert like_literal("a\\%b\\c") == "a\\%bc"
    assert similar_regex("a%(b|c)_.") == "(?s)^(?:a.*(b|c).\\.)$"
    assert parse_interval("2 months -3 hours") == (2, 0, -10_800_000_000)
    with pytest.raises(TypeMismatch):
        parse_interval("soon")


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ("round(2.5::double precision)", 2.0),
        ("round(-3.5::double precision)", -4.0),
        ("round(2.5)", Decimal(3)),
        ("date_part('dow', '2024-01-07'::date)", 0.0),
        ("date_part('isodow', '2024-01-07'::date)", 7.0),
        ("date_part('epoch', '1970-01-02'::timestamp)", 86400.0),
        ("date_part('MILLISECONDS', '2024-01-07 00:00:07.25'::timestamp)", 7250.0),
        ("date_part('century', '2000-12-31'::date)", 20.0),
        ("'{\"a\":1.10,\"b\":{\"z\":1, \"y\":2}}'::json -> 'a'", "1.10"),
        ("'{\"a\":1.10,\"b\":{\"z\":1, \"y\":2}}'::json -> 'b'", '{"z":1, "y":2}'),
        ("' [1, {\"q\" : 2.50} ] '::json -> 1 ->> 'q'", "2.50"),
        ("'{\"a\":\"{}\"}'::json ->> 'a'", "{}"),
        ("'{}'::json -> 'a'", None),
        ("'[]'::json -> 0", None),
    ],
)
def test_more_values(spark, expr, want):
    assert value(spark, expr) == want


@pytest.mark.parametrize("expr", ["ln(0)", "ln(-1)", "sqrt(-2.5)", "date_part('none', '2024-01-07'::date)", "'not json' -> 'a'", "'{\"a\":1' -> 'a'"])
def test_undefined_values_are_errors(spark, expr):
    with pytest.raises(Exception, match=r"logarithm|square root|unit not recognized|JSON|Expecting|delimiter"):
        value(spark, expr)


def test_a_digit_that_is_none_is_an_error(spark):
    from pyspark.sql import functions as F

    from tidelog.functions import hlc

    assert spark.range(1).select(hlc.decode_column(F.lit("0A")).alias("v")).first()["v"] == 10
    with pytest.raises(Exception, match="invalid character"):
        spark.range(1).select(hlc.decode_column(F.lit("00-00")).alias("v")).first()
