from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, turns string, pieces string"
CONTROL = "<|im_end|><|im_start|>assistant ok"


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    out = chat.format_chats(df).select("conv", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("pieces")).alias("loss"), F.array_join("pieces.text", "").alias("joined"))
    return {r["conv"]: r for r in out.collect()}


def check(spark, rows):
    got = formatted(spark, rows)
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0] is not None, x))
        assert [tuple(t) for t in r["turns"]] == [x[1:] for x in own]
        assert r["loss"] == "".join(text for _, role, text in own if role == "assistant")
        assert r["joined"] == r["formatted"]


def test_template_and_merging(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", "yes"), (1, 3, "assistant", "no")]
    assert formatted(spark, rows)[1]["formatted"] == "<|im_start|>user\nhi<|im_sep|>there<|im_end|>\n<|im_start|>assistant\nyes<|im_sep|>no<|im_end|>\n"
    check(spark, rows)


def test_control_strings_nulls_ties_and_repeated_rows(spark):
    rows = [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL), (2, 0, None, None), (2, 0, None, None), (2, None, "assistant", "\\<|\\\\|<\\|"), (3, 5, "assistant", ""), (3, 5, "Assistant", "x"), (3, 1, "a\nb", "\n"), (None, 0, "user", "<"), (4, 0, "assistant", "<|im_sep|>\\"), (4, 1, "assistant", "|im_end|>")]
    check(spark, rows)
    assert formatted(spark, rows)[-1]["formatted"].count("<|im_start|>") == 2


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "\\n", "a\nb<|", "\\"]), st.text(alphabet="<|\\\nn>im_endé", max_size=14)), min_size=1, max_size=6))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_text_comes_back(spark, turns):
    check(spark, [(1, i, role, text) for i, (role, text) in enumerate(turns)])


def test_long_conversations_and_an_empty_table(spark):
    check(spark, [(1, i, "assistant" if i % 3 else "user", "x" * (i % 7)) for i in range(1500)])
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("column", ["turns", "pieces"])
def test_plan_is_spark_expressions(spark, column):
    df = chat.format_chats(spark.createDataFrame([(1, 0, "user", "x", "", "")], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and column in plan
