from __future__ import annotations

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import suffix_dedup
from tidelog.llm.common import session_conf
from tidelog.llm.suffix import Block
from tidelog.llm.suffix_dedup import _sums, gram_hashes, runs

from .conftest import AWKWARD, prose

small = st.text(alphabet="ab\x00", min_size=1, max_size=40).map(str.encode)


@given(st.lists(small, min_size=1, max_size=5), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_order_is_that_of_prefixes(fragments, length):
    block = Block(fragments, [len(f) for f in fragments])
    order = block.order(length)
    prefixes = [block.text[i : min(i + length, int(block.ends[np.searchsorted(block.starts, i, "right") - 1]))] for i in order.tolist()]
    assert len(order) == sum(map(len, fragments)) == len(set(order.tolist()))
    assert prefixes == sorted(prefixes)


@given(st.lists(small, min_size=1, max_size=5), st.integers(1, 8), st.data())
@settings(max_examples=200, deadline=None)
def test_only_starts_asked_for(fragments, length, data):
    wanted = [data.draw(st.integers(0, len(f))) for f in fragments]
    block = Block(fragments, wanted)
    assert sorted(block.order(length).tolist()) == [int(s) + i for s, n in zip(block.starts, wanted, strict=True) for i in range(n)]


def test_hashes_depend_on_content_alone():
    data = np.frombuffer(prose(1, 300).encode() + b"abcdefgh" * 40, np.uint8)
    hashes = gram_hashes(_sums(data), 16)
    by_gram = {}
    for i, h in enumerate(hashes.tolist()):
        assert by_gram.setdefault(bytes(data[i : i + 16]), h) == h
    assert len(set(by_gram.values())) == len(by_gram) > 1000


@given(st.lists(st.text(alphabet="abc", min_size=12, max_size=80).map(str.encode), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_runs_cover_every_start_with_a_key_of_the_string(pieces):
    piece, key, digest, start, count, occurrences = runs(pieces, [len(x) - 11 for x in pieces], 12, 20, 4, 5)
    by_digest = {}
    for p, d, s, n in zip(piece.tolist(), digest.tolist(), start.tolist(), count.tolist(), strict=True):
        fragment = pieces[p][s : s + n + 19]
        assert by_digest.setdefault(d, fragment) == fragment
    keys = {}
    for p, k, s, n in zip(piece.tolist(), key.tolist(), start.tolist(), count.tolist(), strict=True):
        for i in range(s, s + n):
            assert (p, i) not in keys
            keys[p, i] = k
    assert sorted(keys) == [(p, i) for p, x in enumerate(pieces) for i in range(len(x) - 11)]
    by_string = {}
    for (p, i), k in keys.items():
        assert by_string.setdefault(pieces[p][i : i + 12], k) == k
    # a string that occurs twice has a key with two occurrences
    total = dict.fromkeys(key.tolist(), 0)
    for k, o in zip(key.tolist(), occurrences.tolist(), strict=True):
        total[k] += o
    strings = [(pieces[p][i : i + 12], k) for (p, i), k in keys.items()]
    for s, k in strings:
        if sum(x == s for x, _ in strings) > 1:
            assert total[k] > 1


def brute(texts: list[bytes], length: int):
    count = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


PASSAGE = prose(11, 20)
CASES = [
    [(i, t) for i, (_, t, *_x) in enumerate(AWKWARD) if t is None or len(t) < 2000],
    [(i, prose(20 + i, 30) + PASSAGE + prose(60 + i, 30)) for i in range(30)] + [(99, PASSAGE)],
    [(1, "ab" * 200), (2, "b" * 300), (3, "x" + "ab" * 40)],
    [(1, "Is onhe. " * 60 + prose(3, 20)), (2, prose(4, 20) + "Is onhe. " * 20)],
    [(1, prose(5, 40)), (1, prose(5, 40)), (2, prose(5, 39))],
    [(1, None), (2, "")],
]


def check(documents, rows, **options):
    length, window = 40, 24
    out = suffix_dedup.dedup(documents(rows), length=length, window=window, grams=(12, 20, window), **options).collect()
    got = [(r["id"], r["n_bytes"], sum(s["to"] - s["from"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"]), r["n_shared"]) for r in out]
    texts = [(t or "").encode() for _, t, *_x in rows]
    want = [(i, *b, s[1]) for (i, *_), b, s in zip(rows, brute(texts, length), brute(texts, window), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("options", [{}, {"block_bytes": 300}])
def test_dedup(documents, rows, options):
    """Small blocks deal every frequent key anew, down to single strings; results stay."""
    check(documents, rows, **options)


@given(st.lists(small, min_size=1, max_size=6), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_common_prefixes(fragments, length):
    block = Block(fragments, [len(f) for f in fragments])
    order = block.order(length)
    rest = [block.text[i : int(block.ends[np.searchsorted(block.starts, i, "right") - 1])][:length] for i in order.tolist()]
    want = [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(rest, rest[1:], strict=False)]
    assert block.common_prefixes(order, length).tolist() == want


def test_repeats_across_the_bounds_of_a_scan(documents, monkeypatch):
    """Passages that lie over the places where a long text is cut for scanning."""
    monkeypatch.setattr(suffix_dedup, "_SCAN_BYTES", 500)
    long = prose(30, 600)
    rows = [(1, long), (2, "xx " + long[460:560] + prose(31, 20)), (3, prose(32, 15) + long[990:1050] + long[1400:1600])]
    check(documents, rows)


def test_a_text_longer_than_a_scan(documents):
    long = prose(40, 30_000)
    cut = suffix_dedup._SCAN_BYTES
    assert len(long) > cut + 2000
    rows = [(1, long), (2, long[cut - 700 : cut + 500]), (3, prose(41, 30_000)[:1000])]
    got = {r["id"]: (r["n_bytes"], [(s["from"], s["to"]) for s in r["spans"]]) for r in suffix_dedup.dedup(documents(rows)).collect()}
    assert got == {1: (len(long), [(cut - 700, cut + 500)]), 2: (1200, [(0, 1200)]), 3: (1000, [])}


def test_awkward_rows_and_an_empty_table(documents):
    assert suffix_dedup.dedup(documents(AWKWARD)).count() == len(AWKWARD)
    assert suffix_dedup.dedup(documents(AWKWARD).limit(0)).count() == 0


def shuffled(spark) -> int:
    """Shuffle bytes that the session has written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    time.sleep(0.2)  # the status store takes figures every 100 ms
    spark.range(1).count()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_texts_are_shuffled_once(spark, documents):
    """Keys that fit a block, keys that do not and the result each join the texts; only the first dealing moves them."""
    draw = random.Random(5)
    noise = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=n))
    passages = [noise(900) for _ in range(4)]
    rows = [(i, noise(20_000) + (passages[i % 4] + noise(30) if i % 3 else "")) for i in range(120)]
    size = sum(len(t) for _, t in rows)
    docs = documents(rows).localCheckpoint()
    with session_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        before = shuffled(spark)
        got = {r["id"]: [(s["from"], s["to"]) for s in r["spans"]] for r in suffix_dedup.dedup(docs, block_bytes=1500).collect()}
        moved = shuffled(spark) - before
    assert sorted(got) == list(range(120))
    for i, spans in got.items():  # the noise around a passage may agree on a byte or two more
        assert len(spans) == (1 if i % 3 else 0) and all(19_990 < a <= 20_000 and 20_900 <= b < 20_910 for a, b in spans)
    assert size < moved < 4 * size, moved / size  # about twice the size are runs and fragments


def test_dealt_tables_join_as_they_lie(spark):
    """Null ids, ids that read like one another and equal rows stay apart or together as their values are."""
    rows = [(None, "a"), ("", "a"), ("-", "a"), ("+", "a"), ("+", "b"), ("x", "b"), ("x", "b")]
    df = spark.createDataFrame(rows, "id string, text string")
    df = df.select(suffix_dedup._node(df["id"], suffix_dedup.row_key(df["text"])).alias("node"), "id", "text")
    dealt = suffix_dedup.materialize_dealt(df, "dealt", "node")
    assert sorted(map(str, dealt.collect())) == sorted(map(str, df.collect()))
    counted = df.groupBy(df["node"].alias("of")).count()
    with session_conf(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false"):
        joined = dealt.join(counted, dealt["node"] == counted["of"]).select("id", "text", "count")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, joined.collect()), key=str) == sorted(((*r, 2 if r == ("x", "b") else 1) for r in rows), key=str)
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1
    assert not spark.catalog.listTables("default", "tidelog_*")
