from __future__ import annotations

import random
import time

import numpy as np
import pytest

from tidelog.llm import decontam

from .conftest import AWKWARD, prose

SCHEMA = "item_id bigint, text string"


def brute_tiling(text: list[str], item: list[str], least: int) -> int:
    """Words of the item that plain greedy string tiling covers."""
    used_t, used_i, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                k = 0
                while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k] and i + k not in used_t and j + k not in used_i:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return covered
        used_t.update(range(i, i + k))
        used_i.update(range(j, j + k))
        covered += k


def coverage(text: str, item: str, **options) -> float:
    found = decontam.Benchmark([(1, item)], **options).coverages(text)
    return found[0][1] if found else 0.0


@pytest.mark.parametrize("words_of", [60, 16, 40])
def test_tiling_against_brute_force(words_of):
    """Passages cut up, repeated and put in another order, their pieces overlapping: no tolerance."""
    for seed in range(140):
        draw = random.Random(seed)
        item = prose(seed, words_of).split()
        if seed % 3 == 0:  # an item that repeats itself
            item = [draw.choice(item[:4]) for _ in item]
        pieces = [item[a : a + draw.randint(3, 30)] for a in (draw.randrange(len(item)) for _ in range(5))]
        text = [w for p in pieces for w in (*p, *prose(draw.randrange(999), draw.randrange(6)).split())]
        want = brute_tiling(text, item, 5) / len(item)
        assert coverage(" ".join(text), " ".join(item)) == pytest.approx(want, abs=1e-12), seed


def test_repetitive_text_takes_no_time():
    began = time.monotonic()
    assert coverage("a " * 20_000, "a " * 200) == 1.0
    assert time.monotonic() - began < 1
    item = prose(5, 70) + " a b" * 5
    began = time.monotonic()
    assert coverage("a b " * 8000, item) == pytest.approx(10 / 80)
    assert time.monotonic() - began < 1


def test_the_least_coverage_only_leaves_out_what_cannot_reach_it():
    items = [(i, prose(i, 30)) for i in range(20)]
    index = decontam.Benchmark(items)
    text = " ".join(" ".join(t.split()[: 10 + i]) for i, t in items)
    every = {r for r in index.coverages(text) if r[1] >= 0.6}
    assert {r for r in index.coverages(text, 0.6) if r[1] >= 0.6} == every and 0 < len(every) < 20


def test_reordered_and_interrupted_passages():
    item = prose(1, 40).split()
    moved = " ".join(item[20:] + prose(2, 50).split() + item[:20])
    assert coverage(moved, " ".join(item)) == 1.0
    assert coverage(" ".join(w.upper() + "," for w in item), " ".join(item)) == 1.0
    assert coverage(" ".join(item[:20]), " ".join(item)) == 0.5
    assert coverage(prose(3, 500), " ".join(item)) == 0.0


def test_repetitive_text_and_short_items():
    assert coverage("a b " * 3000, "a b " * 20) == 1.0
    assert coverage("x one two y", "One two") == 1.0
    assert coverage("anything", "") == 0.0


def test_contaminated(documents, spark):
    item = prose(50, 40)
    half = " ".join(item.split()[:20])
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, prose(51, 30)), (4, item)], SCHEMA)
    rows = [*AWKWARD, (30, prose(5, 50) + " " + item + "\n" + prose(6, 50)), (31, half), (30, item)]
    df = documents(rows)
    for words in (2_000_000, 20):  # one block, and several
        got = decontam.contaminated(df, benchmark, block_words=words).collect()
        assert sorted((r["id"], r["item"], r["coverage"]) for r in got) == [(30, 1, 1.0), (30, 1, 1.0), (30, 4, 1.0), (30, 4, 1.0)]
    clean = decontam.drop_contaminated(df, benchmark)
    assert clean.columns == df.columns and clean.count() == len(rows) - 2
    assert decontam.contaminated(df, benchmark.limit(0)).count() == decontam.contaminated(df.limit(0), benchmark).count() == 0


def test_hashes_depend_on_numbers_alone():
    ids = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    hashes = decontam.rolling(ids, 3).tolist()
    assert hashes[0] == hashes[3] and len(set(hashes)) == 4


@pytest.mark.parametrize("seed", range(12))
def test_tiling_equals_greedy_string_tiling(seed):
    draw = random.Random(seed)
    item = prose(seed, 60).split()
    pieces = [item[a : a + draw.randint(3, 30)] for a in (draw.randrange(50) for _ in range(5))]
    text = [w for p in pieces for w in (*p, *prose(draw.randrange(999), 6).split())]
    assert coverage(" ".join(text), " ".join(item)) == brute_tiling(text, item, 5) / len(item)


def test_pieces_that_share_a_border_word():
    item = [f"w{i}" for i in range(16)]
    assert coverage(" ".join([*item[6:13], "x", *item[:7]]), " ".join(item)) == 13 / 16
    item = [f"w{i}" for i in range(31)]
    pieces = [[*item[a : a + 7], "x"] for a in (24, 18, 12, 6, 0)]
    assert coverage(" ".join(w for p in pieces for w in p), " ".join(item)) == 1.0


def test_clashing_columns_of_the_benchmark_and_ties(spark, documents):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(1, prose(1, 30)), (1, prose(1, 30)), (2, prose(1, 30)), (3, None), (None, prose(2, 30))], SCHEMA)
    items = items.withColumns({c: F.lit("clash") for c in ("item", "block", "id", "row", "coverage", "doc_id")})
    got = decontam.contaminated(documents([(7, prose(1, 30)), (8, prose(2, 30)), (9, None)]), items).collect()
    assert sorted((r["id"], str(r["item"]), r["coverage"], r["tiles"]) for r in got) == [(7, "1", 1.0, 1), (7, "2", 1.0, 1), (8, "None", 1.0, 1)]


def test_blocks_of_the_benchmark(spark, documents):
    items = spark.createDataFrame([(i, prose(i, 30)) for i in range(12)], SCHEMA)
    docs = documents([(i, prose(100 + i, 40) + " " + prose(i, 30)) for i in range(12)])
    got = decontam.contaminated(docs, items, block_words=70).collect()
    assert sorted((r["id"], r["item"]) for r in got) == [(i, i) for i in range(12)]


def test_query_against_brute_force(spark, sf_dir):
    from tidelog.llm import queries

    read = lambda name, key: [(r[key], decontam.words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]
    seeds = lambda w: set(zip(*(w[k:] for k in range(5)), strict=False))
    items = [(i, w, seeds(w)) for i, w in read("benchmark", "item_id")]
    want = {}
    for doc, text in read("documents", "doc_id"):
        here = seeds(text)
        for item, own, its in items:
            if here & its and (share := brute_tiling(text, own, 5) / len(own)) >= 0.8:
                want[doc, item] = share
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in queries.op4_decontamination(spark, sf_dir).collect()}
    assert got == pytest.approx(want) and want
