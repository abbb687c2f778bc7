from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidelog.llm import mixing

from .conftest import AWKWARD, prose


def brute_targets(sizes: dict, share=1.5, cap=2.0, weights=(5, 2, 1)) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total = share * sum(sizes.values())
    target = {s: total * weight[s] / sum(weight.values()) for s in order}
    free = set(order)
    while over := [s for s in free if target[s] > cap * sizes[s] + 1e-9]:
        excess = sum(target[s] - cap * sizes[s] for s in over)
        for s in over:
            target[s] = cap * sizes[s]
        free -= set(over)
        for s in free:
            target[s] += excess * weight[s] / sum(weight[x] for x in free)
    return target


ROWS = [(i, prose(i, 20 + 37 * i % 400), "en", ("b", "a", None, "é", "Z")[i * i % 5]) for i in range(60)] + [(100, None, "en", "empty"), (101, "x", "en", "tiny")]


@pytest.mark.parametrize("rows", [ROWS, AWKWARD, [(1, "one two", "en", "s")], [(1, None, "en", "s")]])
def test_mix(documents, rows):
    out = [r.asDict() for r in mixing.mix(documents(rows), block=8).collect()]
    assert sorted(str(r["id"]) for r in out) == sorted(str(r[0]) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3] if len(r) > 3 else "src"] += len((r[1] or "").encode().split())
    targets, taken = brute_targets(sizes), Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 8 + 1e-9


def test_reruns_agree_whatever_the_partitions(documents):
    df = documents(ROWS)
    one, two = (sorted((r["id"], r["taken"]) for r in mixing.mix(d).collect()) for d in (df, df.repartition(7)))
    assert one == two


def test_an_empty_table(documents):
    assert mixing.mix(documents(ROWS).limit(0)).count() == 0


def test_a_permutation_uses_every_block_once(spark):
    for n in (1, 2, 64, 97, 998_244_353 // 1_000_003):
        k = mixing._permuted(F.col("id"), F.lit(1), F.lit(n).cast("long"), F.lit(3), "seed")
        assert spark.range(n).select(k.alias("k")).distinct().count() == n


def test_shards_get_multinomial_counts(spark):
    quota = spark.createDataFrame([(0, 300, 100), (1, 100, 100)], "rank int, slots bigint, blocks bigint")
    drawn = mixing.multinomial_counts(quota, 400, 10, 40, "seed").collect()
    by_shard = defaultdict(Counter)
    for r in drawn:
        by_shard[r["shard"]][r["rank"]] += r["drawn"]
    assert set(by_shard) == set(range(10)) and all(sum(c.values()) == 40 for c in by_shard.values())
    assert len({c[0] for c in by_shard.values()}) > 3 and 260 < sum(c[0] for c in by_shard.values()) < 340
    slots = mixing.slot_table(quota, shard_slots=40)
    assert slots.groupBy("rank", "block").count().where("rank = 0 AND count <> 3 OR rank = 1 AND count <> 1").count() == 0


def test_the_draw_decides_what_is_taken(documents):
    """Within the bounds a source takes what its shards drew, so other shards take other words."""
    quota = documents(ROWS).sparkSession.createDataFrame([(0, 100, 400, 200), (1, 100, 100, 100)], "rank int, slots bigint, most bigint, blocks bigint")
    drawn = mixing.multinomial_counts(quota, 200, 10, 20, "seed").groupBy("rank").sum("drawn").collect()
    taken = dict(mixing.slot_table(quota, seed="seed", shard_slots=20).groupBy("rank").count().collect())
    assert taken[0] == max(100, dict(drawn)[0]) and taken[1] == 100
    totals = set()
    for shard_slots in (3, 5, 7, 11, 13, 4096):
        out = Counter()
        for r in mixing.mix(documents(ROWS), block=8, shard_slots=shard_slots).collect():
            out[r["source"]] += r["taken"]
        totals.add(tuple(sorted(out.items(), key=str)))
    assert len(totals) > 1


def test_the_mix_itself(documents):
    """Slots of every shard with the words of their blocks; they add up to what mix() reports."""
    rows = [(i, t, "en", s) for i, t, _, s in (r if len(r) > 3 else (*r, "en", "src")[:4] for r in ROWS)]
    mixed = mixing.mixed_blocks(documents(rows), block=8, shard_slots=16).collect()
    words, reported = Counter(), Counter()
    for r in mixed:
        assert 0 < len(r["words"]) <= 8
        words[r["source"]] += len(r["words"])
    told = mixing.mix(documents(rows), block=8, shard_slots=16).collect()
    for r in told:
        reported[r["source"]] += r["taken"]
    assert words == +reported
    assert len({(r["source"], r["slot"]) for r in mixed}) == len(mixed)
    known = {s: Counter(w for _, t, _, x in rows if x == s for w in (t or "").split()) for s in {r[3] for r in rows}}
    for r in mixed:
        assert all(known[r["source"]][w] for w in r["words"])
    # an epoch of a source holds each of its words as often as its documents do
    first = [r for r in mixed if r["source"] == "Z" and r["epoch"] == 0]
    whole = Counter(w for r in first for w in r["words"])
    assert whole <= known["Z"]


def test_tasks_share_the_slots_of_a_source(documents, monkeypatch):
    monkeypatch.setattr(mixing, "_TASK_ROWS", 50)
    quota = documents(ROWS).sparkSession.createDataFrame([(0, 600, 600)], "rank int, slots bigint, blocks bigint")
    slots = mixing.slot_table(quota, shard_slots=16)
    assert slots.select(F.spark_partition_id()).distinct().count() > 4


def test_native_plan(documents):
    plan = mixing.mix(documents(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
