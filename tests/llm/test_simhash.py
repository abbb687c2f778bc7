from __future__ import annotations

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import simhash
from tidelog.llm.components import components

from .conftest import AWKWARD, prose


def brute_print(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints: list[int]) -> list[int]:
    """Least index reachable over pairs at most two bits apart."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return [find(x) for x in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_equal_spark_hashes(spark):
    assert signed(xxhash.xxh64_intdigest(b"a b \xc3\xa9", 42)) == spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0]
    for text in ("", "One", "One TWO", prose(1, 200), "é É ß x y z w"):
        assert simhash.fingerprint(text.encode()) == signed(brute_print(text))


@pytest.mark.parametrize("limit", [64, 2])
def test_links_connect_what_pairs_connect(spark, limit):
    """Chains, dense clusters and strangers."""
    draw = random.Random(limit)
    prints = [draw.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        x = draw.choice(prints)
        for _ in range(draw.choice((1, 2, 2, 3))):
            x ^= 1 << draw.randrange(64)
        prints.append(x)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    edges = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
    alike = {(a, b) for a, b in itertools.combinations(sorted(map(signed, prints)), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert set(edges) == alike and len(edges) == len(alike)
    index = {signed(p): i for i, p in enumerate(prints)}
    roots = {index[r["node"]]: index[r["root"]] for r in components(simhash.links(df)).collect()}
    want = brute_groups(prints)
    groups = lambda f: sorted(sorted(g) for g in {k: [i for i in range(len(prints)) if f(i) == k] for k in map(f, range(len(prints)))}.values())
    assert groups(lambda i: roots.get(i, i)) == groups(lambda i: want[i])


def test_a_pair_meets_by_the_bytes_that_it_shares():
    """In 1, 7 or 28 postings as it shares 6, 7 or 8 positional bytes, in none as it shares fewer."""
    for differing, want in ((0x00, 28), (0x01, 7), (0x8000000000000000, 7), (0x0101, 1), (0x80000001, 1), (0x010101, 0)):
        assert sum(differing & mask == 0 for mask in simhash.LAYOUTS) == want


def test_a_dense_posting(spark):
    """All values of twelve bits in two bytes: every pair of a posting is looked at, only near ones leave."""
    df = spark.range(1 << 12).select((F.col("id") + (1 << 40)).alias("fp"))
    edges = simhash.links(df)
    assert edges.count() == (1 << 12) * (12 + 66) // 2
    assert components(edges).select("root").distinct().count() == 1


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(200)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups(documents):
    near = prose(9, 400)
    rows = [*AWKWARD, (20, near), (21, near + " one"), (22, near.upper())]
    out = {(r["id"], r["row"]): r for r in simhash.group(documents(rows)).collect()}
    by_id = {k[0]: v["component"] for k, v in out.items()}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and out is not None
    assert by_id[5] == by_id[6] == 5 and by_id[20] == by_id[22] == 20
    assert by_id[None] is None
    prints = [brute_print(t) for _, t, *_x in rows]
    assert {(k[0], v["fp"]) for k, v in out.items()} == {(r[0], signed(p)) for r, p in zip(rows, prints, strict=True)}


def test_keep_one(documents):
    df = documents(AWKWARD)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1, 4, 5, None, 7, 8} <= set(ids) and not {2, 3, 6} & set(ids)
    assert simhash.group(df.limit(0)).count() == 0
