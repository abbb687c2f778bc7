from __future__ import annotations

import random

import pytest
from conftest import SF

from tidelog.llm import near_copies

from .test_simhash import brute_groups, brute_print


def brute_sets(text: str | None, width: int = near_copies.SHINGLE) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_kept(rows: list[tuple[int, str | None]]) -> set[int]:
    """All texts linked by fingerprints two bits apart and by whole sets at the similarity; the least id of each group."""
    rows = sorted(rows, key=lambda r: r[0])
    prints = [brute_print(t, near_copies.SHINGLE) for _, t in rows]
    sets, root = [brute_sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 or a and len(a & sets[j]) >= near_copies.SIMILARITY * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {rows[i][0] for i in range(len(rows)) if root[i] == i}


def edited(words: list[str], changes: int, rng: random.Random) -> str:
    out = list(words)
    for at in rng.sample(range(len(out)), changes):
        out[at] = f"new{rng.random()}"
    return " ".join(out)


def test_planted_copies_against_brute_force(spark):
    rng = random.Random(1)
    rows, n = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        for changes in (0, 0, 1, 2, 3, 5, 9, 20):
            rows.append((n, edited(words, changes, rng)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "one two three"), (n + 4, "ONE two  three"), (n + 5, "word " * 3000)]
    out = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in out.collect()} == brute_kept(rows)


@pytest.mark.parametrize("members", [4, 1024])
def test_a_hot_key_of_unlike_texts(spark, monkeypatch, members):
    """Texts that share half of themselves meet in many keys; small blocks deal those keys to many pairs of blocks."""
    monkeypatch.setattr(near_copies, "BLOCK_MEMBERS", members)
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(120)]
    own = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(30)]
    rows = [(i, " ".join([*shared, *words])) for i, words in enumerate(own)]
    rows += [(100 + i, edited([*shared, *words], 3, rng)) for i, words in enumerate(own) if i % 3 == 0]
    out = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    want = brute_kept(rows)
    assert {r["doc_id"] for r in out.collect()} == want and len(want) == 30


def test_very_long_texts(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(50_000)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, edited(words, 900, rng)), (3, " ".join(words[:30_000])), (4, " ".join(reversed(words)))]
    out = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in out.collect()} == {1, 3, 4}


def test_pairs_of_groups_over_batches():
    """Groups that lie across batches; of two blocks only pairs across them."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    rows = []
    for group in range(40):
        for k in range(int(rng.integers(1, 9))):
            rows.append((group, (group, k), int(rng.integers(8, 12)), int(rng.integers(0, 3)), int(rng.integers(0, 1 + group % 2 * 2)), bytes(rng.choice([1, 2], 120, p=[0.9, 0.1]).astype(np.uint8))))
    want = {(x[1], y[1]) for i, x in enumerate(rows) for y in rows[i + 1 :] if x[0] == y[0] and x[3] != y[3] and min(x[2], y[2]) >= 0.8 * max(x[2], y[2]) - 1e-9 and (len({r[4] for r in rows if r[0] == x[0]}) == 1 or x[4] != y[4]) and sum(a == b for a, b in zip(x[5], y[5], strict=True)) >= near_copies.least_agreement(0.8)}
    node = pa.struct([("id", pa.int64()), ("row", pa.int64())])
    kinds = dict(group=pa.int64(), node=node, n=pa.int64(), root=pa.int64(), block=pa.int64(), sketch=pa.binary())
    for size in (1, 3, 500):
        batches = [pa.RecordBatch.from_pylist([dict(zip(kinds, (r[0], {"id": r[1][0], "row": r[1][1]}, *r[2:]), strict=True)) for r in rows[i : i + size]], pa.schema(list(kinds.items()))) for i in range(0, len(rows), size)]
        got = []
        for table in near_copies._whole_groups(iter(batches)):
            names = [(x["id"], x["row"]) for x in table.column("node").to_pylist()]
            got += [(names[a], names[b]) for i, j in near_copies._likely(table, 0.8) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
        flagged = [(x["node"]["id"], x["node"]["row"]) for b in near_copies._with_partners(iter(batches), 0.8) for x in b.to_pylist()]
        assert len(flagged) == len(set(flagged)) and set(flagged) == {x for pair in want for x in pair}


def test_a_large_family_keeps_one(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, edited(words, 2, rng)) for i in range(150)] + [(900, " ".join(f"x{i}" for i in range(200)))]
    kept = [r["doc_id"] for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == [0, 900]


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near = text.replace("w50", "other")
    rows = [(None, text, 1, "k"), (1, near, 2, None), (1, near, 2, None), (2, "alone here", 3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, root string")
    out = near_copies.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["node"]) for r in out.collect()) == [("2", 3), ("None", 1)]
    assert near_copies.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_bands_find_pairs_at_the_threshold(similarity):
    rng, missed = random.Random(3), 0
    for _ in range(200):
        shared = [rng.getrandbits(64) for _ in range(int(200 * similarity))]
        own = (200 - len(shared)) // 2
        a, b = ([*shared, *(rng.getrandbits(64) for _ in range(own))] for _ in range(2))
        keys = [near_copies.band_keys(near_copies.np.array(x, "u8"))[0] for x in (a, b)]
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_test_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"] for r in near_copies.keep_one(docs).collect()}
    assert got == brute_kept([tuple(r) for r in docs.collect()])


def fingerprints_first(rows: list[tuple[int, str | None]]) -> set[int]:
    """What would stay if fingerprint groups lost all but one text before the others are compared."""
    rows = sorted(rows, key=lambda r: r[0])
    first = [rows[x] for x in sorted(set(brute_groups([brute_print(t, near_copies.SHINGLE) for _, t in rows])))]
    sets, root = [brute_sets(t) for _, t in first], list(range(len(first)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) >= near_copies.SIMILARITY * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {first[i][0] for i in range(len(first)) if root[i] == i}


def test_links_run_through_texts_that_fingerprints_would_drop(spark):
    rows, cut = [], 0
    for seed in range(12):
        rng = random.Random(seed)
        words = [f"w{seed}x{i}" for i in range(2000)]
        family = [" ".join(words)]
        spots = rng.sample(range(0, 2000, 8), 54)
        for changes in (*[1] * 12, 42):
            for at in [spots.pop() for _ in range(changes)]:
                words[at] = f"new{rng.random()}"
            family.append(" ".join(words))
        family = [(100 * seed + i, t) for i, t in enumerate(family)]
        cut += len(fingerprints_first(family)) - len(brute_kept(family))
        rows += family
    rows += [(2001, rows[0][1]), (2000, None), (2002, "")]
    got = {r["doc_id"] for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert cut > 0 and got == brute_kept(rows)
