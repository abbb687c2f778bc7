from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from conftest import SF

from tidelog.llm import decontam
from tidelog.llm import queries as corpus
from tidelog.llm.common import materialize

from .test_decontam import brute_tiling
from .test_lines_and_quality import brute_lines, brute_quality
from .test_mixing import brute_targets
from .test_near_copies import brute_kept


def brute_contaminated(docs, items) -> set:
    """Documents that plain greedy tiling covers an item of."""
    seeds = lambda w: set(zip(*(w[k:] for k in range(5)), strict=False))
    items = [(decontam.words(t), seeds(decontam.words(t))) for _, t in items]
    out = set()
    for doc, text in docs:
        found = decontam.words(text)
        here = seeds(found)
        if any(here & its and brute_tiling(found, own, 5) >= 0.8 * len(own) - 1e-9 for own, its in items):
            out.add(doc)
    return out


def test_every_stage_against_brute_force(spark):
    """Each stage is judged on its own input; its decisions show in what it returns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = materialize(stage(spark, docs, SF), name)
        after = docs.collect()
        seen[name] = before, after
        assert name == "source_mixing" or docs.columns == columns

    before, after = seen["quality_rules"]
    want = brute_quality([(r["doc_id"], r["text"], r["source"]) for r in before])
    assert {r["doc_id"]: r["text"] for r in after} == {i: text for (i, _, _), (kept, text) in want.items() if kept}

    before, after = seen["line_dedup"]
    want = {i: text for i, _, _, text in brute_lines([(r["doc_id"], r["text"]) for r in before])}
    assert {r["doc_id"]: r["text"] for r in after} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = seen["near_dedup"]
    assert {r["doc_id"] for r in after} == brute_kept([(r["doc_id"], r["text"]) for r in before])

    before, after = seen["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - brute_contaminated([(r["doc_id"], r["text"]) for r in before], items)

    before, after = seen["source_mixing"]
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(r["text"].encode().split())
    for r in after:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 64 for s, t in brute_targets(sizes).items())


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "source_mixing"]
    numbers = sorted(int(n[2:].split("_")[0]) for n in corpus.queries())
    assert numbers == list(range(1, 11))
    assert set(corpus.oracle_sql()) <= set(corpus.queries())


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_agrees_with_sql(name, spark, duck):
    from compare import rows

    got, want = corpus.queries()[name](spark, SF).toPandas(), duck.execute(corpus.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
