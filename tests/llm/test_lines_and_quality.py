from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from conftest import SF  # noqa: F401
from pyspark.sql import functions as F

from tidelog.llm import line_dedup, quality

from .conftest import AWKWARD, prose

SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_key(line):
    return line.strip(SPACE).translate(UPPER)


def brute_lines(rows):
    """Rows equal in id and text are one document; null is the least id."""
    held = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 20:
                held[line_key(line)].add((i is not None, i or 0, t))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(line_key(x), ())) >= 3 and (i is not None, i or 0) < max(held[line_key(x)])[:2])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


LONG = "A line that is shared by several documents"
CASES = [
    AWKWARD,
    [(i, f"{LONG}\nown line number {i} of this document\n{LONG.upper()} \x0b") for i in range(1, 6)],
    [(1, LONG), (2, LONG), (3, "x")],
    [(1, f"{LONG}\n{LONG}\n{LONG}"), (2, LONG)],
    [(None, LONG), (1, LONG), (2, LONG), (2, LONG + "\nmore")],
    [(i, "É" + "long enough line with É and é" + "\n" * (i % 3)) for i in range(4)],
]


@pytest.mark.parametrize("rows", CASES)
def test_line_dedup(documents, rows):
    out = line_dedup.dedup_lines(documents(rows))
    got = [(r["doc_id"], r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in out.collect()]
    assert sorted(got, key=str) == brute_lines(rows)


def test_line_dedup_keeps_columns_and_takes_an_empty_table(documents, spark):
    df = documents(AWKWARD)
    cleaned = line_dedup.clean_documents(df)
    assert cleaned.columns == df.columns and cleaned.where("doc_id = 1").first()["text"] is None
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_bitmaps_are_runs(documents):
    rows = [(i, "\n".join([LONG, LONG + " two", f"own line of document number {i}", LONG + " three"])) for i in range(3)]
    runs = {r["doc"]: [tuple(x) for x in r["keep_runs"]] for r in line_dedup.keep_bitmaps(documents(rows)).collect()}
    assert runs == {0: [(0, 1), (3, 3)], 1: [(0, 1), (3, 3)]}


@pytest.mark.parametrize("heavy", [1, 2, 1000])
def test_heavy_keys_lie_in_slices(documents, monkeypatch, heavy):
    """Whatever keys the sketch names, the result is the same."""
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    rows = [(i % 40, f"{LONG}\nown line number {i % 7} of this document\n{LONG} {i % 3}\nshort\n{LONG}") for i in range(60)] + [(None, LONG)]
    got = [(r["doc_id"], r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in line_dedup.dedup_lines(documents(rows)).collect()]
    assert sorted(got, key=str) == brute_lines(rows)


def test_occurrences_are_exchanged_once_by_range(documents):
    """The windows stream over the range partitions: no other exchange, and no sort but the one by document and position."""
    plan = line_dedup.occurrence_index(line_dedup.line_hashes(documents(AWKWARD)))._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("rangepartitioning(h1")]
    assert "Window" in above and "hashpartitioning" not in plan and above.count("Sort ") <= 1


def brute_counts(text):
    words = WORD.findall(text or "")
    seen, covered = defaultdict(list), set()
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(x for i in at for x in range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = ["a " * 30, prose(5, 12) + " " + prose(5, 12) + " x", "one\ntwo\none\n \n \none", "#*$%&|<> \t\x0b\x0c\r x", " lead and trail ", "w " * 7, "w " * 8, "w " * 9, prose(6, 90) + " " + prose(6, 90)]


def test_counts(documents):
    rows = [(i, t) for i, (_, t, *_x) in enumerate(AWKWARD)] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = {r["__id"]: tuple(r[f"__{c}"] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality.judge(documents(rows)).collect()}
    assert got == {i: brute_counts(t) for i, t in rows}


def brute_quality(rows, limit=20, least=0.2):
    """Verdict and remaining text of every row (id, text, host)."""
    docs = {(i, t or "", h) for i, t, h in rows}
    held = defaultdict(set)
    for i, t, h in docs:
        for line in t.split("\n"):
            if WORD.search(line):
                held[h, line_key(line)].add((i, t))
    out = {}
    for i, t, h in docs:
        n, _, _, _, repeated = brute_counts(t)
        gone = lambda x: len(held.get((h, line_key(x)), ())) > limit and i != min((d for d, _ in held[h, line_key(x)] if d is not None), default=None)  # noqa: B023, E731
        kept = [x for x in t.split("\n") if not gone(x)]
        lost = n - sum(len(WORD.findall(x)) for x in kept)
        out[i, t, h] = (n >= 20 and 100 * repeated <= 30 * n and (n - lost) / max(n, 1) >= least, "\n".join(kept))
    return out


def test_boilerplate_goes_by_host_and_the_first_document_stays(documents):
    own = lambda i: prose(100 + i, 40)
    menu = prose(7, 200)
    rows = [(i, f"{menu}\n{own(i)}", "en", "a") for i in range(22)] + [(50 + i, f"{menu}\n{own(50 + i)}", "en", "b") for i in range(20)] + [(90 + i, own(90 + i), "en", "a") for i in range(500)]
    verdicts = {r["__id"]: r["__kept"] for r in quality.judge(documents(rows)).collect()}
    assert verdicts == {i: not 0 < i < 22 for i, *_ in rows}
    # copies are documents of their own: the first of a host that they fill stays
    copies = [(i, f"{menu}\n{prose(8, 200)}", "en", "a") for i in range(40)]
    assert [r["__id"] for r in quality.judge(documents(copies)).collect() if r["__kept"]] == [0]


def test_a_host_with_most_rows(documents):
    """Against brute force: tabs and double blanks between words, lines at and above the limit, a null host, repeated rows."""
    lines = [f"a  shared\tline  number {k}" for k in range(6)]
    rows = [(i, "\n".join([*lines[: 1 + i % 6], prose(200 + i, 1 + i % 25), "x " * (i % 3)]), "en", (None, "a", "hot", "hot", "hot")[i % 5]) for i in range(140)]
    rows += [rows[2], rows[3], (None, rows[4][1], "en", "hot"), (500, None, "en", "hot")]
    want = brute_quality([(i, t, h) for i, t, _, h in rows])
    df = documents(rows)
    verdicts = {(r["__id"], r["__row"]): r["__kept"] for r in quality.judge(df).collect()}
    assert len(verdicts) == len(want) and sum(verdicts.values()) == sum(k for k, _ in want.values()) and 0 < sum(verdicts.values()) < len(want)
    got = [(r["doc_id"], r["source"], r["text"]) for r in quality.keep_documents(df).collect()]
    assert sorted(got, key=str) == sorted(((i, h, want[i, t or "", h][1]) for i, t, _, h in rows if want[i, t or "", h][0]), key=str)


def test_keep_documents(documents):
    df = documents(AWKWARD)
    kept = quality.keep_documents(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [5, 5, 6, 7, 9]
    assert kept.where(F.col("doc_id").isNull()).count() == 1
    assert quality.judge(df.limit(0)).count() == 0


def test_native_plan(documents):
    for df in (line_dedup.dedup_lines(documents(AWKWARD)), quality.judge(documents(AWKWARD))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_hash_of_kept_lines_is_of_utf8(documents):
    out = line_dedup.dedup_lines(documents([(1, "é\nß")])).select(F.sha2("__kept", 256).alias("h")).first()["h"]
    assert out == hashlib.sha256("é\nß".encode()).hexdigest()


def test_lines_above_the_limit_leave_the_texts_that_stay(spark, documents):
    menu = "Home | About us"
    text = lambda i: f"{menu}\n{prose(100 + i, 40)}\n\n  {menu.upper()} \t\nend of {i}"
    rows = [(i, text(i), "en", "a") for i in range(22)] + [(50 + i, text(50 + i), "en", "b") for i in range(5)] + [(3, text(3), "en", "a")]
    want = {i: text(i) if i in (0, *range(50, 55)) else f"{prose(100 + i, 40)}\n\nend of {i}" for i, *_ in rows}
    got = quality.keep_documents(documents(rows))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted([*want.items(), (3, want[3])])
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())

    import corpus_pipeline

    out = corpus_pipeline.quality_rules(spark, documents(rows), "").collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(want[r["doc_id"]]) for r in out)
