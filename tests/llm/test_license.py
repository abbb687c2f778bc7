from __future__ import annotations

import re

import pytest

from tidelog.llm import license

from .conftest import AWKWARD, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(text, threshold=license.THRESHOLD):
    words = tokens(text)
    places = [(i, label) for phrase, label in license.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    best, labels = threshold if places else 0.0, {label for _, label in places}
    for label, template in license.TEMPLATES:
        wanted, width = set(tokens(template)), license.width_of(template)
        for at in range(0, len(words), width):
            share = len(wanted & set(words[at : at + 2 * width])) / len(wanted)
            if share >= threshold - 1e-9:
                best, labels = max(best, share), labels | {label}
    return len(words), sorted(places), ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), round(best, 9)


TEXTS = [
    "Released under the MIT License.",
    "the mit\nLICENSE; and Apache-License; general  public license; GENERAL PUBLIC LICENSES",
    prose(1, 30) + "\nLicensed under the Apache License, Version 2.0\n" + prose(2, 30),
    "Licensed under CC BY-NC 4.0.",
    "license version apache under 2 licensed the",
    "Licensed under CC",
    "This work is licensed under the GNU General Public License, version 3. " * 3,
    "MİT license, mit licenseé, mit_license mit license",
    "license " * 50 + "mit license",
    prose(3, 300) + "\n * " + license.TEMPLATES[2][1].replace("\n", "\n * ") + prose(4, 300),
    "\n".join(license.TEMPLATES[k][1][:-90] for k in (4, 7, 10, 11)),
]


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_scan(documents, threshold):
    rows = [(i, t) for i, (_, t, *_x) in enumerate(AWKWARD)] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = {r["id"]: (r["n_words"], sorted((p["start"], p["label"]) for p in r["places"]), r["base_labels"], r["labels"], round(r["score"], 9)) for r in license.scan(documents(rows), threshold=threshold).collect()}
    assert got == {i: brute(t, threshold) for i, t in rows}


def test_repeated_rows_and_an_empty_table(documents):
    df = documents([(1, TEXTS[0]), (1, TEXTS[0]), (None, TEXTS[3])])
    assert sorted(str(r["labels"]) for r in license.scan(df).collect()) == ["cc-by-nc", "mit", "mit"]
    assert license.scan(df.limit(0)).count() == 0


def test_a_very_long_text(documents):
    """Notices at both ends and in the middle of a long text full of template words."""
    common = " ".join(["the software is provided as this and of"] * 4000)
    rows = [(1, f"{license.TEMPLATES[2][1]} {common} {license.TEMPLATES[8][1]} {common} {license.TEMPLATES[11][1]}"), (2, common)]
    got = {r["id"]: (r["n_words"], r["labels"], r["score"]) for r in license.scan(documents(rows)).collect()}
    want = {i: (n, labels, score) for i, (n, _, _, labels, score) in ((i, brute(t)) for i, t in rows)}
    assert got == want and want[1][1] == "cc-by-nc,isc,mit" and want[2][1] == ""


def test_too_large_a_vocabulary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(license, "MAX_VOCABULARY", 10)
    with pytest.raises(ValueError, match="template words"):
        license.template_words(spark, license.TEMPLATES, 0.8)


def test_native_plan(documents):
    plan = license.scan(documents([(1, TEXTS[0])]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_notices_wrapped_over_lines(documents):
    rows, want = [], {}
    for n, (label, notice) in enumerate(license.TEMPLATES):
        parts = notice.split()
        for cut in (len(parts) // 3, len(parts) // 2):
            i = len(rows)
            rows.append((i, prose(i, 30) + "\n# " + " ".join(parts[:cut]) + "\n# " + " ".join(parts[cut:]) + "\n" + prose(i + 50, 30)))
            want[i] = label
    got = {r["id"]: (r["labels"].split(","), r["score"]) for r in license.scan(documents(rows)).collect()}
    assert all(want[i] in got[i][0] and got[i][1] == 1.0 for i in want)
