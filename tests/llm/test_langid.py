from __future__ import annotations

import random
from zlib import crc32

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidelog.llm import langid

from .conftest import AWKWARD

SOUNDS = {"xx": "the and of ing ther tion ed", "yy": "der und sch ein ich ung ß", "zz": "el la que ción ñ os ar"}


def sample(lang: str, seed: int, n: int = 30) -> str:
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choice(SOUNDS[lang].split()) for _ in range(draw.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    return langid.train([(sample(lang, i), lang) for lang in SOUNDS for i in range(60)])


def test_learns_and_rejects(model):
    for lang in SOUNDS:
        told = [model.predict(sample(lang, 1000 + i, 4)) for i in range(50)]
        assert sum(t[0] == lang for t in told) >= 48
    assert model.predict(None) == model.predict("") == model.predict("12 3,4 ¿?") == ("und", 0.0)
    assert 0 <= model.threshold <= 1


def test_whole_texts_count(model):
    late = sample("xx", 1, 20) + " " + sample("yy", 2, 4000)
    assert model.predict(late)[0] == "yy"


def test_chunks_do_not_change_the_subwords(monkeypatch):
    text = sample("zz", 5, 300)
    whole = np.sort(np.concatenate(list(langid.buckets(text))))
    monkeypatch.setattr(langid, "_CHUNK", 50)
    assert np.array_equal(whole, np.sort(np.concatenate(list(langid.buckets(text)))))


def test_training_does_not_depend_on_order():
    examples = [(sample(lang, i), lang) for lang in SOUNDS for i in range(10)]
    one, two = langid.train(examples), langid.train(examples[::-1])
    assert np.array_equal(one.table, two.table)
    assert langid.train([]).predict("abc") == ("und", 0.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    out = langid.identify(docs, model).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").withColumn("held_out", langid.held_out(F.col("id"))).collect()
    assert all(r["held_out"] == (crc32(str(r["id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert sum(r["accepted"] for r in held) >= 0.9 * len(held)


def test_language_source_and_id_are_no_inputs(documents):
    model = langid.train([(sample(lang, i), lang) for lang in SOUNDS for i in range(10)])
    text = sample("yy", 77)
    told = langid.identify(documents([(1, text, "xx", "a"), (2, text, None, None), (None, text)]), model).collect()
    assert len({(r["lang_pred"], r["score"]) for r in told}) == 1


def test_awkward_rows_and_bounds(documents, spark):
    df = documents(AWKWARD)
    out = langid.identify(df, langid.fit(df))
    assert out.count() == len(AWKWARD) and out.where("lang_pred = 'und'").count() == 3
    assert langid.identify(df.limit(0), langid.fit(df.limit(0))).count() == 0
    assert set(langid.identify(df, langid.fit(df.limit(0))).toPandas().lang_pred) == {"und"}
    many = documents([(i, sample("xx", i), "xx") for i in range(200)])
    picked = langid.training_sample(many, id_col="doc_id", text_col="text", lang_col="lang", rows=20, chars=30)
    assert 10 <= len(picked) <= 20 and max(len(t) for t, _ in picked) <= 30


def brute_predict(model, text):
    """Features, softmax and language once more, a subword at a time."""
    if not model.languages or not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    stream = [0]
    for i, c in enumerate(text):
        if c.isalpha() or ord(c) > 0xFFFF:
            stream.append(ord(c.lower()[0]) if ord(c) <= 0xFFFF else ord(c))
        elif i and (text[i - 1].isalpha() or ord(text[i - 1]) > 0xFFFF):
            stream.append(0)
    stream.append(0)
    total, n = np.zeros(len(model.languages)), 0
    for width in (1, 2, 3, 4):
        for i in range(len(stream) - width + 1):
            gram = stream[i : i + width]
            if any(x == 0 for x in gram[1:-1]):
                continue
            h = 0
            for k, x in enumerate(gram):
                h = (h * 0x01000193 + x + k + 1) % 2**32
            total += model.table[(h * 0x9E3779B1 % 2**32) >> 16]
            n += 1
    scores = (total / n + model.bias) / model.temperature
    shares = [float(np.exp(x - max(scores))) for x in scores]
    best = int(np.argmax(scores))
    return model.languages[best], shares[best] / sum(shares)


def test_query_against_a_plain_computation(spark):
    from tidelog.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in queries.op8_language_id(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        lang, score = brute_predict(model, text)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-6), i


def test_long_text_against_a_plain_computation(model, monkeypatch):
    monkeypatch.setattr(langid, "_CHUNK", 1000)
    text = sample("xx", 1, 800) + " 12 \U0001d518 " + sample("zz", 2, 300)
    lang, score = model.predict(text)
    want, share = brute_predict(model, text)
    assert lang == want and score == pytest.approx(share, abs=1e-6)
