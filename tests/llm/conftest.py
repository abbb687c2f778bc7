from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use inside.
CLASHING = ("id", "row", "key", "pos", "fp", "text_key", "rank", "size", "h1", "body", "words", "component", "block")


def prose(seed: int, words: int, lines: int = 1) -> str:
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    return "\n".join(" ".join(draw.choice(vocabulary) for _ in range(words // lines)) for _ in range(lines))


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, lang, source]) as a documents table with columns of clashing names."""
    from pyspark.sql import functions as F

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src", 0) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        return df.withColumns({c: F.lit("clash") for c in CLASHING})

    return make


#: Rows that every operator has to take: null and empty texts, null columns, ties, repeated rows, a very long text.
AWKWARD = [(1, None), (2, ""), (3, "\n\n"), (4, "word"), (5, prose(1, 60, 3)), (5, prose(1, 60, 3)), (6, prose(1, 60, 3)), (None, prose(2, 40)), (7, prose(3, 30_000, 40), None, None), (8, "é ß İ 𝔘 \x00 \x85 x", "fr", None), (9, prose(4, 40) + "\n" + prose(1, 60, 3))]
