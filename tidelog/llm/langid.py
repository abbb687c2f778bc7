"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are runs of 1 to 4 letters with word boundaries, lower-cased, hashed into
buckets. A text is the mean of its subwords' embeddings, the softmax is linear on it;
both are trained by stochastic gradient descent in numpy. Because mean and layer
are linear, a bucket's embedding times the layer is tabulated once, and a text of
any length is scored whole by summing table rows.

The training sample is bounded: at most ROWS_PER_LANG labelled rows a language,
chosen by a hash and MAX_ROWS over all languages, and at most TRAIN_CHARS characters
of each, cut at a hashed place.
A fifth of the sample is kept from training to calibrate: a temperature for the
scores, and the least score at which predictions are right often enough; those
below are not `accepted`.

Defined results
---------------
* null text or text without a letter: ``und``, score 0, not accepted.
* no labelled rows (or an empty table): every text is ``und``.
* ties between languages: the first in code point order.
* other columns are ignored; the language column is read for training rows only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
ROWS_PER_LANG = 500
MAX_ROWS = 20_000
TRAIN_CHARS = 2_000
BUCKETS = 1 << 16
DIMENSIONS = 8
EPOCHS = 6
RATE = 0.5
SHORT_CHARS = (15, 120)
PRECISION = 0.98
_CHUNK = 1 << 20
_MIX = np.uint32(0x9E3779B1)
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Code point (basic plane) to its lower-case letter, 0 for any other character."""
    global _letters
    if _letters is None:
        table = np.zeros(1 << 16, np.uint32)
        for c in range(1 << 16):
            if chr(c).isalpha():
                table[c] = ord(chr(c).lower()[0])
        _letters = table
    return _letters


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all subwords, in chunks."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.where(codes < 1 << 16, _letter_table()[np.minimum(codes, 0xFFFF)], codes)
    kept = letters != 0
    kept[1:] |= kept[:-1].copy()  # of a run of other characters the first stays, as the boundary
    stream = np.concatenate([[0], letters[kept], [0]]).astype(np.uint32)
    for at in range(0, len(stream), _CHUNK):
        part = stream[at : at + _CHUNK + 3]
        run = np.zeros(len(part), np.uint32)
        for n in range(1, 5):
            size = min(_CHUNK, len(stream) - at) if n == 1 else max(0, min(_CHUNK, len(part) - n + 1))
            run = run[:size] * np.uint32(0x01000193) + part[n - 1 : n - 1 + size] + np.uint32(n)
            inner = part[1 : 1 + size] != 0 if n > 2 else np.ones(size, bool)
            if n > 3:
                inner = inner & (part[2 : 2 + size] != 0)
            yield (run[inner] * _MIX) >> np.uint32(16)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for b in buckets(text):
            counts = np.bincount(b, minlength=0) if len(b) > BUCKETS else None
            total += counts @ self.table[: len(counts)] if counts is not None else self.table[b].sum(0, dtype=np.float64)
            n += len(b)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        scores = _softmax(self.logits(text) / self.temperature)
        best = int(scores.argmax())
        return self.languages[best], float(scores[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(examples: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (text, language); the order of examples does not matter."""
    examples = sorted((t, lang) for t, lang in examples if has_letter(t))
    languages = sorted({lang for _, lang in examples})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(examples))
    held = set(order[: len(order) // 5].tolist()) if len(order) >= 20 else set()
    fit, check = [], []
    for i, (text, lang) in enumerate(examples):
        length = int(draw.integers(*SHORT_CHARS))
        at = int(draw.integers(0, max(1, len(text) - length)))
        for t in (text, text[at : at + length]):
            b, c = np.unique(np.concatenate(list(buckets(t))), return_counts=True)
            if len(b):
                (check if i in held else fit).append((b, (c / c.sum()).astype(np.float32), languages.index(lang)))
    embeddings = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, step = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(len(fit)):
            b, share, y = fit[i]
            hidden = share @ embeddings[b]
            error = _softmax(hidden @ layer + bias)
            error[y] -= 1
            rate = RATE * (1 - step / steps)
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            bias -= rate * 0.1 * error
            embeddings[b] -= (rate * 20 * share)[:, None] * back[None, :]
            step += 1
    model = Model(languages, (embeddings @ layer).astype(np.float32), bias.astype(np.float64))
    return _calibrated(model, check or fit)


def _calibrated(model: Model, examples: list) -> Model:
    logits = np.array([share @ model.table[b] + model.bias for b, share, _ in examples])
    labels = np.array([y for *_, y in examples])

    def loss(temperature: float) -> float:
        z = logits / temperature
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), labels]).mean())

    model.temperature = min((0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 5.0), key=loss)
    z = logits / model.temperature
    scores = np.exp(z - z.max(1, keepdims=True))
    scores = scores.max(1) / scores.sum(1)
    right = logits.argmax(1) == labels
    ranked = np.argsort(-scores, kind="stable")
    precision = np.cumsum(right[ranked]) / np.arange(1, len(ranked) + 1)
    enough = np.flatnonzero(precision >= PRECISION)
    model.threshold = float(scores[ranked[enough[-1]]]) if len(enough) else 1.0
    return model


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, rows: int = ROWS_PER_LANG, chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """At most `rows` (text, lang) a language, at most `chars` characters of each."""
    labelled = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col)).count().collect()}
    if not counts:
        return []
    rows = max(1, min(rows, MAX_ROWS // len(counts)))
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col(lang_col) == lang, F.lit(min(1.0, 1.5 * rows / n))).otherwise(rate)
    start = F.floor(F.pmod(F.xxhash64(F.lit("cut"), F.col(text_col)), F.greatest(F.length(text_col) - chars, F.lit(1)))).cast("int")
    cut = F.substr(F.col(text_col), start + 1, F.lit(chars))
    picked = labelled.where(place < rate).select(F.col(lang_col).alias("lang"), place.alias("place"), cut.alias("text")).collect()
    out: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r["place"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return [(t, lang) for lang, texts in sorted(out.items()) for t in texts[:rows]]


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> Model:
    return train(training_sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            scores = [s for _, s in told]
            accepted = [lang != UNKNOWN and s >= shared.value.threshold for lang, s in told]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lang for lang, _ in told], pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], ["id", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double, accepted boolean")
