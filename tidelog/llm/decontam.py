"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds, runs of MIN_MATCH words.
Each pair that shares seeds enough for the coverage asked for is tiled greedily: the
longest match of free words is found by running Karp-Rabin hashes and marked, again
and again, until none of MIN_MATCH words is left. Lengths are found by bisection,
matches of one length are marked in one pass, and a text's words away from the seeds
are left out, so the work grows with the text even where it repeats itself. The marked
share of the item's words is its coverage. Tiles may stand in any order, so a passage
that was cut up and reordered is found as well.

The benchmark is a stated query set: it goes to the executors in blocks of at most
BLOCK_WORDS words (and one item), one pass over the documents a block, so what is
broadcast is bounded whatever the table's size; a block is released after its pass.
Documents are never shuffled or grouped here.

Defined results
---------------
* words are lower-cased runs of word characters; null text has none.
* an item shorter than MIN_MATCH words is matched as a whole; one without words
  never matches.
* equal item ids are separate items; a pair's row is that of its best coverage.
* ties between tiles: the one first in the document, then first in the item.
* empty tables give an empty result; other columns are ignored, or kept by
  :func:`drop_contaminated`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key

MIN_MATCH = 5
MIN_COVERAGE = 0.8
BLOCK_WORDS = 1_000_000
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Vocabulary(dict):
    """Word to number from 1; any other word is 0."""

    def __missing__(self, _: str) -> int:
        return 0


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n numbers."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    base = np.uint64(_BASE)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * base + ids[i : i + len(out)]
    return out


def _hashes_at(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of the runs of n numbers at some places."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(_BASE) + text[at + i]
    return out


class _Running:
    """Karp-Rabin hashes of all runs of any length of numbers; runs over a number below 1 do not count."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        with np.errstate(over="ignore"):
            powers, self.back = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
            powers[0] = self.back[0] = 1
            powers, self.back = np.cumprod(powers, dtype=np.uint64), np.cumprod(self.back, dtype=np.uint64)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(numbers.astype(np.uint64) * powers[:n], dtype=np.uint64)])
        self.blocked = np.concatenate([[0], np.cumsum(numbers < 1)])

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the runs of n numbers."""
        at = np.flatnonzero(self.blocked[n:] == self.blocked[:-n])
        with np.errstate(over="ignore"):
            return at, (self.sums[at + n] - self.sums[at]) * self.back[at]


def tile(text: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in text, start in item, length) of greedy string tiling; numbers below 1 match nothing."""
    text, item = text.astype(np.int64), item.astype(np.int64)
    tiles: list[tuple[int, int, int]] = []
    longest = min(len(text), len(item))
    while longest >= min_match:
        in_text, in_item = _Running(text), _Running(item)

        def meets(n: int, a: _Running = in_text, b: _Running = in_item) -> bool:
            return bool(np.isin(b.of(n)[1], a.of(n)[1]).any())

        if not meets(min_match):
            break
        low, high = min_match, longest  # the longest match is low at least, high at most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if meets(middle) else (low, middle - 1)
        places = defaultdict(list)
        for j, h in zip(*(x.tolist() for x in in_item.of(low)), strict=True):
            places[h].append(j)
        at, hashes = in_text.of(low)
        met = np.isin(hashes, in_item.of(low)[1])
        free = 0  # where the text is not marked yet
        for i, h in zip(at[met].tolist(), hashes[met].tolist(), strict=True):
            if i < free:
                continue
            waiting = places[h]
            while waiting and item[waiting[0] : waiting[0] + low].min() < 1:
                waiting.pop(0)
            if waiting and np.array_equal(text[i : i + low], item[waiting[0] : waiting[0] + low]):
                j = waiting.pop(0)
                text[i : i + low] = item[j : j + low] = 0
                tiles.append((i, j, low))
                free = i + low
        longest = low - 1
    return tiles


class Benchmark:
    """A block of items with its seed index: by seed length the sorted hashes of the seeds and the items that hold each."""

    def __init__(self, items: list[tuple[object, str | None]], min_match: int = MIN_MATCH):
        self.min_match = min_match
        self.vocabulary = _Vocabulary()
        self.ids, self.items, hashes = [], [], []
        for item, text in items:
            found = words(text)
            if not found:
                continue
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.uint64)
            self.ids.append(item)
            self.items.append(numbers)
            hashes.append(rolling(numbers, min(min_match, len(found))))
        self.seeds, self.item_seeds = {}, [None] * len(self.items)
        of_length = defaultdict(list)
        for k, numbers in enumerate(self.items):
            of_length[min(min_match, len(numbers))].append(k)
        for n, members in sorted(of_length.items()):
            seeds = np.unique(np.concatenate([hashes[k] for k in members]))
            for k in members:
                self.item_seeds[k] = np.searchsorted(seeds, hashes[k])
            pairs = np.unique(np.concatenate([np.stack([self.item_seeds[k], np.full(len(hashes[k]), k)], 1) for k in members]), axis=0)
            self.seeds[n] = seeds, np.searchsorted(pairs[:, 0], np.arange(len(seeds) + 1)), pairs[:, 1].copy()

    def coverages(self, text: str | None, least: float = 0.0) -> list[tuple[object, float, int]]:
        """(item, coverage, tiles) of every item that shares a seed with the text and may have the least coverage."""
        found = words(text)
        numbers = np.fromiter(map(self.vocabulary.__getitem__, found), np.uint64, len(found))
        known = np.concatenate([[0], np.cumsum(numbers == 0)])
        best: dict[object, tuple[float, int]] = {}
        for n, (seeds, bounds, holders) in self.seeds.items():
            if len(found) < n:
                continue
            at = np.flatnonzero(known[n:] == known[:-n])  # runs of known words only
            hashes = _hashes_at(numbers, at, n)
            place = np.minimum(np.searchsorted(seeds, hashes), len(seeds) - 1)
            same = seeds[place] == hashes
            if not same.any():
                continue
            at, place = at[same], place[same]
            here = np.zeros(len(seeds), bool)
            here[place] = True
            for k in np.unique(np.concatenate([holders[bounds[x] : bounds[x + 1]] for x in np.flatnonzero(here)])).tolist():
                own, size = self.item_seeds[k], len(self.items[k])
                if _reach(np.flatnonzero(here[own]), n).sum() < least * size - 1e-9:
                    continue  # words that no shared seed covers are in no tile
                of_item = np.zeros(len(seeds), bool)
                of_item[own] = True
                tiles = tile(_around(numbers, at[of_item[place]], n), self.items[k], n)
                coverage = sum(x for _, _, x in tiles) / size
                best[self.ids[k]] = max(best.get(self.ids[k], (0.0, 0)), (coverage, len(tiles)))
        return [(item, *v) for item, v in best.items()]


def _reach(starts: np.ndarray, n: int) -> np.ndarray:
    """How many places each run of n from the ascending starts adds to those before it."""
    return np.minimum(n, np.diff(starts, prepend=-n))


def _around(numbers: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The numbers that runs of n from the starts cover, a zero between parts that do not touch."""
    added = _reach(starts, n)
    gap = np.diff(starts, prepend=starts[0]) > n
    at = np.repeat(starts + n - added, added) + np.arange(added.sum()) - np.repeat(np.cumsum(added) - added, added)
    return np.insert(numbers[at], np.repeat(np.cumsum(added) - added, gap), 0)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, row, item, coverage, tiles) of every document and item with coverage enough."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), row_key(text).alias("row"), text.alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    kinds = dict(rows.dtypes)["id"], dict(items.dtypes)["item"]
    schema = f"id {kinds[0]}, row bigint, item {kinds[1]}, coverage double, tiles int"
    size = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit("\\w+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_words))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    item_type = items.select("item").limit(0).toArrow().schema.field(0).type

    def scan(block: int) -> DataFrame:
        held = [(r["item"], r["text"]) for r in dealt.where(F.col("block") == block).select("item", "text").toLocalIterator()]
        shared = spark.sparkContext.broadcast(Benchmark(held, min_match))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                out = []
                for i, value in enumerate(batch.column(2)):
                    for item, coverage, tiles in index.coverages(value.as_py(), min_coverage):
                        if coverage >= min_coverage - 1e-9:
                            out.append((i, item, coverage, tiles))
                at = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([o[1] for o in out], item_type), pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.int32())], ["id", "row", "item", "coverage", "tiles"])

        pairs = materialize(rows.mapInArrow(run, schema), "contaminated-pairs")
        shared.destroy()
        return pairs

    out = scan(0)
    for block in range(1, blocks):
        out = out.union(scan(block))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that cover no item; same columns."""
    caught = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("id").alias("__id"), F.col("row").alias("__row")).distinct()
    caught = materialize(caught, "contaminated")
    keyed = docs.withColumn("__key", row_key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return keyed.join(caught, keyed[id_col].eqNullSafe(caught["__id"]) & (keyed["__key"] == caught["__row"]), "left_anti").select(*docs.columns)
