"""Suffix-array dedup: remove every byte covered by a string of LENGTH bytes that also starts elsewhere.

Suffixes of 100 TB cannot be sorted in one place, and shipping each with its next
LENGTH bytes would multiply the text. The work is dealt by content, so that strings
that agree on their first WINDOW bytes always meet:

1. Every string of WINDOW bytes is keyed by the least hash of the gram-sized strings
   inside it. Consecutive starts of one key form a run, so a run costs a row every
   hundred bytes or so. Keys that occur once cannot hold a repeat; only runs of other
   keys go on.
2. Equal fragments (a run's starts and LENGTH - 1 bytes more) of a key are merged to
   one with a count. Only one text of each distinct fragment is read again.
3. The distinct fragments of a key are suffix-sorted together by :mod:`.suffix`, a
   fragment that has copies counting as often, and the common prefixes of neighbours
   tell for every start how long a string from there occurs elsewhere.
4. A key whose distinct fragments do not fit a block is dealt once more in the same
   way, its fragments being the texts, by the next of GRAMS. The last gram is the
   whole string, where a key has one string only, so the dealing ends; equal strings
   meet at every level.
5. The marked starts of a fragment go back to all its copies.

The texts are dealt once by their node into a table of the shared folder, and every
join with them reads it as it lies.

No group, however large, is gathered in one task. The common prefixes also give what
repeats at shorter lengths, WINDOW bytes or more; :func:`dedup` reports it as n_shared.

Defined results
---------------
* null or empty text: nothing to remove.
* rows equal in id and text are separate texts, so each covers the other.
* strings never cross documents; overlapping strings count.
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, materialize_dealt, release, row_key
from .suffix import Block

LENGTH = 400
#: Strings that agree on so many bytes meet; fifty words of any language have as many.
WINDOW = 240
GRAMS = (64, 200, WINDOW)
RUN_STARTS = 1024
BLOCK_BYTES = 1 << 19
_SCAN_BYTES = 1 << 17
#: Fixed values of the rolling hash: an odd base with its inverse modulo 2**64, and mixing multipliers.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPANS = "array<struct<from:bigint,to:bigint,full:boolean>>"
_SPANS_PA = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("full", pa.bool_())]))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        with np.errstate(over="ignore"):
            known = np.full(n + 1, base, np.uint64)
            known[0] = 1
            known = np.cumprod(known, dtype=np.uint64)
        _powers[base] = known
    return known[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= _MIX1
        h ^= h >> np.uint64(27)
        h *= _MIX2
        h ^= h >> np.uint64(31)
    return h


def _sums(data: np.ndarray) -> np.ndarray:
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    return sums


def gram_hashes(sums: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of every run of `gram` bytes, from the prefix sums of the data."""
    with np.errstate(over="ignore"):
        return _mixed((sums[gram:] - sums[:-gram]) * _power(_INVERSE, len(sums) - gram))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every window of a width, by doubling."""
    have = 1
    while 2 * have <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def runs(pieces: list[bytes], counts: list[int], window: int = WINDOW, length: int = LENGTH, gram: int = GRAMS[0], run_starts: int = RUN_STARTS) -> tuple[np.ndarray, ...]:
    """Arrays (piece, key, digest, start, starts, occurrences): the runs of one key among the first counts[i] starts of each piece.

    Every start asked for has at least `window` bytes in its piece. Runs are at most
    run_starts long. digest is a hash of the run's fragment; occurrences is 2 where the
    key's gram stands in the run's windows more than once.
    """
    width = window - gram + 1
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes, asked = np.array([len(x) for x in pieces], np.int64), np.array(counts, np.int64)
    base = np.cumsum(sizes) - sizes
    sums = _sums(data)
    hashes = gram_hashes(sums, gram)
    least = _sliding(hashes, width, np.minimum).copy()
    edges = np.zeros(len(data) + 1, np.int8)
    edges[base] += 1
    edges[base + asked] -= 1
    valid = np.cumsum(edges[: len(least)], dtype=np.int8) > 0
    least[~valid] = 0
    starts = np.flatnonzero(valid)
    value = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    first, key = starts[head], value[head]
    count = np.diff(np.append(head, len(starts)))
    # where a gram is the least of some window
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(hashes == _sliding(np.concatenate([edge, least, edge]), width, np.maximum))
    values, which = np.unique(hashes[chosen], return_inverse=True)
    n = len(hashes) + 1
    placed = np.sort(which * n + chosen)
    of = np.searchsorted(values, key) * n
    second = np.searchsorted(placed, of + first) + 1
    many = (second < len(placed)) & (placed[np.minimum(second, len(placed) - 1)] <= of + first + count - 1 + width - 1)
    occurrences = np.where(many, 2, 1)
    if (count > run_starts).any():
        parts = -(-count // run_starts)
        of_run = np.repeat(np.arange(len(first)), parts)
        nth = np.arange(len(of_run)) - np.repeat(np.cumsum(parts) - parts, parts)
        count = np.minimum(run_starts, count[of_run] - nth * run_starts)
        first, key, occurrences = first[of_run] + nth * run_starts, key[of_run], occurrences[of_run]
    piece = np.searchsorted(base, first, "right") - 1
    end = np.minimum(first + count + length - 1, base[piece] + sizes[piece])
    with np.errstate(over="ignore"):
        digest = _mixed((sums[end] - sums[first]) * _power(_INVERSE, len(sums))[first] + (end - first).astype(np.uint64))
    return piece, key.view(np.int64), digest.view(np.int64), first - base[piece], count, occurrences


def _run_rows(texts: DataFrame, window: int, length: int, gram: int) -> DataFrame:
    """(key, digest, node, start, starts, occurrences, copies) of every run of texts (node, copies, asked, body)."""
    names = ["key", "digest", "node", "start", "starts", "occurrences", "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, int, int, bytes]] = []  # row of the batch, offset in its text, starts asked for, bytes
            size = 0

            def scanned(held: list, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                piece, key, digest, start, count, occurrences = runs([h[3] for h in held], [h[2] for h in held], window, length, gram)
                at = pa.array(np.array([h[0] for h in held])[piece])
                start = start + np.array([h[1] for h in held])[piece]
                columns = [pa.array(key), pa.array(digest), batch.column(0).take(at), pa.array(start), pa.array(count.astype(np.int32)), pa.array(occurrences.astype(np.int32)), batch.column(1).take(at)]
                return pa.RecordBatch.from_arrays(columns, names)

            for i, (asked, value) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                text = value.as_py()
                asked = min(len(text) - window + 1, len(text) if asked is None else asked)
                for at in range(0, asked, _SCAN_BYTES):
                    held.append((i, at, min(_SCAN_BYTES, asked - at), text[at : at + _SCAN_BYTES + length - 1]))
                    size += len(held[-1][3])
                    if size >= _SCAN_BYTES:
                        yield scanned(held)
                        held, size = [], 0
            if held:
                yield scanned(held)

    long_enough = texts.select("node", "copies", "asked", "body").where(F.octet_length("body") >= window)
    return long_enough.mapInArrow(run, f"key bigint, digest bigint, node {_type(texts, 'node')}, start bigint, starts int, occurrences int, copies bigint")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _fragments(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, digest, copies, asked, body) of the wanted (key, digest, copies, at (node, start), starts), a text read once."""
    listed = wanted.groupBy(F.col("at.node").alias("of")).agg(F.collect_list(F.struct("key", "digest", "copies", F.col("at.start").alias("start"), "starts")).alias("runs"))
    joined = texts.join(listed, texts["node"] == listed["of"]).select("body", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0

            def flush(rows: list) -> pa.RecordBatch:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "digest", "copies", "asked", "body"])

            for body, listed in zip(batch.column(0), batch.column(1), strict=True):
                text = body.as_py()
                for r in listed.as_py():
                    rows.append((r["key"], r["digest"], r["copies"], r["starts"], text[r["start"] : r["start"] + r["starts"] + length - 1]))
                    size += len(rows[-1][4])
                    if size > 4 << 20:
                        yield flush(rows)
                        rows, size = [], 0
            if rows:
                yield flush(rows)

    return joined.mapInArrow(run, "key bigint, digest bigint, copies bigint, asked int, body binary")


def mark_block(fragments: list[bytes], asked: list[int], copies: list[int], window: int, length: int) -> list[list[tuple[int, int, bool]]]:
    """For each fragment the intervals of its first asked[i] starts that repeat on `length` bytes (True) and on `window` (False).

    The array has every distinct suffix once. A suffix of a fragment that has copies stands
    beside its equals, so its common prefix with a neighbour is all of it.
    """
    block = Block(fragments, asked)
    order = block.order(length)
    shared = block.common_prefixes(order, length)
    longest = np.zeros(len(block.codes), np.int32)
    longest[order[:-1]] = shared
    longest[order[1:]] = np.maximum(longest[order[1:]], shared)
    rest = np.where(np.array(copies) > 1, np.minimum(block.ends, np.iinfo(np.int32).max), 0)
    at = np.arange(len(block.codes))
    longest = np.maximum(longest, np.where(block.asked, np.repeat(rest, block.ends - block.starts + 1) - at, 0))
    out: list[list[tuple[int, int, bool]]] = [[] for _ in fragments]
    for full, least in ((True, length), (False, window)):
        # starts asked for in two fragments never touch: a sentinel lies between
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (block.asked & (longest >= least)).view(np.int8), [0]])))
        owner = np.searchsorted(block.starts, edges[::2], "right") - 1
        base = block.starts[owner]
        for f, a, b in zip(owner.tolist(), (edges[::2] - base).tolist(), (edges[1::2] - base - 1).tolist(), strict=True):
            out[f].append((a, b, full))
    return out


def _marks(fragments: DataFrame, window: int, length: int, block_bytes: int) -> DataFrame:
    """(key, digest, spans) of every fragment with repeated starts; the fragments of a key stand together."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Whole keys, as many as fit a block; a fragment that a repeated row brings again counts once."""
        held, seen, size, last = [], set(), 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns), strict=True):
                    if row[0] != last:
                        if size >= block_bytes:
                            yield held
                            held, size = [], 0
                        seen, last = set(), row[0]
                    if row[1] not in seen:
                        seen.add(row[1])
                        held.append(row)
                        size += len(row[4])
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches):
            spans = mark_block([r[4] for r in held], [r[3] for r in held], [r[2] for r in held], window, length)
            rows = [(r[0], r[1], [{"from": a, "to": b, "full": full} for a, b, full in s]) for r, s in zip(held, spans, strict=True) if s]
            kinds = (pa.int64(), pa.int64(), _SPANS_PA)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "digest", "spans"])

    return fragments.mapInArrow(run, f"key bigint, digest bigint, spans {_SPANS}")


def repeated_starts(texts: DataFrame, *, window: int = WINDOW, length: int = LENGTH, grams: tuple[int, ...] = GRAMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(node, spans) of texts (node, copies, asked, body): intervals of starts of strings that occur again, a row a run."""
    found = materialize(_run_rows(texts, window, length, grams[0]), "suffix-runs")
    keys = found.groupBy("key").agg(F.sum(F.col("occurrences") * F.col("copies")).alias("n")).where("n > 1")
    keys = materialize(keys.select(F.col("key").alias("of")), "suffix-keys")
    going = materialize(found.join(keys, found["key"] == keys["of"]).select("key", "digest", "node", "start", "starts", "copies"), "suffix-going")
    release(found, keys)

    distinct = going.groupBy("key", "digest", "starts").agg(F.sum("copies").alias("copies"), F.min(F.struct("node", "start")).alias("at"))
    distinct = materialize(distinct, "suffix-distinct")
    large = distinct.groupBy("key").agg(F.sum(F.col("starts") + (length - 1)).alias("bytes")).where(F.col("bytes") > (block_bytes if len(grams) > 1 else (1 << 62)))
    large = materialize(large.select(F.col("key").alias("of")), "suffix-large")
    small = distinct.join(large, distinct["key"] == large["of"], "left_anti")
    told = _marks(_fragments(texts, small, length).repartition("key").sortWithinPartitions("key"), window, length, block_bytes)
    if large.head(1):
        again = distinct.join(large, distinct["key"] == large["of"], "left_semi")
        again = _fragments(texts, again, length).dropDuplicates(["key", "digest"])
        again = materialize(again.select(F.struct("key", "digest").alias("node"), "copies", "asked", "body"), "suffix-again")
        deeper = repeated_starts(again, window=window, length=length, grams=grams[1:], block_bytes=block_bytes)
        deeper = deeper.groupBy("node").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        told = told.union(deeper.select("node.key", "node.digest", "spans"))
    told = told.select(F.col("key").alias("of"), F.col("digest").alias("as"), "spans")
    # as a table of its own the join has an exchange on both sides, so the copies of a fragment are split
    told = materialize(told, "suffix-marks")
    release(distinct, large)
    place = lambda s: F.struct((s["from"] + F.col("start")).alias("from"), (s["to"] + F.col("start")).alias("to"), s["full"].alias("full"))
    back = going.join(told, (going["key"] == told["of"]) & (going["digest"] == told["as"]))
    return back.select("node", F.transform("spans", place).alias("spans"))


def _node(document: Column, row: Column) -> Column:
    """The id of a document, which may be null, and the hash of its text in one binary: tables are dealt by plain columns only."""
    named = F.coalesce(F.concat(F.lit("+"), document.cast("string")), F.lit("-"))
    return F.concat(F.unhex(F.lpad(F.hex(row), 16, "0")), F.encode(named, "UTF-8"))


def _merged(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans [from, to) that strings of a length cover, their starts being the intervals first to last."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order] + length)
    new = np.flatnonzero(np.append(True, first[1:] > reach[:-1])) if len(first) else np.zeros(0, np.int64)
    ends = reach[np.append(new[1:], len(first)) - 1] if len(first) else new
    return list(zip(first[new].tolist(), ends.tolist(), strict=True))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, window: int = WINDOW, grams: tuple[int, ...] = GRAMS, **options) -> DataFrame:
    """(id, n_bytes, spans, kept, n_shared) of every document: removed byte spans [from, to), the bytes that stay, and how many bytes strings of `window` bytes cover that repeat."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(_node(F.col(id_col), row_key(text)).alias("node"), F.col(id_col).alias("id"), text.cast("binary").alias("body"))
    rows = materialize_dealt(rows, "suffix-texts", "node")
    texts = rows.select("node", F.lit(1).cast("long").alias("copies"), F.lit(None).cast("int").alias("asked"), "body")
    marks = repeated_starts(texts, length=length, window=window, grams=grams, **options)
    listed = marks.groupBy(F.col("node").alias("of")).agg(F.flatten(F.collect_list("spans")).alias("marks"))
    joined = rows.join(listed, rows["node"] == listed["of"], "left").select("id", "body", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept, shared = [], [], [], []
            for body, marked in zip(batch.column(1), batch.column(2), strict=True):
                text, found, repeated = body.as_py(), [], 0
                if marked.is_valid:
                    first, last, full = (marked.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                    found = _merged(first[full], last[full], length)
                    repeated = sum(b - a for a, b in _merged(first[~full], last[~full], window))
                cuts = [0, *(x for s in found for x in s), len(text)]
                sizes.append(len(text))
                spans.append([{"from": a, "to": b} for a, b in found])
                kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                shared.append(repeated)
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(shared, pa.int64())], ["id", "n_bytes", "spans", "kept", "n_shared"])

    return joined.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_bytes bigint, spans array<struct<from:bigint,to:bigint>>, kept binary, n_shared bigint")
