"""SimHash near-dedup over a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at
most two bits share at least MIN_SHARED_BYTES = 6 of them. Postings of one positional
byte, tallied a pair, would hold one in 256 of all fingerprints each, and their pairs
would grow with the square of the input. So the tally is folded into the key: a posting
is keyed by six positional bytes, one of the 28 ways to choose them, and a pair meets in
1, 7 or 28 postings as it shares 6, 7 or 8 bytes - and in none if it shares fewer, which
is the count filter. Pairs that meet are verified on their bits, inside the posting.

Exact copies are first merged to distinct fingerprints. Those of a posting differ in
two bytes, so a posting has 65,536 members at most, whatever the input's size, and one
member per distinct pair of bytes; the one path holds for groups of any size. Only
verified pairs leave a posting.

Defined results
---------------
* no words (null or empty text): fingerprint zero, linked like any other.
* null doc_id: linked by its text; component ids are the least non-null id of the
  component, null only if it has none.
* rows equal in id and text are the same document: equal results, and
  :func:`keep_one` keeps or drops them together.
* an empty table gives an empty result; other columns are ignored, or kept by
  :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key
from .components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
MIN_SHARED_BYTES = 8 - MAX_BITS
_CHUNK = 1 << 18
#: Every choice of the positional bytes that a pair must share.
LAYOUTS = tuple(sum(0xFF << 8 * b for b in chosen) for chosen in combinations(range(8), MIN_SHARED_BYTES))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at : at + _CHUNK], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, row, fp) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            fps = pa.array([fingerprint(t.as_py() or b"", shingle) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["id", "row", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), row_key(text).alias("row"), text.alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, row bigint, fp bigint")


def _literal(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)


def links(distinct: DataFrame) -> DataFrame:
    """Every pair (a, b) of distinct fingerprints fp at most two bits apart, a below b."""
    layout = F.explode(F.array(*[_literal(m) for m in LAYOUTS]))
    postings = distinct.select("fp", layout.alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    postings = postings.repartition("mask", "key")  # serves the count and the join
    shared = postings.groupBy("mask", "key").agg(F.count("*").alias("members")).where("members > 1")
    met = postings.join(shared, ["mask", "key"]).groupBy("mask", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    first = met.select("fps", F.posexplode("fps").alias("i", "a"))
    pairs = first.select("a", F.explode(F.expr(f"filter(slice(fps, i + 2, size(fps)), b -> bit_count(a ^ b) <= {MAX_BITS})")).alias("b"))
    return pairs.distinct()


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, row, fp, component) of every document."""
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp")))
    linked = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "least_id")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component"))
    by_print = linked.join(least, "root").select(F.col("fp").alias("linked_fp"), "component")
    named = distinct.join(by_print, distinct["fp"] == by_print["linked_fp"], "left")
    named = named.select(F.col("fp").alias("of"), F.when(F.col("linked_fp").isNull(), F.col("least_id")).otherwise(F.col("component")).alias("component"))
    # as a table of its own the join has an exchange on both sides, so a group of copies is split
    named = materialize(named, "fingerprint-components")
    return prints.join(named, prints["fp"] == named["of"]).select("id", "row", "fp", "component")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The documents without those that have a near copy of a smaller id; same columns."""
    grouped = group(docs, id_col=id_col, text_col=text_col, shingle=shingle)
    keep = grouped.where(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("__id"), F.col("row").alias("__row")).distinct()
    keyed = docs.withColumn("__key", row_key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return keyed.join(keep, keyed[id_col].eqNullSafe(keep["__id"]) & (keyed["__key"] == keep["__row"]), "left_semi").select(*docs.columns)
