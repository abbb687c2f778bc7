"""Near copies: documents whose sets of five-word shingles are alike, linked and verified.

Two texts that share 80 % of their five-word shingles differ in about ten bits of a
64-bit fingerprint, so at least 8 - 10 < 0 of its bytes agree: the byte-position
index of :mod:`simhash` guarantees nothing there. Its pairs, at most two bits apart,
are links of one kind; minhash bands give those of the other. No text leaves before
both are joined in components:

1. A document has BANDS keys of ROWS minimal hashes each. A pair of Jaccard
   similarity s shares no key with probability (1 - s**ROWS)**BANDS, below 1e-4 at 0.8.
2. In each key one member of every component of the fingerprint links is verified on
   its whole shingle set against one of the largest component, other members in each
   band, and the verified pairs are links. That is one pair a component and key.
3. Members of a key whose components still differ are compared on sketches, a byte of
   each of their BANDS * ROWS minimal hashes: a pair of the similarity agrees on fewer
   than the least count asked for with a probability below 1e-4 (four deviations). A key
   of many members is dealt to pairs of blocks of BLOCK_MEMBERS, so no task holds it.
   Members with a partner that sketches and sizes allow come together once more, now
   with their whole shingle sets; each pair is verified in the first band that it shares,
   inside the task, and only links that join two components leave. Pairs are never rows.

Defined results
---------------
* null or empty text: no shingles, so no keys; the fingerprints link them.
* fewer words than a shingle: the whole sequence is one shingle.
* a fingerprint link is not verified on shingles; its texts are compared like all others.
* the document of the least (id, hash of the text) of a component stays; a null id is
  smaller than any other. Rows equal in id and text stay or go together.
* an empty table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import hash_pair, materialize, row_key
from .components import components
from .decontam import rolling

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
BLOCK_MEMBERS = 1024
_CHUNK = 1024
_MIX = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = rolling(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), min(width, len(words)))
    for _ in range(2):
        hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    return np.unique(hashes ^ (hashes >> np.uint64(32)))


def band_keys(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key a band, and the sketch: a byte of every minimal hash."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, (hashes[at : at + _CHUNK, None] * _FACTORS).min(0), out=least)
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ (keys >> np.uint64(32))) * _MIX + row
    return keys.view(np.int64), ((least * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes()


def least_agreement(similarity: float) -> int:
    """Bytes of two sketches that agree at least, four deviations below what the similarity leads to expect."""
    n = len(_FACTORS)
    return int(n * similarity - 4 * (n * similarity * (1 - similarity)) ** 0.5)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups; the rows of a group stand together, over one or more batches."""
    carried = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if carried is None else pa.concat_tables([carried, rows])
        if rows.num_rows:
            other = np.flatnonzero(rows.column("group").to_numpy() != rows.column("group")[-1].as_py())
            whole = int(other[-1]) + 1 if len(other) else 0
            carried = rows.slice(whole)
            if whole:
                yield rows.slice(0, whole)
    if carried is not None and carried.num_rows:
        yield carried


def _likely(rows: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places i, places j) of rows (group, n, root, block, sketch): of one group and two roots, that sizes and sketches allow.

    Of a group of two blocks only pairs across them are taken.
    """
    least = least_agreement(similarity)
    group, n, root, block = (rows.column(c).to_numpy() for c in ("group", "n", "root", "block"))
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(n), -1)
    new = np.append(True, group[1:] != group[:-1])
    of, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    two = (np.maximum.reduceat(block, heads) != np.minimum.reduceat(block, heads))[of]
    i, d = np.arange(len(n)), 0
    while len(i):
        d += 1
        i = i[i + d < len(n)]
        i = i[of[i + d] == of[i]]
        j = i + d
        may = (root[i] != root[j]) & ~(two[i] & (block[i] == block[j])) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
        a = i[may]
        a = a[(sketch[a] == sketch[a + d]).sum(1) >= least]
        if len(a):
            yield a, a + d


def _with_partners(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The rows that are in a likely pair."""
    for rows in _whole_groups(batches):
        flag = np.zeros(rows.num_rows, bool)
        for i, j in _likely(rows, similarity):
            flag[i] = flag[j] = True
        if flag.any():
            yield from rows.filter(pa.array(flag)).to_batches()


def _links_of_groups(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of likely pairs of rows (..., node, band, keys, hashes) whose sets reach the similarity, where they join two roots."""
    for rows in _whole_groups(batches):
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int64).reshape(rows.num_rows, -1)
        band, root, group = (rows.column(c).to_numpy() for c in ("band", "root", "group"))
        hashes, node = rows.column("hashes").combine_chunks(), rows.column("node").combine_chunks()
        sets: dict[int, np.ndarray] = {}
        parent: dict[tuple[int, int], tuple[int, int]] = {}

        def find(x: tuple[int, int], parent: dict = parent) -> tuple[int, int]:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = parent[x]
            return x

        def of(i: int, sets: dict = sets, hashes: pa.Array = hashes) -> np.ndarray:
            if i not in sets:
                sets[i] = np.frombuffer(hashes[i].as_buffer(), np.uint64)
            return sets[i]

        found = []
        for i, j in _likely(rows, similarity):
            first = (keys[i] == keys[j]).argmax(1) == band[i]
            for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
                x, y = find((group[a], root[a])), find((group[b], root[b]))
                if x != y and jaccard(of(a), of(b)) >= similarity - 1e-9:
                    parent[x] = y
                    found.append((a, b))
        if found:
            yield pa.RecordBatch.from_arrays([node.take(pa.array([f[k] for f in found])) for k in (0, 1)], ["a", "b"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def _body(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _sketches(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, keys, sketch) of every document with words: its number of shingles, its band keys and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py() or b"", width) for t in batch.column(1).cast(pa.large_binary())]
            made = [band_keys(s) if len(s) else ([], b"") for s in sets]
            keys, sketches = pa.array([k for k, _ in made], pa.list_(pa.int64())), pa.array([x for _, x in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), keys, sketches], ["node", "n", "keys", "sketch"])

    node = texts.schema["node"].dataType.simpleString()
    return texts.mapInArrow(run, f"node {node}, n bigint, keys array<bigint>, sketch binary").where("n > 0")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(of, keys, hashes) of texts (node, text): the band keys and the whole shingle set, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t.as_py() or b"", width) for t in part.column(1).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([band_keys(s)[0].tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["of", "keys", "hashes"])

    node = texts.schema["node"].dataType.simpleString()
    return texts.select("node", "text").mapInArrow(run, f"of {node}, keys binary, hashes binary")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary())
            alike = [jaccard(shingles(a.as_py(), width), shingles(b.as_py(), width)) >= similarity - 1e-9 for a, b in zip(left, right, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))

    node = texts.schema["node"].dataType.simpleString()
    met = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    met = met.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    return met.select("a", "b", "left", "right").mapInArrow(run, f"a {node}, b {node}")


def _joined(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (node, ...) of docs whose node is one of nodes."""
    of = nodes.select(F.col("node").alias("of"))
    return docs.join(of, docs["node"] == of["of"], "left_semi")


def _fingerprinted(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(node, root) of every node: the least node among those that fingerprints connect."""
    prints = simhash.fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle)
    prints = prints.select(F.struct("id", "row").alias("node"), "fp").distinct()
    prints = materialize(_joined(prints, nodes), "node-fingerprints")
    roots = components(simhash.links(prints.select("fp").distinct())).select(F.col("node").alias("of"), F.col("root").alias("group"))
    prints = prints.join(roots, prints["fp"] == roots["of"], "left").select("node", F.coalesce("group", "fp").alias("group"))
    prints = materialize(prints, "fingerprint-groups")
    # as a table of its own the join has an exchange on both sides, so a large group is split
    least = materialize(prints.groupBy("group").agg(F.min("node").alias("root")), "fingerprint-roots")
    return materialize(prints.join(least, "group").select("node", "root"), "node-roots")


def _both(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def near_copies(docs: DataFrame, nodes: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of every node with a near copy; a node is (id, row), root the least of its component."""
    named = _fingerprinted(docs, nodes, id_col, text_col, shingle)
    stars = named.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    body = _body(text_col)
    texts = docs.select(F.struct(F.col(id_col).alias("id"), row_key(body).alias("row")).alias("node"), body.alias("text"))
    # repeated rows are merged here and below, so that no whole text is moved for it
    sketches = _sketches(texts, shingle).dropDuplicates(["node"]).join(named, "node")
    sketches = materialize(sketches, "sketches")
    postings = sketches.select("node", "root", "n", F.posexplode("keys").alias("band", "key"))
    mark = F.xxhash64("root")
    mixed = postings.groupBy("band", "key").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).where("low != high").select("band", "key")
    met = materialize(postings.join(mixed, ["band", "key"]), "band-members")

    # only texts that share a key with one of another component are compared
    asked = materialize(met.select("node").distinct(), "asked-nodes")
    texts = materialize(_joined(texts, asked).dropDuplicates(["node"]), "asked-texts")

    # one member a component and key, against one of the key's largest component
    reps = met.groupBy("band", "key", "root").agg(F.min_by("node", F.xxhash64("band", "node")).alias("node"), F.count("*").alias("members"))
    reps = materialize(reps, "band-components")
    pivots = reps.groupBy("band", "key").agg(F.max_by("node", F.struct("members", "root")).alias("pivot"))
    first = reps.join(pivots, ["band", "key"]).where("node != pivot").select(*_both(F.col("node"), F.col("pivot"))).distinct()
    first = materialize(first, "pivot-pairs")
    linked = materialize(_verified(first, texts, shingle, similarity), "pivot-links")

    # then all pairs of components that still differ; one of the two is not in the key's largest
    edges = stars.union(linked)
    roots = components(edges).select(F.col("node").alias("of"), F.col("root").alias("now"))
    named = met.join(roots, met["node"] == roots["of"], "left").select("band", "key", "node", "n", F.coalesce("now", "root").alias("root"))
    named = materialize(named, "band-roots")
    sizes = named.groupBy("band", "key", "root").agg(F.count("*").alias("members"))
    differ = sizes.groupBy("band", "key").agg(F.sum("members").alias("members"), F.count("*").alias("roots")).where("roots > 1")
    differ = materialize(differ.drop("roots"), "band-differ")
    blocks = F.ceil(F.col("members") / BLOCK_MEMBERS)
    dealt = named.join(differ, ["band", "key"]).join(sketches.select(F.col("node").alias("of"), "sketch"), F.col("node") == F.col("of"))
    dealt = dealt.select("band", "key", "node", "n", F.xxhash64("root").alias("root"), "sketch", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("block"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64("band", "key", F.least("block", "other"), F.greatest("block", "other")).alias("group"), "band", "node", "n", "root", "block", "sketch")
    node = texts.schema["node"].dataType.simpleString()
    schema = f"group bigint, band int, node {node}, n bigint, root bigint, block bigint, sketch binary"
    partnered = dealt.repartition("group").sortWithinPartitions("group").mapInArrow(lambda batches: _with_partners(batches, similarity), schema)
    partnered = materialize(partnered, "band-partners")
    sets = materialize(_sets(_joined(texts, partnered.select("node").distinct()), shingle), "partner-sets")
    compared = partnered.join(sets, F.col("node") == F.col("of")).drop("of")
    links = compared.repartition("group").sortWithinPartitions("group").mapInArrow(lambda batches: _links_of_groups(batches, similarity), f"a {node}, b {node}")
    return components(edges.union(materialize(links.select(*_both(F.col("a"), F.col("b"))), "band-links")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near copies, same columns."""
    body = _body(text_col)
    row, second = hash_pair(body)
    rows = docs.select(F.struct(F.col(id_col).alias("id"), row_key(body).alias("row")).alias("node"), row.alias("first"), second.alias("second"))
    # equal texts are one node, named by the least id
    nodes = materialize(rows.groupBy("first", "second").agg(F.min("node").alias("node")).select("node"), "distinct-texts")
    copies = near_copies(docs, nodes, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity)
    copies = materialize(copies.where("node != root").select(F.col("node").alias("of")), "near-copies")
    kept = nodes.join(copies, nodes["node"] == copies["of"], "left_anti").select(F.col("node.id").alias("__id"), F.col("node.row").alias("__row"))
    kept = materialize(kept, "near-kept")
    keyed = docs.withColumn("__key", row_key(body))
    return keyed.join(kept, keyed[id_col].eqNullSafe(kept["__id"]) & (keyed["__key"] == kept["__row"]), "left_semi").select(*docs.columns)
