"""Line dedup: drop lines that many documents share, all but one document's.

Line hashes are written once, then range-partitioned with a secondary sort by document
(the last first) and position. The first occurrence of a key streams past first, so it
is the one that stays; windows over the sorted rows count the documents behind it,
and no occurrence is exchanged again. A sketch of bounded size names the HEAVY most
frequent keys; those are range-partitioned by slices of their documents as well, so a
line held by a third of all documents spans many partitions, and a row a slice is
merged to find such a key's documents and last document. (The sketch decides only
where rows lie, never a result.) Dropped positions leave as per-document keep bitmaps,
run-length compressed; texts are moved only to be rebuilt from their bitmap.

Defined results
---------------
* null or empty text: one empty line, nothing dropped.
* rows equal in id and text count as one document; rows that share only the id
  count separately and, if theirs is the largest id, all keep the line.
* a null doc_id is smaller than any other.
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_pair, lower_ascii, materialize, release, row_key, strip_ascii, unnested

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys that are spread by document, the counters of the sketch that finds them, and the slices of each.
HEAVY = 1000
_COUNTERS = 20_000
_SLICES = 4096


def line_key(line: Column) -> Column:
    return lower_ascii(strip_ascii(line))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), text.alias("body"), row_key(text).alias("row"))


def line_hashes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc, row, pos) of every eligible line, in the shared folder."""
    lines = _keyed(docs, id_col, text_col).select("doc", "row", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = hash_pair(F.col("key"))
    return materialize(keys.select(h1.alias("h1"), h2.alias("h2"), "doc", "row", "pos"), "line-hashes")


def occurrence_index(hashes: DataFrame) -> DataFrame:
    """hashes with heavy and slice, range-partitioned and sorted; documents (of the key in the slice), last (the first row's document) and head (whether it is that row)."""
    frequent = hashes.agg(F.expr(f"approx_top_k(h1, {HEAVY}, {_COUNTERS})").alias("top"))
    frequent = frequent.select(F.explode("top.item").alias("of"))  # HEAVY rows at most
    spread = hashes.join(F.broadcast(frequent), hashes["h1"] == frequent["of"], "left").withColumn("heavy", F.col("of").isNotNull()).drop("of")
    spread = spread.withColumn("slice", F.when(F.col("heavy"), F.pmod(F.xxhash64("doc", "row"), F.lit(_SLICES))).otherwise(F.lit(0)))
    order = ("h1", "h2", "slice", F.desc("doc"), "row", "pos")
    ranged = spread.repartitionByRange("h1", "h2", "slice").sortWithinPartitions(*order)
    of_key = Window.partitionBy("h1", "h2", "slice")
    streamed = of_key.orderBy(*order[3:])
    other = ~F.struct("doc", "row").eqNullSafe(F.lag(F.struct("doc", "row")).over(streamed))
    first = F.row_number().over(streamed) == 1
    last = F.first("doc").over(streamed.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = ranged.select("*", first.alias("head"), other.alias("other"), last.alias("last"))
    return marked.withColumn("documents", F.sum((F.col("head") | F.col("other")).cast("int")).over(of_key)).drop("other")


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row, keep_runs) of documents that lose lines.

    keep_runs is the keep bitmap run-length compressed: an array of (from, to)
    positions, inclusive, of the dropped runs; every other bit is set.
    """
    hashes = line_hashes(docs, id_col=id_col, text_col=text_col, min_chars=min_chars)
    index = occurrence_index(hashes).where(F.col("heavy") | (F.col("documents") >= min_docs))
    index = materialize(index, "shared-lines")
    release(hashes)
    heavy = index.where("heavy")
    totals = heavy.where("head").groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(F.max("last").alias("of_all"), F.sum("documents").alias("n"))
    # a row a heavy key, HEAVY at most but for keys that agree on one of their two hashes
    totals = F.broadcast(totals.where(F.col("n") >= min_docs).drop("n"))
    spread = heavy.join(totals, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    dropped = index.where("NOT heavy").where(~F.col("doc").eqNullSafe(F.col("last"))).select("doc", "row", "pos")
    return _bitmaps(dropped.union(spread.where(~F.col("doc").eqNullSafe(F.col("of_all"))).select("doc", "row", "pos")))


def _bitmaps(dropped: DataFrame) -> DataFrame:
    positions = dropped.groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    before = F.concat(F.array(F.lit(-2)), F.col("dropped"))
    starts = F.filter(F.zip_with("dropped", before, lambda a, b: F.when(a != b + 1, a)), lambda x: x.isNotNull())
    after = F.concat(F.slice(F.col("dropped"), 2, F.size("dropped")), F.array(F.lit(-2)))
    ends = F.filter(F.zip_with("dropped", after, lambda a, b: F.when(a != b - 1, a)), lambda x: x.isNotNull())
    return positions.select("doc", "row", F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("from"), b.alias("to"))).alias("keep_runs"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every input row with its columns, and __n_lines, __n_dropped, __kept (text) beside them."""
    bitmaps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs)
    marks = bitmaps.select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("keep_runs").alias("__runs"))
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({"__body": body, "__key": row_key(body)})
    joined = keyed.join(marks, keyed[id_col].eqNullSafe(marks["__doc"]) & (keyed["__key"] == marks["__row"]), "left")
    joined = joined.select(*[keyed[c] for c in docs.columns], "__body", "__runs")
    joined = unnested(joined, __lines=F.when(F.col("__runs").isNotNull(), F.split("__body", "\n", -1)))
    count = F.length("__body") - F.length(F.replace("__body", F.lit("\n"))) + 1
    # what stays lies between the dropped runs
    begins = F.concat(F.array(F.lit(0)), F.transform("__runs", lambda r: r["to"] + 1))
    ends = F.concat(F.transform("__runs", lambda r: r["from"]), F.array(F.size("__lines")))
    stays = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice("__lines", a + 1, b - a)))
    dropped = F.aggregate("__runs", F.lit(0), lambda n, r: n + r["to"] - r["from"] + 1)
    return joined.select(
        *docs.columns,
        count.cast("long").alias("__n_lines"),
        F.coalesce(dropped, F.lit(0)).cast("long").alias("__n_dropped"),
        F.when(F.col("__runs").isNull(), F.col("__body")).otherwise(F.array_join(stays, "\n")).alias("__kept"),
    )


def clean_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with their shared lines gone, same columns; null text stays null."""
    out = dedup_lines(docs, id_col=id_col, text_col=text_col, **options)
    text = F.when(F.col(text_col).isNull(), F.col(text_col)).otherwise(F.col("__kept"))
    return out.withColumn(text_col, text).select(*docs.columns)
