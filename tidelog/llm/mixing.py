"""Mixing sources to target weights.

1. Targets. The mix holds `share` times the words of all documents, dealt to the
   sources by weight; a source stops at `cap` times its size and the excess goes to
   the others by weight. That is water-filling: with sources ordered by the level
   cap * size / weight at which they fill, the common level is the greatest of the
   levels found with 0, 1, 2 ... of them full.
2. Packing. A source's documents, in a seeded hash order, form one stream of words
   cut into blocks of a fixed length; a block may span documents. Offsets are a
   two-level prefix sum (hash buckets, then within a bucket), so a source with a
   third of all rows is spread over all buckets.
3. Draw. An output shard has SHARD_SLOTS slots, and each draws its source with the
   quotas as odds, so the source counts of a shard are multinomial. A source takes what
   its shards drew. Only where their sum leaves the two numbers of blocks next to its
   target (below it and above) is it brought back: the last slots too many are dropped,
   slots too few fill shards of their own. So a source meets its target to a block, and
   the draw decides on which side.
4. Slots. Slot j of a source in a shard is the source's slot k = (its slots in earlier
   shards) + j. Epoch k div n maps k mod n through that epoch's permutation
   a * (k - p) - 1 mod n, a a prime that does not divide n, so a block is used at most
   once an epoch and no document beyond the cap. p is pseudorandom and the place of the
   last block, the only short one, so the words of any number of slots are known.
5. Join. Blocks and slots meet on (source, block index): :func:`mixed_blocks` has the
   words of every slot, :func:`mix` how many of them are a document's.

Everything is DataFrame functions; nothing depends on partitioning, so reruns agree.

Defined results
---------------
* null text: no words, taken 0. Null source: a source of its own, ranked last.
* a source without words: target 0.
* repeated rows are separate documents of equal size.
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, row_key

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
SEED = "mix"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Prime multipliers of the permutations; their product is above any number of blocks.
PRIMES = (1_000_000_007, 998_244_353, 2_147_483_647, 1_000_000_009)
#: Rows that one task explodes at most, about.
_TASK_ROWS = 250_000
#: Cells of equal odds in which a drawn number looks up its source, at least.
_CELLS = 1024


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, rank, source_size, target) from rows (source, size); one row a source."""
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    ranked = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("double"))
    full = F.col("source_size") * float(cap)
    all_rows = Window.partitionBy(F.lit(0))
    by_level = all_rows.orderBy(full / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(onward))
    target = F.least(full, F.max("level").over(all_rows) * F.col("weight"))
    return levels.select("source", "rank", "source_size", target.alias("target"))


def _tail_place(epoch: Column, n: Column, rank: Column, seed: str) -> Column:
    """Where an epoch's permutation puts the last block."""
    return F.pmod(F.xxhash64(F.lit(seed), rank, epoch), n)


def _quota(sources: DataFrame, block: int, seed: str) -> DataFrame:
    """(rank, blocks, slots, most): the numbers of slots whose words are next to the target, below it and above."""
    size, target, blocks = F.col("source_size"), F.col("target"), F.col("blocks")
    out = sources.where("source_size > 0").withColumns({"blocks": F.ceil(size / block).cast("long"), "epochs": F.floor(target / size).cast("long")})
    out = out.withColumn("place", _tail_place(F.col("epochs"), blocks, F.col("rank"), seed))
    rest, short = target - F.col("epochs") * size, blocks * block - size  # words of the last epoch, words that the last block lacks
    with_tail = F.floor((rest + short) / block)
    last = F.when(with_tail > F.col("place"), with_tail).otherwise(F.least(F.floor(rest / block), F.col("place"))).cast("long")
    words = last * block - F.when(last > F.col("place"), short).otherwise(F.lit(0))
    slots = F.col("epochs") * blocks + last
    return out.select("rank", "blocks", slots.alias("slots"), (slots + (words < rest).cast("long")).alias("most"))


def _permuted(k: Column, epoch: Column, n: Column, rank: Column, seed: str) -> Column:
    a = F.lit(PRIMES[-1])
    for p in reversed(PRIMES[:-1]):
        a = F.when(n % p != 0, F.lit(p)).otherwise(a)
    from_tail = (k + n - _tail_place(epoch, n, rank, seed)).cast("decimal(20,0)")
    return F.pmod(from_tail * F.pmod(a, n).cast("decimal(12,0)") + (n - 1).cast("decimal(20,0)"), n.cast("decimal(20,0)")).cast("long")


def _starts(counts: DataFrame, by: str, order: str, value: str, most: int) -> DataFrame:
    """counts with start, the sum of value in earlier rows of `by`; order runs below most. Two levels, so no task sees all."""
    width = max(1, math.isqrt(max(0, most)))
    chunk = F.floor(F.col(order) / width).alias("chunk")
    sums = counts.groupBy(F.col(by).alias("of"), chunk).agg(F.sum(value).alias("in_chunk"))
    earlier = Window.partitionBy("of").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("of", F.col("chunk").alias("at"), F.coalesce(F.sum("in_chunk").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(by, "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("chunk", F.floor(F.col(order) / width)).withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    met = within.join(sums, (F.col(by) == F.col("of")) & (F.col("chunk") == F.col("at")))
    return met.select(*counts.columns, (F.col("before") + F.col("inside")).alias("start"))


def multinomial_counts(quota: DataFrame, total: int, shards: int, shard_slots: int, seed: str) -> DataFrame:
    """(rank, shard, drawn) of `total` slots in shards: each slot draws a number below total, and with it the source whose interval holds it."""
    spark = quota.sparkSession
    cells = max(_CELLS, 4 * quota.count())
    width = max(1, -(-total // cells))
    up_to = F.sum("slots").over(Window.orderBy("rank"))
    bounds = quota.where("slots > 0").select("rank", (up_to - F.col("slots")).alias("low"), up_to.alias("high"))
    first, last = F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)
    # a cell of the drawn numbers has the few intervals that meet it, so the look-up is an equi-join
    table = materialize(bounds.select("rank", "low", "high", F.explode(F.sequence(first, last)).alias("cell")), "mix-cells")
    each = spark.range(0, shards, 1, max(1, -(-total // _TASK_ROWS))).withColumnRenamed("id", "shard")
    here = F.least(F.lit(shard_slots).cast("long"), F.lit(total) - F.col("shard") * shard_slots)
    slots = each.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), here - 1)).alias("slot"))
    number = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "shard", "slot"), F.lit(total))
    drawn = slots.select("shard", number.alias("number")).withColumn("in_cell", F.floor(F.col("number") / width))
    met = drawn.join(table, (F.col("in_cell") == F.col("cell")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")))
    return met.groupBy("rank", "shard").agg(F.count("*").alias("drawn"))


def draw_counts(quota: DataFrame, *, seed: str = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(rank, shard, start, drawn): what each output shard takes of a source, as drawn, within the quota's bounds."""
    total = quota.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = -(-total // shard_slots)
    counts = materialize(multinomial_counts(quota, total, shards, shard_slots, seed), "mix-drawn")
    sums = counts.groupBy(F.col("rank").alias("of")).agg(F.sum("drawn").alias("drawn"))
    most = F.col("most") if "most" in quota.columns else F.col("slots")
    had = F.coalesce("drawn", F.lit(0))
    settled = quota.join(sums, F.col("rank") == F.col("of"), "left").select("rank", had.alias("had"), F.least(F.greatest(had, "slots"), most).alias("takes"))
    settled = materialize(settled, "mix-settled")
    takes = settled.select(F.col("rank").alias("of"), "takes")
    placed = _starts(counts, "rank", "shard", "drawn", shards).join(takes, F.col("rank") == F.col("of"))
    placed = placed.select("rank", "shard", "start", F.least("drawn", F.col("takes") - F.col("start")).alias("drawn")).where("drawn > 0")
    lacking = settled.where("takes > had").select("rank", "had", "takes", F.explode(F.sequence("had", F.col("takes") - 1, F.lit(shard_slots).cast("long"))).alias("start"))
    more = lacking.select("rank", (F.lit(shards) + F.floor((F.col("start") - F.col("had")) / shard_slots)).alias("shard"), "start", F.least(F.lit(shard_slots).cast("long"), F.col("takes") - F.col("start")).alias("drawn"))
    return placed.union(more)


def slot_table(quota: DataFrame, *, seed: str = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, rank, epoch, block) of every slot of the mix; slot counts within a source."""
    counts = materialize(draw_counts(quota, seed=seed, shard_slots=shard_slots), "mix-counts")
    rows = counts.agg(F.coalesce(F.sum("drawn"), F.lit(0))).first()[0]
    dealt = counts.join(quota.select(F.col("rank").alias("of"), "blocks"), F.col("rank") == F.col("of")).repartition(max(1, -(-rows // _TASK_ROWS)), "rank", "shard")
    slots = dealt.select("shard", "rank", "blocks", F.explode(F.sequence("start", F.col("start") + F.col("drawn") - 1)).alias("slot"))
    epoch = F.floor(F.col("slot") / F.col("blocks")).cast("long")
    k = F.col("slot") % F.col("blocks")
    return slots.select("shard", "slot", "rank", epoch.alias("epoch"), _permuted(k, epoch, F.col("blocks"), F.col("rank"), seed).alias("block"))


def packed(sizes: DataFrame, *, seed: str = SEED) -> DataFrame:
    """sizes (id, row, rank, size) with the offset of each document in its source's stream of words."""
    buckets = max(1, math.isqrt(sizes.count()))  # as many buckets as rows in one: both levels stay small
    order = F.xxhash64(F.lit(seed), "id", "row")
    dealt = sizes.withColumns({"order": order, "bucket": F.pmod(order, F.lit(buckets))})
    sums = dealt.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rank", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("rank", "bucket").orderBy("order", "id", "row", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return within.join(starts, ["rank", "bucket"]).select("id", "row", "rank", "size", (F.col("start") + F.col("before")).alias("offset"))


def _sources_and_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, cap: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """Targets a source, and (id, row, rank, size, offset) a document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), row_key(text).alias("row"), size.alias("size"))
    rows = materialize(rows, "mix-sizes")
    sources = materialize(source_targets(rows, weights=weights, share=share, cap=cap), "mix-sources")
    names = sources.select(F.col("source").alias("of"), "rank")
    ranked = rows.join(names, rows["source"].eqNullSafe(names["of"])).select("id", "row", "rank", "size")
    documents = materialize(packed(ranked, seed=seed), "mix-offsets")
    release(rows)
    return sources, documents


def _parts(documents: DataFrame, block: int) -> DataFrame:
    """documents with each block that holds some of their words, the first such word (from 0) and their number."""
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)
    parts = documents.where("size > 0").select(*documents.columns, F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("offset"))
    end = F.least("size", (F.col("block") + 1) * block - F.col("offset"))
    return parts.select(*documents.columns, "block", begin.alias("begin"), (end - begin).alias("words"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: str = SEED) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every document."""
    sources, documents = _sources_and_documents(docs, id_col, text_col, source_col, weights, share, cap, seed)
    slots = slot_table(_quota(sources, block, seed), seed=seed, shard_slots=shard_slots)
    times = slots.groupBy("rank", "block").agg(F.count("*").alias("times"))
    taken = _parts(documents, block).join(times, ["rank", "block"]).groupBy("rank", "offset").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    at = taken.select(F.col("rank").alias("at_rank"), F.col("offset").alias("at_offset"), "taken")
    told = documents.join(at, (F.col("rank") == F.col("at_rank")) & (F.col("offset") == F.col("at_offset")) & (F.col("size") > 0), "left")
    return told.join(sources, "rank").select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: str = SEED) -> DataFrame:
    """(shard, source, slot, epoch, block, words) of every slot: the mix itself, the words of a block in order."""
    sources, documents = _sources_and_documents(docs, id_col, text_col, source_col, weights, share, cap, seed)
    slots = slot_table(_quota(sources, block, seed), seed=seed, shard_slots=shard_slots)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("of"), row_key(text).alias("key"), F.regexp_extract_all(text, F.lit(WORD), 0).alias("all")).dropDuplicates(["of", "key"])
    met = _parts(documents, block).join(texts, F.col("id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("key")))
    pieces = met.select("rank", "block", F.struct("offset", F.slice("all", (F.col("begin") + 1).cast("int"), F.col("words").cast("int")).alias("words")).alias("piece"))
    blocks = pieces.groupBy("rank", "block").agg(F.flatten(F.array_sort(F.collect_list("piece")).getField("words")).alias("words"))
    return slots.join(blocks, ["rank", "block"]).join(sources.select("rank", "source"), "rank").select("shard", "source", "slot", "epoch", "block", "words")
