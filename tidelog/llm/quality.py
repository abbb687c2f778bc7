"""Quality rules: per-document counts, and cross-document line frequency a host.

Normalised lines are hashed, the distinct documents that hold each are counted a
host, lines in more than LINE_MAX_DOCS documents of a host are removed, and a document
left with too few of its words is rejected. A line stays in its first document, so of a
group of copies that fills a host one stays. The limit is a number of documents, so
what is boilerplate in a small host is boilerplate in a large one.

Defined results
---------------
* null text: no words, every count zero, base_failed.
* null host: a host of its own.
* rows equal in id, host and text count as one document and get equal results.
* an empty table gives an empty result; other columns are ignored, or kept by
  :func:`keep_documents`, whatever their names. Its texts have lost the removed lines;
  the counts and the verdict are of the text before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, hash_pair, lower_ascii, materialize, row_key, strip_ascii, unnested, without_lines

WORD = "[^\\x20\\x09-\\x0D]+"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A line is boilerplate in a host if more documents than these hold it.
LINE_MAX_DOCS = 20
#: A document is depleted if its remaining lines have less than this share of its words.
MIN_KEPT_SHARE = 0.2


def _count_of(text: Column, chars: str) -> Column:
    found = F.lit(0)
    for c in chars:
        found = found + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c)))
    return found


def _words(text: Column) -> Column:
    stripped = strip_ascii(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, "[\\x20\\x09-\\x0D]+"))


def _shifted(values: str, by: int) -> Column:
    """values from position by on, a window of 2 * by values being complete: the tail pairs with null and is cut off."""
    return F.slice(F.col(values), by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _folded(values: str, by: int) -> Column:
    """Hash of each value with the one `by` places on."""
    n = F.greatest(F.size(values) - by, F.lit(0))
    return F.zip_with(F.slice(F.col(values), 1, n), _shifted(values, by), lambda a, b: F.xxhash64(a, b))


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of a width at ascending starts."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        starts,
        zero,
        lambda acc, i: F.struct((acc["n"] + i + width - F.greatest(acc["end"], i)).alias("n"), (i + width).alias("end")),
        lambda acc: acc["n"],
    )


def text_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with __n_words, __word_chars, __n_symbols, __n_dup_lines and __n_repeat_words."""
    columns = docs.columns
    out = docs.withColumn("__body", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    has_word = lambda line: strip_ascii(line) != ""
    out = unnested(
        out,
        __h1=F.transform(_words(F.col("__body")), lambda w: F.xxhash64(w)),
        __lines=F.when(F.contains("__body", F.lit("\n")), F.filter(F.split("__body", "\n", -1), has_word)).otherwise(F.array().cast("array<string>")),
    )
    out = unnested(out, __h2=_folded("__h1", 1))
    out = unnested(out, __h4=_folded("__h2", 2))
    out = unnested(out, __h8=_folded("__h4", 4))
    repeats = F.size("__h8") > F.size(F.array_distinct("__h8"))
    indexed = F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = unnested(out, __sorted=F.when(repeats, F.array_sort(indexed)))
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.col("__sorted"))
    after = F.slice(F.col("__sorted"), 2, F.size("__sorted"))
    pairs = F.zip_with("__sorted", after, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), a["h"].eqNullSafe(b["h"]).alias("next")))
    marked = F.zip_with(pairs, before, lambda a, b: F.when(a["next"] | a["h"].eqNullSafe(b["h"]), a["i"]))
    starts = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
    return out.select(
        *columns,
        F.size("__h1").cast("long").alias("__n_words"),
        (F.length("__body") - _count_of(F.col("__body"), SPACES)).cast("long").alias("__word_chars"),
        _count_of(F.col("__body"), "#*$%&|<>").cast("long").alias("__n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"),
        F.when(F.col("__sorted").isNull(), F.lit(0)).otherwise(_covered(starts, WINDOW)).cast("long").alias("__n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("__n_words") < MIN_WORDS) | (F.lit(100) * F.col("__n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("__n_words"))


def removed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = LINE_MAX_DOCS) -> DataFrame:
    """(id, row, lost, gone): the words and the positions of removed lines, for documents that lose any."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), body.alias("body"), row_key(body).alias("text_key"))
    lines = rows.select("id", "host", "text_key", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "host", "text_key", "pos", lower_ascii(strip_ascii(F.col("line"))).alias("line")).where("line != ''")
    h1, h2 = hash_pair(F.col("line"))
    words = F.regexp_count("line", F.lit(WORD))
    index = materialize(lines.select("id", "host", "text_key", "pos", h1.alias("h1"), h2.alias("h2"), words.alias("words")), "quality-lines")
    frequent = index.groupBy("host", "h1", "h2").agg(F.count_distinct(F.struct("id", "text_key")).alias("documents"), F.min("id").alias("first"))
    frequent = frequent.where(F.col("documents") > max_docs).select(F.col("host").alias("of"), F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first")
    # as a table of its own the join has an exchange on both sides, so a hot line's rows are split
    frequent = materialize(frequent, "frequent-lines")
    hit = index.join(frequent, F.col("host").eqNullSafe(F.col("of")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    hit = hit.where(~F.col("id").eqNullSafe(F.col("first")))
    places = hit.groupBy("id", "host", "text_key").agg(F.array_sort(F.collect_set(F.struct("pos", "words"))).alias("places"))
    lost = F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    return places.select("id", row_key(F.col("host"), F.col("text_key")).alias("row"), lost.alias("lost"), F.col("places.pos").alias("gone"))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_kept_share: float = MIN_KEPT_SHARE, max_docs: int = LINE_MAX_DOCS) -> DataFrame:
    """A row a document: __id, __row, the counts, __base_failed, __kept_share, __kept and __gone (positions of removed lines, else null)."""
    removed = removed_lines(docs, id_col=id_col, text_col=text_col, host_col=host_col, max_docs=max_docs)
    text_key = row_key(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    narrow = docs.select(F.col(id_col).alias("__id"), row_key(F.col(host_col).cast("string"), text_key).alias("__row"), F.col(text_col).alias("__text"))
    counts = text_counts(narrow, "__text").drop("__text").withColumn("__base_failed", base_failed())
    out = counts.join(removed, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__row") == F.col("row")), "left")
    share = F.when(F.col("lost").isNull(), F.lit(1.0)).otherwise((F.col("__n_words") - F.col("lost")) / F.col("__n_words"))
    return out.select(*counts.columns, share.alias("__kept_share"), (~F.col("__base_failed") & (share >= min_kept_share)).alias("__kept"), F.col("gone").alias("__gone"))


def keep_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents that pass, with all their columns and without the lines that are removed."""
    verdicts = judge(docs, id_col=id_col, text_col=text_col, host_col=host_col, **limits)
    verdicts = verdicts.where("__kept").select("__id", "__row", "__gone").dropDuplicates(["__id", "__row"])
    text_key = row_key(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = docs.withColumn("__key", row_key(F.col(host_col).cast("string"), text_key))
    joined = keyed.join(verdicts, keyed[id_col].eqNullSafe(verdicts["__id"]) & (keyed["__key"] == verdicts["__row"]))
    text = F.col(text_col).cast("string")
    cleaned = F.when(F.col("__gone").isNull(), text).otherwise(without_lines(text, F.col("__gone"))).cast(docs.schema[text_col].dataType)
    return joined.select(*[cleaned.alias(c) if c == text_col else keyed[c] for c in docs.columns])
