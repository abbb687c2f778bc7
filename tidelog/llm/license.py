"""License scans: exact set-similarity join of text blocks with license templates.

A block is a run of words of a whole text, whatever lines it is wrapped over. For
templates of up to w words (w a power of two) the blocks are the runs of 2 * w words
that begin at multiples of w, so every run of w words lies whole in a block. A block
matches a template if it holds at least `threshold` of the template's distinct words
(containment).

Texts are split into words once; what stays of them is a table of the places of
template words. It gives the frequencies by which the words are ordered over the whole
corpus, rarest first. A block that reaches the threshold must share one of the
template's first size - required + 1 words, so blocks round other words are never
formed (prefix filter); it must have at least `required` template words (length
filter) and enough of them left after the shared one (positional filter); what remains
is verified on the whole sets. Templates are a parameter, and all that comes of them
(vocabulary, index) is as large as they are: the vocabulary stands in the plan as a
set, which :func:`template_words` refuses above MAX_VOCABULARY words; the index is a table.

Besides, places where a phrase's words stand consecutively are found on whole
texts; they give the base labels.

Defined results
---------------
* null text: empty, no words, score 0.
* ties between templates: every template that reaches the threshold gives its label.
* rows equal in id and text get equal results.
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, row_key, unnested

THRESHOLD = 0.8
LEAST_WIDTH = 8
MAX_VOCABULARY = 50_000
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: License texts, and notices by which licenses ask to be named, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the specific language governing permissions and limitations under the License.""",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see
        https://www.gnu.org/licenses/""",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
        ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
        AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), _BETWEEN, -1), lambda w: w != "")


def all_words(text: str) -> list[str]:
    return "".join(c if c.isdigit() or "a" <= c <= "z" or ord(c) > 127 else " " for c in text.lower()).split()


def width_of(template: str) -> int:
    """The power of two that holds the template's words."""
    return max(LEAST_WIDTH, 1 << (len(all_words(template)) - 1).bit_length())


def template_words(spark: SparkSession, templates, threshold: float) -> tuple[DataFrame, list[str]]:
    """(template, label, width, required, word), a row a distinct word; and the vocabulary, with the phrases' words."""
    rows = []
    for t, (label, text) in enumerate(templates):
        own = sorted(set(all_words(text)))
        rows += [(t, label, width_of(text), math.ceil(threshold * len(own) - 1e-9), w) for w in own]
    vocabulary = sorted({r[4] for r in rows} | {w for phrase, _ in PHRASES for w in phrase.split()})
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"{len(vocabulary)} template words; the plan holds {MAX_VOCABULARY} at most")
    return spark.createDataFrame(rows, "template int, label string, width int, required int, word string"), vocabulary


def word_places(docs: DataFrame, vocabulary: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, n_words, hits) of every row: its words, and (pos, word) of those in the vocabulary; node is (id, row)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), row_key(text).alias("row")).alias("node"), text.alias("body"))
    rows = unnested(rows, all=words(F.col("body")))
    known = F.transform("all", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("pos"), w.alias("word"))))
    return rows.select("node", F.size("all").cast("long").alias("n_words"), F.filter(known, lambda x: x.isNotNull()).alias("hits"))


def block_matches(places: DataFrame, templates: DataFrame, widths: list[int]) -> DataFrame:
    """(node, template, label, containment) of every template that a block of the node's text matches; the best block counts."""
    counts = places.select(F.explode("hits.word").alias("of")).groupBy("of").agg(F.count("*").alias("n"))
    vocabulary = templates.select("word").distinct().join(counts, F.col("word") == F.col("of"), "left")
    ranks = vocabulary.select(F.col("word").alias("of"), (F.row_number().over(Window.orderBy(F.coalesce("n", F.lit(0)), "word")) - 1).alias("rank"))
    ranked = materialize(templates.join(ranks, F.col("word") == F.col("of")).drop("of"), "license-words")
    index = ranked.groupBy("template", "label", "width", "required").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    prefix = index.select("*", F.posexplode(F.slice("ranks", F.lit(1), F.size("ranks") - F.col("required") + 1)).alias("p", "rank"))
    prefix = materialize(prefix, "license-prefixes")
    by_word = ranked.select("word", "rank").distinct()

    # blocks that hold a prefix word of a template of their width; what is broadcast has a row a vocabulary word and width at most
    wanted = materialize(prefix.select("rank", "width").distinct().join(by_word, "rank").select(F.col("word").alias("of"), "width"), "license-wanted")
    rare = [r["of"] for r in wanted.select("of").distinct().collect()]
    blocks_of = lambda width: F.explode(F.array(F.floor(F.col("pos") / width), F.floor(F.col("pos") / width) - 1)).alias("block")
    found = places.select("node", F.explode(F.filter("hits", lambda h: h["word"].isin(rare))).alias("hit")).select("node", "hit.pos", "hit.word")
    candidates = found.join(F.broadcast(wanted), F.col("word") == F.col("of")).select("node", "width", blocks_of(F.col("width"))).distinct()
    candidates = materialize(candidates, "license-blocks")
    inside = places.where(F.exists("hits", lambda h: h["word"].isin(rare))).select("node", F.explode("hits").alias("hit")).select("node", "hit.pos", "hit.word")
    inside = inside.join(F.broadcast(by_word), "word").select("node", "pos", "rank", F.explode(F.array(*map(F.lit, widths))).alias("width"))
    inside = inside.select("node", "rank", "width", blocks_of(F.col("width")))
    sets = inside.join(candidates, ["node", "width", "block"]).groupBy("node", "width", "block").agg(F.array_sort(F.collect_set("rank")).alias("sorted"))

    met = sets.select("node", F.col("width").alias("of_width"), "block", "sorted", F.posexplode("sorted").alias("q", "shared"))
    met = met.join(prefix, (F.col("shared") == F.col("rank")) & (F.col("of_width") == F.col("width")))
    rest = F.least(F.size("ranks") - F.col("p"), F.size("sorted") - F.col("q"))
    met = met.where((F.size("sorted") >= F.col("required")) & (rest + F.least("p", "q") >= F.col("required")))
    overlap = F.size(F.array_intersect("sorted", "ranks"))
    verified = met.where(overlap >= F.col("required")).select("node", "template", "label", (overlap / F.size("ranks")).alias("containment"))
    return verified.groupBy("node", "template", "label").agg(F.max("containment").alias("containment"))


def _phrases(hits: str) -> Column:
    """(start, label) of every place of a phrase; its words are all in the vocabulary, so they are neighbours there."""

    def at(hit: Column, i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in PHRASES:
            first, *others = phrase.split()
            here = hit["word"] == first
            for k, other in enumerate(others, 1):
                following = F.get(F.col(hits), i + k)
                here = here & F.coalesce((following["word"] == other) & (following["pos"] == hit["pos"] + k), F.lit(False))
            label = F.when(here, F.lit(name)).otherwise(label)
        return F.struct(hit["pos"].alias("start"), label.alias("label"))

    return F.filter(F.transform(hits, at), lambda p: p["label"].isNotNull())


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """(id, n_words, places, base_labels, labels, score) of every document."""
    index, vocabulary = template_words(docs.sparkSession, templates, threshold)
    rows = materialize(word_places(docs, vocabulary, id_col=id_col, text_col=text_col), "license-places")
    found = block_matches(rows, index, sorted({width_of(text) for _, text in templates})).groupBy(F.col("node").alias("of")).agg(F.collect_set("label").alias("found"), F.max("containment").alias("score"))
    # as a table of its own the join has an exchange on both sides
    found = materialize(found, "license-matches")
    out = rows.select("node", "n_words", _phrases("hits").alias("places")).join(found, F.col("node") == F.col("of"), "left")
    base = F.array_distinct(F.col("places.label"))
    every = F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))
    best = F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.size("places") > 0, F.lit(threshold)).otherwise(F.lit(0.0)))
    return out.select(F.col("node.id").alias("id"), "n_words", "places", F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"), best.alias("score"))
