"""Chat formatting with Spark expressions only.

Turns are collected as structs, sorted, adjacent turns of one role are merged by
array aggregation, and the pieces are concatenated. A merged block keeps the
boundary of its turns as a control token, so that the formatted string can be read
back turn by turn. The loss mask is a run of pieces (text, loss): their texts
concatenated are the formatted string, and loss is set on nothing but assistant
text.

Template::

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT ...]<|im_end|>\\n

Escapes: a backslash is doubled, and ``<|`` in a role or text becomes ``<\\|``, so no
control string can stem from a text. A role's line feeds become ``\\n`` (two
characters) for the same reason.

Defined results
---------------
* null text: empty; null role: empty.
* equal turn numbers: ordered by role, then text; repeated rows all stay.
* null turn: before the others; null conv_id: a conversation of its own.
* no rows, no conversations; other columns are ignored.
* one conversation is one output string, so its turns meet in one task by
  definition of the result; nothing else is grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # a doubled backslash before n is a backslash, not a line feed
    mark = F.lit("<|b|>")
    kept = F.replace(role, F.lit("\\\\"), mark)
    return F.replace(F.replace(F.replace(kept, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")), mark, F.lit("\\"))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv, pieces, formatted): a row a conversation."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("one"))
    sorted_turns = rows.groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("turns"))

    # each turn knows the role before and after it; equal neighbours share a block
    before = F.concat(F.array(F.lit(None).cast("string")), F.col("turns.role"))
    after = F.slice(F.col("turns.role"), 2, F.size("turns"))
    known = F.zip_with(
        F.zip_with("turns", F.slice(before, 1, F.size("turns")), lambda t, b: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["role"].eqNullSafe(b).alias("joins"))),
        after,
        lambda t, a: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["joins"].alias("joins"), t["role"].eqNullSafe(a).alias("goes_on")),
    )

    def pieces(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        opening = F.when(t["joins"], F.lit(SEPARATOR)).otherwise(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")))
        closing = F.when(t["goes_on"], F.lit("")).otherwise(F.lit(END + "\n"))
        return F.array(piece(opening, F.lit(False)), piece(escape(t["text"]), t["role"] == loss_role), piece(closing, F.lit(False)))

    out = sorted_turns.select("conv", F.flatten(F.transform(known, pieces)).alias("pieces"))
    return out.select("conv", "pieces", F.array_join("pieces.text", "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns, array of (role, text), of a formatted string."""
    blocks = F.filter(F.split(formatted, "<\\|im_start\\|>", -1), lambda _, i: i > 0)

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - F.lit(len(END) + 1))
        return F.transform(F.split(body, "<\\|im_sep\\|>", -1), lambda t: F.struct(_unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
