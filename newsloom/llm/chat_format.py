"""Relational chat formatting: collected turn structs are sorted, same-role neighbours merged, and joined to one string.

Layout of a conversation, one block per run of turns with the same role::

    <turn>role NEWLINE text <and> text </turn> NEWLINE        other roles
    <turn>assistant NEWLINE <gen>text</gen> <and> <gen>text</gen></turn> NEWLINE

(blanks above are for reading only). Inside roles and texts a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and, in roles,
a newline becomes ``\\n``; so a ``<`` in the output always begins a mark, whatever the texts say, and reading back is
exact. The loss mask is what stands between ``<gen>`` and ``</gen>``; ``<and>`` keeps merged turns apart.

Only Spark expressions are used, and every one is linear in the length of a conversation: runs are found by index,
never by growing an array or a string in a fold. A conversation is one output value, so its turns have to meet in one row;
it is bounded by what one string can hold.

Defined results: null text and null role are empty; turns with equal numbers are ordered by role, then text; a null turn
number comes first; a null conv_id is a conversation of its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted)`` from rows ``(conv_id, turn, role, text)``."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rows = rows.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (
        F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])))

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        role = F.get("turns", start)["role"]
        said = F.transform(F.slice("turns", start + 1, end - start), lambda t: F.when(
            role == TRAINED, F.concat(F.lit("<gen>"), escape(t["text"]), F.lit("</gen>"))).otherwise(escape(t["text"])))
        return F.concat(F.lit("<turn>"), _role(role), F.lit("\n"), F.array_join(said, "<and>"), F.lit("</turn>\n"))

    return rows.select("conv_id", F.array_join(F.transform("starts", block), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as ``array<struct<role, text>>``, merged ones apart again."""
    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != "")

    def parts(b: Column) -> Column:
        role = F.replace(F.substring_index(b, "\n", 1), F.lit("<turn>"), F.lit(""))
        body = F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b))
        return F.transform(F.split(body, "<and>"), lambda t: F.struct(
            unescape(F.replace(role, F.lit("\\n"), F.lit("\n"))).alias("role"),
            unescape(F.regexp_replace(t, "</?gen>", "")).alias("text")))

    return F.flatten(F.transform(blocks, parts))


def read_loss(formatted: Column) -> Column:
    """All text under the loss mask, unescaped, as an array of spans in order."""
    return F.transform(F.regexp_extract_all(formatted, F.lit("<gen>([^<]*)</gen>"), F.lit(1)), unescape)


def loss_spans(formatted: Column) -> Column:
    """``array<struct<mark, length>>``: lengths in characters of the marks' outside and inside, alternating from the start.

    Even entries are outside the loss, odd ones inside; together with their order they are the mask.
    """
    return F.transform(F.split(formatted, "</?gen>"), lambda s, i: F.struct((i % 2 == 1).alias("loss"), F.length(s).alias("length")))
