"""Chat formatting by prefix-target expansion: each assistant turn becomes an example of its own.

An example is the conversation up to and with one assistant turn; only that turn's text is under the loss mask. Turns
after the last assistant turn have no reply to train on; they stand in one further example without a target, so that
every turn can be read back. Templates mark a turn as ``<|turn|>role``, a line break, the text, ``<|end|>`` and a line
break; roles are URL-encoded, so that they hold neither line breaks nor markers.

Escaping: a backslash is put behind the first character of whatever reads as a control string once backslashes there
are left out, so no control string is left in an escaped text, and taking one backslash away gives the text back.

The prefixes of a conversation repeat its turns, as the method asks: the characters of its examples grow with the
product of its turns and its length. Each conversation is one row of the expansion; conversations are independent, so
no key but the conversation's own brings rows together.

Defined results: a null text or role reads as empty; turns are ordered by turn (null last), then role, then text, and
repeated rows stay as turns of their own; rows of a null conv_id form one conversation; an empty table gives no
examples. A conversation without assistant turn has one example without target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
# Control strings of the template and of other common templates, as first character and rest.
CONTROL = r"([<\[])(\\*)((?:\|turn\|>)|(?:\|end\|>)|(?:/?s>)|(?:/?INST\])|(?:/?SYS>>)|(?:\|im_start\|>)|(?:\|im_end\|>)|(?:\|endoftext\|>))"
ESCAPED = CONTROL.replace(r"(\\*)", r"\\(\\*)")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def examples(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as examples: conv_id, example (from 1), target (the turn's number from 1, null
    without one), formatted, loss_start and loss_end (code points, end exclusive, null without a target)."""
    turn = F.struct(
        F.col("turn").isNull().alias("late"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    escaped = F.transform("turns", lambda t: escape(t["text"]))
    head = F.transform("turns", lambda t: F.concat(F.lit(TURN), F.url_encode(t["role"]), F.lit("\n")))
    replies = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == "assistant")
    rows = rows.select("conv_id", replies.alias("replies"), F.size("turns").alias("n"), head.alias("head"), escaped.alias("body"))
    ends = F.when(
        F.coalesce(F.array_max("replies"), F.lit(0)) < F.col("n"), F.concat("replies", F.array("n"))
    ).otherwise(F.col("replies"))
    rows = rows.select("*", F.posexplode(ends).alias("_at", "_end"))
    is_target = F.col("_at") < F.size("replies")
    parts = F.zip_with(
        F.slice("head", 1, F.col("_end")), F.slice("body", 1, F.col("_end")), lambda h, b: F.concat(h, b, F.lit(f"{END}\n"))
    )
    rows = rows.select(
        "conv_id",
        (F.col("_at") + 1).alias("example"),
        F.when(is_target, F.col("_end")).alias("target"),
        F.array_join(parts, "").alias("formatted"),
        F.when(is_target, F.length(F.element_at("body", F.col("_end")))).alias("_size"),
    )
    end = F.length("formatted") - len(END) - 1
    return rows.select(
        "conv_id", "example", "target", "formatted",
        F.when(is_target_known(), end - F.col("_size")).alias("loss_start"), F.when(is_target_known(), end).alias("loss_end"),
    )


def is_target_known() -> Column:
    return F.col("target").isNotNull()


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of an example's text."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.substring_index(F.substring(p, len(TURN) + 1, F.length(p)), "\n", 1)).alias("role"),
            unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text"),
        ),
    )


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, as it was before escaping."""
    return unescape(F.substring(formatted, start + 1, end - start))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from its examples: all turns (of the longest example) and the texts under the loss masks in order."""
    loss = F.when(is_target_known(), read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")))
    per = formatted.select("conv_id", "example", "formatted", loss.alias("loss")).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    return per.select("conv_id", read_turns(F.col("longest")).alias("turns"), F.transform("losses", lambda x: x["loss"]).alias("losses"), "formatted_chars")
