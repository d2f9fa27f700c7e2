"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn becomes ``<|turn|>role<|says|>text<|end|>``. Control strings inside roles and texts are
escaped by a backslash and ``z`` after their first character, and a backslash itself becomes
``\\s``, so no text can close or open a turn, and ``unescape`` gives back every text exactly.
Control strings are those of the template and those that other common templates use.

Every assistant turn becomes an example: all turns before it as context, its text alone trainable
(``loss_start``, ``loss_length`` in code points of ``formatted``). Turns after the last assistant
turn, or all turns if there is none, close the conversation in an example with nothing trainable,
so the last example of a conversation holds all of it.

Defined cases: null texts and roles count as empty; turns with one number are ordered by role, then
text, nulls of the number first; a repeated row is a turn of its own; a null conversation id is a
conversation; an empty table yields no example; other columns are not read.
A conversation is one row, as its examples are: the template needs all of it in a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: How control strings of chat templates in use go on after their first character; any of them inside a text is escaped.
ANGLE, SQUARE = r"<(?=\||/?s>|</?SYS>>|/?(?:start|end)_of_turn>)", r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    """Reversible: first backslashes, then a mark inside every control string."""
    marked = F.replace(text, F.lit("\\"), F.lit("\\s"))
    marked = F.regexp_replace(marked, ANGLE, "<\\\\z")
    return F.regexp_replace(marked, SQUARE, "[\\\\z")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\z"), F.lit("")), F.lit("\\s"), F.lit("\\"))


def examples(conversations: DataFrame, assistant: str = "assistant", conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (from 0), trainable, formatted, loss_start (from 0) and loss_length."""
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    formatted = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(SAYS)).alias("head"),
        escape(t["text"]).alias("body"),
        (t["role"] == assistant).alias("trainable"),
    ))
    said = whole.select("conv_id", formatted.alias("said"))
    # Positions of the examples' last turns: every assistant turn, and the last turn of all.
    ends = F.filter(F.sequence(F.lit(1), F.size("said")), lambda i: F.element_at("said", i)["trainable"] | (i == F.size("said")))
    exploded = said.select("conv_id", "said", F.posexplode(ends).alias("example", "last"))
    target = F.element_at("said", F.col("last"))
    context = F.array_join(F.transform(F.slice("said", F.lit(1), F.col("last") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    parts = exploded.select("conv_id", F.col("example").cast("long").alias("example"), target["trainable"].alias("trainable"), F.concat(context, target["head"]).alias("before"), target["body"].alias("body"))
    return parts.select(
        "conv_id", "example", "trainable",
        F.concat("before", "body", F.lit(END)).alias("formatted"),
        F.length("before").cast("long").alias("loss_start"),
        F.when(F.col("trainable"), F.length("body")).otherwise(0).cast("long").alias("loss_length"),
    )


def parsed_turns(formatted: Column) -> Column:
    """The turns of a formatted text, read back: an array of role and text."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, F.greatest(F.size(F.split(formatted, r"<\|turn\|>")) - 1, F.lit(0)))
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(p, SAYS, 1)).alias("role"),
        unescape(F.regexp_replace(F.substring_index(p, SAYS, -1), r"<\|end\|>\z", "")).alias("text"),
    ))


def read_back(made: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from its examples alone."""
    text_of_loss = F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_length as int))")
    kept = made.select("conv_id", F.struct("example", "formatted", F.when(F.col("trainable"), unescape(text_of_loss)).otherwise("").alias("loss")).alias("e"))
    by = kept.groupBy("conv_id").agg(
        F.max_by(F.col("e.formatted"), F.col("e.example")).alias("all"),
        F.sort_array(F.collect_list(F.struct(F.col("e.example").alias("example"), F.col("e.loss").alias("loss")))).alias("losses"),
        F.sum(F.length("e.formatted")).cast("long").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    turns = by.select("conv_id", parsed_turns(F.col("all")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars", "n_examples")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
