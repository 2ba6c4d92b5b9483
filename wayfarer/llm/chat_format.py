"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text
is trainable. A conversation that ends on another role, or has no assistant turn, gets one more example
with all its turns and nothing trainable, so that no turn is lost.

A turn is [INST]role, newline, text[/INST], or <s>role, newline, text</s> for an assistant. Inside roles
and texts a backslash becomes \\e, and the first character of a control string \\l (for <) or \\b (for [);
a newline in a role becomes \\n. Each is undone by itself, so that texts come back as they were.

Defined cases: null text and null role are empty; turns are ordered by turn, then role, then text (null
turns first); repeated rows are turns of their own; a null conv_id is a conversation; an empty table
gives an empty result; further columns are ignored. A conversation is one row while it is formatted, so its
examples must fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings start with < or [: <s> </s> <<SYS>> <</SYS>> <|...|> [INST] [/INST].
_ANGLE = r"<(?=/?s>|</?SYS>>|\|)"
_SQUARE = r"\[(?=/?INST\])"


def escaped(x: Column) -> Column:
    x = F.replace(x, F.lit("\\"), F.lit("\\e"))
    return F.regexp_replace(F.regexp_replace(x, _ANGLE, r"\\l"), _SQUARE, r"\\b")


def unescaped(x: Column) -> Column:
    for mark, original in (("\\l", "<"), ("\\b", "["), ("\\n", "\n"), ("\\e", "\\")):
        x = F.replace(x, F.lit(mark), F.lit(original))
    return x


def examples(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """conv_id, example, formatted, loss_start and loss_end (code points of formatted, end exclusive; null: no loss)."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    name, body = F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), escaped(text)
    head = F.concat(F.when(role == target, F.lit("<s>")).otherwise(F.lit("[INST]")), name, F.lit("\n"))
    tail = F.when(role == target, F.lit("</s>")).otherwise(F.lit("[/INST]"))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.concat(head, body, tail).alias("marked"), F.length(head).alias("before"), F.length(body).alias("size")).alias("x"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    whole = whole.withColumn("n", F.size("x"))
    ends = F.filter(F.sequence(F.lit(1), "n"), lambda k: (F.element_at("x", k)["role"] == target) | (k == F.col("n")))
    each = whole.select("conv_id", "x", F.posexplode(ends).alias("example", "k"))
    last, context = F.element_at("x", F.col("k")), F.array_join(F.transform(F.slice("x", 1, F.col("k") - 1), lambda t: t["marked"]), "")
    each = each.select("conv_id", F.col("example").cast("long").alias("example"), context.alias("context"), last.alias("last"))
    trained, at = F.col("last.role") == target, F.length("context") + F.col("last.before")
    return each.select(
        "conv_id", "example", F.concat("context", "last.marked").alias("formatted"),
        F.when(trained, at).cast("long").alias("loss_start"), F.when(trained, at + F.col("last.size")).cast("long").alias("loss_end"),
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted example, each as role, newline, text."""
    inner = F.regexp_extract_all(formatted, F.lit(r"(?s)(?:<s>|\[INST\])(.*?)(?:</s>|\[/INST\])"), 1)
    return F.transform(inner, lambda t: F.concat(unescaped(F.substring_index(t, "\n", 1)), F.lit("\n"), unescaped(F.substr(t, F.instr(t, "\n") + 1))))


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: its turns, the text under the loss mask and the characters written."""
    part = made.select("conv_id", "example", "formatted", F.length("formatted").cast("long").alias("chars"), F.coalesce(unescaped(F.substr("formatted", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))), F.lit("")).alias("loss"))
    whole = part.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("formatted"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum("chars").alias("formatted_chars"))
    turns, loss = turns_of(F.col("formatted")), F.array_join(F.col("losses.loss"), "")
    return whole.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars")


def summary(made: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("turns", lambda t: F.concat(t, F.lit("\n"))), "")
    return read_back(made).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
