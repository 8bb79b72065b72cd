"""Chat formatting: every assistant turn becomes an example with all turns before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template. Texts never hold < or >, so every tag is a real one.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
OPEN, NAMED, CLOSE = "<turn:", ">", "</turn>\n"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit(NAMED))


def training_examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): one example per assistant turn.

    ``conversations`` has conv_id, turn, role, text; other columns are ignored. ``text`` is
    the template of all turns up to the reply; the loss mask [loss_start, loss_end) in
    code points covers the escaped reply only, so each reply is trained once. Turns after
    the last reply, or a conversation without one, follow in an example with a null mask,
    so that no turn is lost. Turns are ordered by turn, role, text (nulls first); a null
    text or role is empty; a null conv_id is a conversation like others; repeated rows are
    turns each. A conversation is one row here: its own length is the bound.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    is_reply = F.expr("turns[i].role = 'assistant'")
    is_last = F.expr("i = size(turns) - 1")
    formatted = F.array_join(
        F.transform(
            F.expr("slice(turns, 1, i)"),
            lambda t: F.concat(_head(t["role"]), escaped(t["text"]), F.lit(CLOSE)),
        ),
        "",
    )
    head, body = _head(F.expr("turns[i].role")), escaped(F.expr("turns[i].text"))
    start = F.when(is_reply, F.char_length("before") + F.char_length(head))
    return (
        turns.select("conv_id", "turns", F.explode(F.sequence(F.lit(0), F.size("turns") - 1)).alias("i"))
        .filter(is_reply | is_last)
        .withColumn("before", formatted)
        .select(
            "conv_id",
            F.col("i").alias("example"),
            F.concat("before", head, body, F.lit(CLOSE)).alias("text"),
            start.alias("loss_start"),
            (start + F.char_length(body)).alias("loss_end"),
        )
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples' texts alone: turns (of the longest example),
    loss_text (all masked text, unescaped, in order) and formatted_chars."""
    masked = F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    rows = examples.select(
        "conv_id", "example", "text", F.char_length("text").cast("long").alias("chars"),
        unescaped(F.coalesce(masked, F.lit(""))).alias("loss"),
    )
    tags = F.split(F.expr(f"left(whole, greatest(char_length(whole) - {len(CLOSE)}, 0))"), CLOSE)
    turns = F.transform(
        tags,
        lambda t: F.struct(
            unescaped(F.substring_index(F.replace(t, F.lit(OPEN), F.lit("")), NAMED, 1)).alias("role"),
            unescaped(F.substring_index(t, NAMED, -1)).alias("text"),
        ),
    )
    return (
        rows.groupBy("conv_id")
        .agg(
            F.max(F.struct("example", "text")).alias("longest"),
            F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select(
            "conv_id", F.col("longest.text").alias("whole"), "formatted_chars",
            F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss_text"),
        )
        .select("conv_id", turns.alias("turns"), "loss_text", "formatted_chars")
    )
