"""Chat formatting by prefix-target expansion, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escaped(text: Column) -> Column:
    """text without the two characters that start every mark; unescaped() undoes it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def prefix_targets(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trainable: str = "assistant",
) -> DataFrame:
    """An example for every trainable turn: conv_col, example, n_turns, formatted, loss_start, loss_length.

    formatted holds all preceding turns and the reply, each as <|turn|>role<|text|>text<|end|>; the loss
    mask is the loss_length code points from loss_start (from 0), which are the reply's escaped text.
    Turns after the last reply make one last example without loss, so that no turn is lost.

    One shuffle brings the turns of a conversation together; a row never holds more than one
    conversation, which is also what its longest example has to hold.

    Turns are in the order of turn, role, text, nulls first, so ties and repeated rows have a fixed place.
    Null text or role: empty. Null conversation id: one more conversation. Empty table: empty
    result. Other columns are ignored.
    """
    turns = conversations.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("said"),
    )
    talks = turns.groupBy("conv").agg(F.sort_array(F.collect_list("said")).alias("said"))
    talks = talks.select(
        "conv",
        F.transform("said", lambda t: F.concat(F.lit(TURN), escaped(t.role), F.lit(TEXT))).alias("heads"),
        F.transform("said", lambda t: escaped(t.text)).alias("texts"),
        F.transform("said", lambda t: t.role == trainable).alias("trained"),
    )
    marked = F.zip_with("heads", "texts", lambda head, text: F.concat(head, text, F.lit(END)))
    ends = F.filter(F.sequence(F.lit(1), F.size("texts")), lambda k: F.element_at("trained", k) | (k == F.size("texts")))
    examples = talks.select("conv", "heads", "texts", "trained", marked.alias("marked"), F.posexplode(ends).alias("example", "end"))
    is_target = F.element_at("trained", F.col("end"))
    before = F.concat(F.array_join(F.slice("marked", F.lit(1), F.col("end") - 1), ""), F.element_at("heads", F.col("end")))
    reply = F.element_at("texts", F.col("end"))
    return examples.select(
        F.col("conv").alias(conv_col),
        "example",
        F.col("end").cast("long").alias("n_turns"),
        F.concat(before, reply, F.lit(END)).alias("formatted"),
        F.when(is_target, F.length(before)).otherwise(0).cast("long").alias("loss_start"),
        F.when(is_target, F.length(reply)).otherwise(0).cast("long").alias("loss_length"),
    )


def read_back(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the examples of a conversation hold: conv_col, turns, loss_text, formatted_chars.

    turns (role and text) come from its longest example; loss_text is all text under the loss masks, in order.
    """
    loss = unescaped(F.substring("formatted", F.col("loss_start").cast("int") + 1, F.col("loss_length").cast("int")))
    per = examples.select(conv_col, "example", "formatted", F.struct("example", loss.alias("text")).alias("loss"))
    whole = per.groupBy(conv_col).agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x.text), "").alias("loss_text"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    parts = F.slice(F.split("longest", r"<\|turn\|>"), 2, 1 << 30)
    field = lambda part, k: unescaped(F.element_at(F.split(part, r"<\|text\|>|<\|end\|>"), k))
    turns = F.transform(parts, lambda part: F.struct(field(part, 1).alias("role"), field(part, 2).alias("text")))
    return whole.select(conv_col, turns.alias("turns"), "loss_text", "formatted_chars")
