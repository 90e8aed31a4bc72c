"""Chat formatting and its inverse, in Spark expressions only.

Template, for each block of neighbouring turns of one role:

    <|role|>ROLE<|text|>TEXT<|seg|>TEXT<|end|>

Control strings inside roles and texts are broken by a backslash after their first character, and backslashes
are doubled, so that every control string of the output is the template's own and the texts come back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, SEG, END = "<|role|>", "<|text|>", "<|seg|>", "<|end|>"
#: What no text may show a model as a control string: the template's own and those of common chat templates.
CONTROL = [ROLE, TEXT, SEG, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_RESTS = "|".join(c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROL)
ESCAPE_PATTERN = rf"([<\[])({_RESTS})"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, ESCAPE_PATTERN, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted (string), blocks (array of role, loss, n_chars and n_turns, in order;
    n_chars is the block's length in formatted, its marks included).

    Turns are ordered by turn (nulls first), then role and text; every row is a turn, repeated rows too. Null roles
    and texts are empty; rows with a null conversation form one. An empty table gives no rows. Other columns are
    not read. Rows of a conversation are collected with partial aggregation: the result has one row for each,
    so that a conversation is as large as one value may be (2 GB, and a task's memory).
    """
    r = rows.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    c = r.groupBy("conv_id").agg(F.collect_list("t").alias("t")).select("conv_id", F.array_sort("t").alias("t"))
    # where a block of one role starts: positions from 1, and one past the end
    starts = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (
        F.element_at("t", i).getField("role") != F.element_at("t", F.greatest(i - 1, F.lit(1))).getField("role")))
    c = c.select("conv_id", "t", starts.alias("s"))
    merged = F.transform("s", lambda at, k: F.slice("t", at, F.coalesce(F.try_element_at("s", k + 2), F.size("t") + 1) - at))
    c = c.select("conv_id", merged.alias("b"))
    text = F.transform("b", lambda b: F.struct(
        b.getItem(0).getField("role").alias("role"), F.size(b).alias("n_turns"),
        F.concat(F.lit(ROLE), escape(b.getItem(0).getField("role")), F.lit(TEXT),
                 F.array_join(F.transform(b, lambda t: escape(t.getField("text"))), SEG), F.lit(END)).alias("text")))
    c = c.select("conv_id", text.alias("b"))
    return c.select("conv_id", F.array_join(F.transform("b", lambda b: b.getField("text")), "").alias("formatted"),
                    F.transform("b", lambda b: F.struct(
                        b.getField("role").alias("role"), (b.getField("role") == loss_role).alias("loss"),
                        F.length(b.getField("text")).alias("n_chars"), b.getField("n_turns").alias("n_turns"))).alias("blocks"))


def parse_chats(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Read formatted back, from the string alone: conv_id, formatted, turns (array of role and text), loss_text.

    A null string gives null turns and loss_text, an empty one no turns and an empty loss_text; repeated rows stay and other columns are not
    read. An empty table gives an empty result."""
    blocks = F.filter(F.split("formatted", _literal(END), -1), lambda b: b != "")
    p = formatted.select("conv_id", "formatted", blocks.alias("b"))
    turns = F.flatten(F.transform("b", lambda b: F.transform(
        F.split(F.substring_index(b, TEXT, -1), _literal(SEG), -1),
        lambda x: F.struct(unescape(F.replace(F.substring_index(b, TEXT, 1), F.lit(ROLE), F.lit(""))).alias("role"), unescape(x).alias("text")))))
    p = p.select("conv_id", "formatted", turns.alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t.getField("role") == loss_role), lambda t: t.getField("text")), "")
    return p.select("conv_id", "formatted", "turns", loss.alias("loss_text"))


def _literal(mark: str) -> str:
    """mark as a pattern."""
    return mark.replace("|", r"\|")
