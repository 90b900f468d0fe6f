"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns
of one role are merged into a block by array functions, and blocks are
concatenated.  Every step is linear in the length of the conversation.

Template: ``<|im_start|>role`` line feed, the texts of the block with
``<|im_sep|>`` between them, ``<|im_end|>`` line feed.  Each ``<|`` inside
a text is written ``<||`` (so no text can forge a control string; undone by
the reverse replacement), and a line feed inside a role as ``<|n|>``.

Defined results: null texts and roles are empty; a null turn sorts first;
rows equal in turn number are ordered by role, then text; repeated rows are
turns of their own; conversations with a null id form one conversation of
that id; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def unescape(c: Column) -> Column:
    return F.replace(c, F.lit("<||"), F.lit("<|"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<|n|>"), F.lit("\n")))


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: conv_id, formatted (the text) and segments,
    an array of (text, loss) whose texts joined are ``formatted``; loss marks
    the model's own words."""
    rows = turns.select("conv_id", F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # positions where a block of one role begins
    convs = convs.withColumn("at", F.filter(
        F.sequence(F.lit(1), F.size("t")),
        lambda i: (i == 1) | (F.col("t")[i - 1]["role"] != F.col("t")[i - 2]["role"])))
    convs = convs.withColumn("blocks", F.transform("at", lambda s, j: F.struct(
        F.col("t")[s - 1]["role"].alias("role"),
        F.slice("t", s, F.coalesce(F.get("at", j + 1), F.size("t") + 1) - s).alias("turns"))))

    def parts(b: Column) -> Column:
        """Segments of a block: head, texts with separators, end."""
        loss = b["role"] == loss_role
        head = F.struct(F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n")).alias("text"),
                        F.lit(False).alias("loss"))
        body = F.flatten(F.transform(b["turns"], lambda t, k: F.array(
            F.struct(F.when(k == 0, F.lit("")).otherwise(F.lit(SEP)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), loss.alias("loss")))))
        tail = F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))
        return F.concat(F.array(head), body, F.array(tail))

    segs = convs.select("conv_id", F.flatten(F.transform("blocks", parts)).alias("segments"))
    return segs.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def parse_chats(formatted: Column) -> Column:
    """The turns back from a formatted text: array of (role, text)."""
    blocks = F.filter(F.split(formatted, F.lit(r"<\|im_end\|>\n")), lambda b: b != "")

    def turns(b: Column) -> Column:
        cut = F.instr(b, F.lit("\n"))
        role = unescape_role(F.substring(b, F.lit(len(START) + 1), cut - len(START) - 1))
        body = F.substring(b, cut + 1, F.length(b))
        return F.transform(F.split(body, F.lit(r"<\|im_sep\|>"), F.lit(-1)),
                           lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def chat_digests(chats: DataFrame) -> DataFrame:
    """What the formatted output says, read back from it."""
    back = chats.select("conv_id", "formatted", parse_chats(F.col("formatted")).alias("turns"),
                        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]),
                                                 lambda s: unescape(s["text"])), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
