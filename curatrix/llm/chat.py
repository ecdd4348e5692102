"""Chat formatting by perspective rotation: each participant in turn is the assistant, all others are named users.

DataFrame functions only. A dialogue is rendered whole; what is cut is its storage: parts of TURNS turns each, so that a
conversation that holds a third of all rows is many small groups. A part knows where it begins in the dialogue, and masks
count from the dialogue's start, so a dialogue's text is that of its parts in order, put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import attach, materialise
from curatrix.shared import placed

#: Turns in a part, and parts whose lengths are summed up together.
TURNS, TOGETHER = 64, 1024
SYSTEM = "system"
#: What stands for a missing role.
NO_ROLE = "unknown"
END = "\n<|end|>"


def _plain(x: Column) -> Column:
    """Markers of the format that occur in a text are taken apart."""
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def _header(role: Column, speaker: Column) -> Column:
    return F.when(role == SYSTEM, F.lit("<|system|>\n")).when(role == speaker, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n")))


def _pieces(speaker: Column) -> Column:
    """Of each turn of a part whether the speaker said it, and its header and body."""
    return F.transform("said", lambda t: F.struct((t["role"] == speaker).alias("own"), _header(t["role"], speaker).alias("header"), F.concat(t["text"], F.lit(END)).alias("body")))


def perspectives(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """One row for each conversation, each of its participants and each part of the dialogue: conv_id, speaker, part,
    n_parts, n_turns, start, n_chars, n_learned, mask, text.

    Participants are the roles that occur, but for SYSTEM, whose turns stay instructions; a conversation without any has no
    row. Turns are in order of turn, role and text; repeated rows are one turn, a null turn counts as 0, a null role as
    NO_ROLE, a null text as empty, and rows without conv_id are one conversation. start is where the part's text begins in
    the dialogue. mask has the code points of the dialogue that are learned, start-end with end exclusive, joined with
    commas: the speaker's words and the end after them. Other columns are ignored; an empty table gives an empty result.
    """
    role = _plain(F.coalesce("role", F.lit(NO_ROLE)))
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key")
    rows = conversations.select(key, "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), _plain(F.coalesce("text", F.lit(""))).alias("text")).distinct()
    # A turn's place in its conversation is that in all rows, sorted by ranges, after the conversation's first.
    numbered = placed(rows, [F.col(c) for c in ("key", "turn", "role", "text")])
    talks = numbered.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.collect_set(F.when(F.col("role") != SYSTEM, F.col("role"))).alias("speakers"))
    known = attach(numbered, materialise(talks, "conversations"), "key", "n", numbered.count()).filter(F.size("speakers") > 0)
    said = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said")
    parts = known.groupBy("key", F.floor((F.col("place") - F.col("first")) / turns).alias("part")).agg(F.first("conv_id").alias("conv_id"), F.first("speakers").alias("speakers"), F.ceil(F.first("n") / turns).alias("n_parts"), said)
    parts = materialise(parts, "parts")

    long = parts.filter("n_parts > 1").select("key", "part", F.explode("speakers").alias("speaker"), "said")
    length = F.aggregate(_pieces(F.col("speaker")), F.lit(0).cast("long"), lambda acc, p: acc + F.length(p["header"]) + F.length(p["body"]) + 1)
    lengths = materialise(long.select("key", "part", "speaker", F.floor(F.col("part") / TOGETHER).alias("block"), length.alias("size")), "lengths")
    # Where a part begins: the sizes of the blocks of parts before its own, and of the parts before it in its block.
    blocks = lengths.groupBy("key", "speaker", "block").agg(F.sum("size").alias("size"))
    before = blocks.select("key", "speaker", "block", (F.sum("size").over(Window.partitionBy("key", "speaker").orderBy("block")) - F.col("size")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("key", "speaker", "block").orderBy("part")) - F.col("size")
    starts = lengths.withColumn("inside", inside).join(before, ["key", "speaker", "block"]).groupBy("key", "part").agg(F.map_from_entries(F.collect_list(F.struct("speaker", F.col("before") + F.col("inside")))).alias("starts"))
    short = parts.filter("n_parts = 1").withColumn("starts", F.lit(None).cast("map<string, bigint>"))
    each = short.unionByName(parts.filter("n_parts > 1").join(starts, ["key", "part"])).withColumn("speaker", F.explode("speakers"))
    each = each.withColumn("start", F.coalesce(F.element_at("starts", F.col("speaker")), F.lit(0).cast("long"))).withColumn("pieces", _pieces(F.col("speaker")))
    nothing = F.struct(F.col("start").alias("at"), F.lit(0).cast("long").alias("learned"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["header"])
        end = start + F.length(p["body"])
        span = F.when(p["own"], F.array(F.concat_ws("-", start.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct((end + 1).alias("at"), (acc["learned"] + F.when(p["own"], end - start).otherwise(0)).alias("learned"), F.concat(acc["spans"], span).alias("spans"))

    each = each.withColumn("sums", F.aggregate("pieces", nothing, step))
    text = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["header"], p["body"])), "\n"), F.lit("\n"))
    return each.select(
        "conv_id", "speaker", "part", "n_parts", F.size("said").cast("long").alias("n_turns"), "start", (F.col("sums.at") - F.col("start")).alias("n_chars"),
        F.col("sums.learned").alias("n_learned"), F.array_join("sums.spans", ",").alias("mask"), text.alias("text"),
    )
