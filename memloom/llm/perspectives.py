"""Multi-party perspective rotation of dialogues.

Every participant of a dialogue gets a rendering in which that speaker is the
assistant and all others are named users; only the assistant's content and its
end mark are to be trained on. The result is one row per dialogue, perspective
and turn: the rendered segment, its place in the whole rendering, and the place
of what is trained. A rendering is its segments in order, so no dialogue ever
has to fit into one row or one task; ``rendered`` joins those of ordinary size.

All renderings of a dialogue have the same turns in the same order, and a turn's
segment differs between them only by its speaker's mark: own turns are shorter or longer by an amount
that follows from the name. So a place is the running length of the turns as others see them, plus that amount for
each own turn before. Running sums have two levels, within blocks of ``BLOCK`` turn numbers and over block
totals; totals are made from names and lengths alone, and the text is shuffled once, by block. A
dialogue with a third of all turns is spread by its blocks.

Defined results: turns are ordered by turn number (nulls first), speaker, text; rows repeating
all three are one turn; a null text is empty; a null or blank speaker is named
``unknown``; speakers in ``context`` are shown as they are and take no
perspective, so a dialogue of nothing else gives no rows; a null dialogue id is
a dialogue of its own; extra columns are ignored. Turns without a number and those whose
numbers fall into one block are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
CONTEXT = ("system",)
END = "<|end|>"


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """conv_id, perspective, seq, turn, role, name, segment, start, length, train, train_start, train_length."""
    speaker, conv = F.col(speaker_col).cast("string"), F.col(conv_col)
    no_conv = F.lit("0").cast(turns.schema[conv_col].dataType)
    said = turns.select(
        F.coalesce(conv, no_conv).alias("conv"), conv.isNull().alias("nameless"), F.floor(F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)) / BLOCK).alias("block"), F.col(turn_col).cast("long").alias("turn"),
        F.when(F.trim(F.coalesce(speaker, F.lit(""))) == "", F.lit("unknown")).otherwise(speaker).alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    talk, place = ["conv", "nameless"], ["conv", "nameless", "block"]
    is_context = F.col("name").isin(*context)
    head = F.when(is_context, F.concat(F.lit("<|"), "name", F.lit("|>"))).otherwise(F.concat(F.lit("<|user|>"), "name", F.lit(": ")))
    length = (F.length(head) + F.length("text") + len(END)).cast("long")
    own_more = F.lit(len("<|assistant|>") - len("<|user|>: ")) - F.length("perspective")

    # Of each block: turns and characters before it, and each party's own turns before it. No text from here on.
    lines = said.select(*place, "turn", "name", F.md5("text").alias("text"), length.alias("length")).distinct()
    counts = lines.groupBy(*place, "name").agg(F.count(F.lit(1)).alias("rows"), F.sum("length").alias("chars"))
    before = Window.partitionBy(*talk).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(*place).agg(F.sum("rows").alias("rows"), F.sum("chars").alias("chars"))
    blocks = blocks.select(*place, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"))
    parties = counts.where(~is_context).select(*talk, F.col("name").alias("perspective")).distinct()
    grid = blocks.join(parties, talk).join(counts.select(*place, F.col("name").alias("perspective"), "rows"), [*place, "perspective"], "left")
    earlier = Window.partitionBy(*talk, "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("own_before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    known = grid.groupBy(*place).agg(F.first("rows_before").alias("rows_before"), F.first("chars_before").alias("chars_before"), F.collect_list(F.struct("perspective", "own_before")).alias("parties"))

    # Everything with text keeps this one partitioning.
    once = said.repartition(*place).dropDuplicates()
    order = Window.partitionBy(*place).orderBy("turn", "name", "text")
    once = once.withColumn("length", length).withColumn("in_block", F.row_number().over(order))
    once = once.withColumn("upto", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = once.join(known, place).withColumn("party", F.explode("parties")).select("*", "party.*").drop("parties", "party")
    same = F.col("name") == F.col("perspective")
    own = F.sum(same.cast("long")).over(Window.partitionBy(*place, "perspective").orderBy("in_block").rowsBetween(Window.unboundedPreceding, 0)) - same.cast("long")
    each = each.withColumn("start", F.col("chars_before") + F.col("upto") - F.col("length") + own_more * (F.col("own_before") + own))
    shown = F.when(same, F.lit("<|assistant|>")).otherwise(head)
    each = each.withColumn("head", shown).withColumn("length", F.col("length") + F.when(same, own_more).otherwise(0))
    return each.select(
        F.when(~F.col("nameless"), F.col("conv")).alias("conv_id"), "perspective", (F.col("rows_before") + F.col("in_block") - 1).cast("long").alias("seq"), "turn",
        F.when(same, "assistant").when(is_context, F.col("name")).otherwise("user").alias("role"), "name", F.concat("head", "text", F.lit(END)).alias("segment"),
        F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), same.alias("train"),
        F.when(same, F.col("start") + F.length("head")).cast("long").alias("train_start"), F.when(same, F.col("length") - F.length("head")).cast("long").alias("train_length"),
    )


def rendered(rows: DataFrame) -> DataFrame:
    """One row per dialogue and perspective: text and trained spans. For dialogues that fit into one row."""
    turn = F.struct("seq", "segment", "train", F.struct(F.col("train_start").alias("start"), F.col("train_length").alias("length")).alias("span"))
    whole = rows.groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select(
        "conv_id", "perspective", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("text"),
        F.transform(F.filter("turns", lambda t: t["train"]), lambda t: t["span"]).alias("trained"),
    )
