"""Perspective rotation of dialogues, in DataFrame functions only.

Every participant of a dialogue gets a rendering of all of it in which that speaker is the
assistant and the others are named users. A rendering is kept as one row for each turn, with
the place of its text in the whole and the characters to train on, so that a dialogue of any
length is never one row or one task. Rendered text:

    <|assistant|>\\n{text}<|end|>\\n          the participant's own turns; trained on: text and <|end|>
    <|user name={speaker}|>\\n{text}<|end|>\\n the others'
    <|system|>\\n{text}<|end|>\\n             turns of a context role, which no participant takes

Places are added up in two steps: within blocks of turns, and over the blocks' totals. Blocks are
ranges of the whole order, of about BLOCK_TURNS rows, so they split a dialogue of any length even
where turns are null or tied.

Contract: turns are ordered by turn, role and text, nulls first; rows that are wholly the same
are rendered once each. Null text counts as empty, a null role as the speaker ``unknown``;
rows without conv_id are one dialogue. Very long texts are one row each. A dialogue with context turns only has no participant
and gives no rows. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import whole_text, written

CONTEXT = ("system",)
BLOCK_TURNS = 1 << 15
END = "<|end|>"


def in_blocks(turns: DataFrame) -> DataFrame:
    """Distinct turns with their ``block``: ranges of (conv_id, turn, speaker, text), in that order."""
    turns = written(turns)
    n = max(-(-turns.count() // BLOCK_TURNS), int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "speaker", "text")]
    return written(turns.repartitionByRange(n, *order).withColumn("block", F.spark_partition_id()))


def perspectives(conversations: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """``conv_id, assistant, place, turn, speaker, rendered, start, stop, train_start, train_stop``.

    ``place`` counts turns from 0, ``start`` and ``stop`` are character places in the whole
    rendering, and ``train_start`` and ``train_stop`` the part to train on (null: none).
    """
    turns = (
        conversations.select(
            F.col("conv_id").cast("bigint"),
            F.col("turn").cast("bigint"),
            F.coalesce("role", F.lit("unknown")).alias("speaker"),
            whole_text().alias("text"),
        )
        .groupBy("conv_id", "turn", "speaker", "text")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    turns = in_blocks(turns)
    speakers = written(
        conversations.select(
            F.col("conv_id").cast("bigint").alias("of"),
            F.coalesce("role", F.lit("unknown")).alias("assistant"),
        )
        .where(~F.col("assistant").isin(*context))
        .distinct()
    )
    head = (
        F.when(F.col("speaker").isin(*context), F.concat(F.lit("<|"), "speaker", F.lit("|>\n")))
        .when(F.col("speaker") == F.col("assistant"), F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n")))
    )
    seen = (
        turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))
        .select(
            "conv_id", "assistant", "turn", "speaker", "copies",
            "block",
            F.length(head).cast("bigint").alias("head_size"),
            F.concat(head, "text", F.lit(END + "\n")).alias("rendered"),
            "text",
        )
        .withColumn("size", F.length("rendered").cast("bigint"))
    )
    totals = written(
        seen.groupBy("conv_id", "assistant", "block").agg(
            F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("n")
        )
    )
    earlier = (
        Window.partitionBy("conv_id", "assistant")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = written(
        totals.select(
            F.col("conv_id").alias("b_conv"),
            F.col("assistant").alias("b_assistant"),
            F.col("block").alias("b_block"),
            F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("size_before"),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
        )
    )
    within = (
        Window.partitionBy("conv_id", "assistant", "block")
        .orderBy("turn", "speaker", "text")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        seen.withColumn("size_in", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0)))
        .withColumn("n_in", F.coalesce(F.sum("copies").over(within), F.lit(0)))
        .join(
            blocks,
            F.col("conv_id").eqNullSafe(F.col("b_conv"))
            & (F.col("assistant") == F.col("b_assistant"))
            & F.col("block").eqNullSafe(F.col("b_block")),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
        .withColumn("start", F.col("size_before") + F.col("size_in") + F.col("copy") * F.col("size"))
    )
    own = F.col("speaker") == F.col("assistant")
    return placed.select(
        "conv_id",
        "assistant",
        (F.col("n_before") + F.col("n_in") + F.col("copy")).alias("place"),
        "turn",
        "speaker",
        "rendered",
        "start",
        (F.col("start") + F.col("size")).alias("stop"),
        F.when(own, F.col("start") + F.col("head_size")).alias("train_start"),
        F.when(own, F.col("start") + F.col("size") - 1).alias("train_stop"),
    )
