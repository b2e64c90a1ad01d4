"""Exact duplicates by recipes of content-defined chunks, in DataFrame functions only.

A text is cut where its own content says so: after a sentence or a line, once a chunk has
256 characters. A chunk is named by a hash. All distinct chunks are gathered once, copies
combined before they are moved, and hashes that stand for more than one chunk are found; such
chunks get an ordinal as well, which makes every identifier sure. A document is then its
ordered list of identifiers, and documents are equal exactly if their lists are. The lists
are a fiftieth of the text, and no whole document is moved.

Contract: texts are equal when identical after no change; null counts as empty, and empty
texts are equal to one another. Of equal texts the largest doc_id stays, nulls last. Rows are
documents: a row repeated with the same doc_id and text counts in group_size, and all of its
repetitions carry the same values. A very long text is one list of chunks. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import whole_text, written

CHUNK = r"(?s).{256}[^.!?\n]{0,1791}+[.!?\n]|.{1,2048}"


def chunks(text: Column) -> Column:
    """Pieces of 257 to 2048 characters (the last may be shorter) that make up the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(documents: DataFrame, name: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``doc_id, text_sha256, recipe, ordinals``: equal texts have equal recipes and ordinals.

    ``name`` hashes a chunk. ``ordinals`` is null for a document none of whose chunks shares
    its hash with another chunk.
    """
    rows = documents.select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks")
    )
    lists = written(
        rows.select("doc_id", "text_sha256", F.transform("chunks", lambda c: name(c)).alias("recipe"))
    )
    named = rows.select(F.explode("chunks").alias("chunk")).select(
        name(F.col("chunk")).alias("name"), "chunk"
    )
    # Copies of a chunk are combined ahead of the shuffle; only names go through the next.
    names = named.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    unsure = written(names.where("n > 1").select("name"))
    if unsure.isEmpty():
        return lists.withColumn("ordinals", F.lit(None).cast("array<struct<place:int,ordinal:int>>"))
    by_chunk = Window.partitionBy("name").orderBy("chunk")
    numbered = written(
        named.join(unsure, "name", "left_semi")
        .distinct()
        .withColumn("ordinal", F.row_number().over(by_chunk))
    )
    ordinals = written(
        rows.select("doc_id", "text_sha256", F.posexplode("chunks").alias("place", "chunk"))
        .withColumn("name", name(F.col("chunk")))
        .join(numbered, ["name", "chunk"])
        .groupBy("doc_id", "text_sha256")
        .agg(F.sort_array(F.collect_set(F.struct("place", "ordinal"))).alias("ordinals"))
    )
    same = lists["doc_id"].eqNullSafe(ordinals["doc_id"]) & (
        lists["text_sha256"] == ordinals["text_sha256"]
    )
    return lists.join(ordinals, same, "left").select(lists["*"], ordinals["ordinals"])


def exact_duplicates(
    documents: DataFrame, name: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row for each row."""
    rows = recipes(documents, name)
    # Only lists that occur again are kept apart, so a large group is joined with one row.
    groups = written(
        rows.groupBy("recipe", "ordinals")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    same = (rows["recipe"] == groups["recipe"]) & rows["ordinals"].eqNullSafe(groups["ordinals"])
    return rows.join(groups, same, "left").select(
        rows["doc_id"],
        F.when(F.col("group_size").isNull(), rows["doc_id"]).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(F.col("group_size").isNull(), True)
        .otherwise(rows["doc_id"].eqNullSafe(F.col("keep_id")))
        .alias("kept"),
        "text_sha256",
    )
