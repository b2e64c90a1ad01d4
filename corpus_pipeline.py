"""From raw documents to packed training sequences, in five stages.

Each stage is given what the one before has kept, as a table read from parquet, and all but the
last return the columns of documents. Rows are dropped for these reasons only:

language     the text is null, empty or holds no letter, or most of it fits no language learned
toxicity     the score is 0.5 or more
exact        an equal text with a larger doc_id is there
near         a document of the same component has a smaller doc_id; components are made by links of a
             similarity of 0.80 or more, where op1_near_duplicates has 0.85

A row repeated with the same doc_id and text is kept once by the exact stage. Empty tables pass
through every stage, very long texts are judged whole, and extra columns are kept whatever their names,
up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import exact_dedup, language, minhash, packing, toxicity
from tallyfold.llm.common import id_remainder, written
from tallyfold.sources import read_table

NOISE = 0.5  # share of a text that fits no language, above which it is rejected
NEAR_PERCENT = 80  # similarity from which documents are near copies


def _same(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows of docs that are (``left_semi``) or are not (``left_anti``) among ``id, sha``."""
    same = docs["doc_id"].eqNullSafe(rows["id"])
    if "sha" in rows.columns:
        text = F.coalesce(docs["text"], F.lit(""))
        same = same & (F.sha2(text, 256) == rows["sha"])
    return docs.join(rows, same, how)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learn(docs.where(id_remainder(3) != 1))
    return language.recognised(docs, model, NOISE)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").where(id_remainder(5) != 0)
    return toxicity.harmless(docs, toxicity.learn(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = written(exact_dedup.exact_duplicates(docs))
    named = rows.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "kept")
    goes = named.where("not kept").select("id", "sha")
    stays = named.where("kept").select(F.col("id").alias("of")).distinct()
    same = goes["id"].eqNullSafe(stays["of"])
    # An id is enough to drop a document, unless another text of the same id stays.
    stay = _same(docs, written(goes.join(stays, same, "left_anti").select("id").distinct()), "left_anti")
    shared = written(goes.join(stays, same, "left_semi"))
    if not shared.isEmpty():
        stay = _same(stay, shared, "left_anti")
    again = written(named.where("kept").groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if again.isEmpty():
        return stay
    once = _same(stay, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return _same(stay, again, "left_anti").unionByName(once)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = written(minhash.near_duplicates(docs, NEAR_PERCENT)).select(F.col("doc_id").alias("id"), "kept")
    goes = rows.where("not kept").select("id").distinct()
    stays = rows.where("kept").select(F.col("id").alias("of"))
    # Of rows that share a doc_id, all stay if one does.
    goes = goes.join(stays, goes["id"].eqNullSafe(stays["of"]), "left_anti")
    return _same(docs, written(goes), "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("packing", packing_stage),
]

# Learned models and token ids are beyond SQL; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
