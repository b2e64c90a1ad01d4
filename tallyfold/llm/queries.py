"""The queries of the operators, and their SQL where there is any."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import (
    bpe,
    chat,
    counts,
    exact_dedup,
    hard_negatives,
    language,
    minhash,
    nearest,
    packing,
    simhash,
    token_files,
    toxicity,
    treap,
)
from tallyfold.llm.common import id_remainder
from tallyfold.sources import read_table


def _importable(query: Callable[[SparkSession, str], DataFrame]):
    """The query, with this library on the path of Python workers wherever the driver was started."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = str(Path(__file__).resolve().parents[2])
        environment = spark.sparkContext.environment
        paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if own not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([*paths, own])
        return query(spark, sf_dir)

    return run


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), percent=85)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    model = language.learn(documents.where(id_remainder(3) != 1))
    held_out = (id_remainder(3) == 1).alias("held_out")
    return language.languages(documents, model, held_out, shares=True)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.stored_ids(
        _documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(
        _documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(
        _documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels").where(id_remainder(5) != 0)
    held_out = (id_remainder(5) == 0).alias("held_out")
    return toxicity.toxicity(documents, toxicity.learn(documents, labels), held_out)


def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(read_table(spark, sf_dir, "conversations"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(
        _documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.ranked(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), k=20)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    other = (F.col("label").cast("bigint") + 1) % 10
    relabelled = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, other).otherwise(F.col("label")))
    anchors = relabelled.where(F.col("vec_id") % 100 == 0)
    return hard_negatives.hard_negatives(relabelled, anchors, positives=5, negatives=10, least=30, most=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_NEAREST = """
WITH vectors AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(q.v, b.v) AS score
    FROM vectors q JOIN vectors b ON q.vec_id <> b.vec_id AND len(q.v) = len(b.v)
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_NEAR = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, shingle FROM (
        SELECT doc_id, unnest(CASE
            WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
        END) AS shingle
        FROM texts
    )
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
    FROM shingles x JOIN shingles y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT r.a, l.other FROM reach r
    JOIN (SELECT a AS one, b AS other FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.one
), least AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

_EXACT = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_PERSPECTIVES = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text
    FROM conversations
), speakers AS (
    SELECT DISTINCT conv_id AS of_conv, speaker AS assistant FROM turns WHERE speaker <> 'system'
), seen AS (
    SELECT conv_id, assistant, turn, speaker, text,
           CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10)
                WHEN speaker = assistant THEN '<|assistant|>' || chr(10)
                ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head
    FROM turns JOIN speakers ON conv_id IS NOT DISTINCT FROM of_conv
), sized AS (
    SELECT *, head || text || '<|end|>' || chr(10) AS rendered,
           length(head || text || '<|end|>' || chr(10)) AS size
    FROM seen
), placed AS (
    SELECT *, row_number() OVER w - 1 AS place,
           CAST(sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
    FROM sized
    WINDOW w AS (PARTITION BY conv_id, assistant ORDER BY turn NULLS FIRST, speaker, text)
)
SELECT conv_id, assistant, place, turn, speaker, rendered, start, start + size AS stop,
       CASE WHEN speaker = assistant THEN start + length(head) END AS train_start,
       CASE WHEN speaker = assistant THEN start + size - 1 END AS train_stop
FROM placed
"""


_RANKED = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents WHERE doc_id IS NOT NULL
), counts AS (
    SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
    SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id
), total AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counts, total GROUP BY term
), lens AS (
    SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM lengths, total
), items AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark WHERE item_id IS NOT NULL
    ) GROUP BY ALL
), scored AS (
    SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
    FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN lens USING (doc_id)
    GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 20
"""

_NEGATIVES = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
           CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_near_duplicates,
        op2_nearest_neighbours,
        op3_language,
        op4_token_files,
        op5_token_counts,
        op6_packing,
        op7_toxicity,
        op8_exact_duplicates,
        op9_perspectives,
        op10_bpe_round_trip,
        op11_simhash,
        op12_ranked_search,
        op13_hard_negatives,
        pipeline,
    )
    return {query.__name__: _importable(query) for query in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_duplicates": _NEAR,
        "op2_nearest_neighbours": _NEAREST,
        "op8_exact_duplicates": _EXACT,
        "op9_perspectives": _PERSPECTIVES,
        "op12_ranked_search": _RANKED,
        "op13_hard_negatives": _NEGATIVES,
    }
