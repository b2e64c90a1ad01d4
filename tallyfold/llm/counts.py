"""Token counts with a shortcut for pre-tokens that are one token.

Which strings of the vocabulary encode alone as exactly one token is proved beforehand, by
encoding each of them. A pre-token among them counts one without any merging; the rest is
merged by the library, once for each distinct pre-token a Python worker remembers.

Contract: null texts count as empty; empty texts have no tokens; repeated rows give repeated
rows; extra columns are ignored; strings of special tokens count as the library's default. A very
long text is counted whole, as one batch; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import arrow_map, whole_text
from tallyfold.llm.words import Encoder, as_letters, byte_letters, from_letters, library

LIMIT = 2048


class Counter:
    def __init__(self, path: str):
        self.single, self.model = single_tokens(path), library(path).model
        self.encoder = Encoder(path, self.placeholders)

    def placeholders(self, words: list[str]) -> list[range]:
        """For each pre-token a run as long as it has tokens; only lengths are used."""
        single, tokenize = self.single, self.model.tokenize
        return [range(1 if w in single else len(tokenize(as_letters(w)))) for w in words]

    def count(self, texts: list[str]) -> list[int]:
        return [n for _, _, lengths in self.encoder.batches(texts) for n in lengths.tolist()]


@lru_cache(maxsize=4)
def single_tokens(path: str) -> frozenset[str]:
    """Pre-tokens proved to encode as one token, as they stand in normalised text."""
    tokenizer, letters = library(path), set(byte_letters())
    normal = tokenizer.normalizer
    strings = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        bare = token.removesuffix("</w>")
        if letters.issuperset(bare):
            try:
                string = from_letters(bare)
            except UnicodeDecodeError:
                continue
            if not normal or normal.normalize_str(string) == string:
                strings.append(string)
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(
        s
        for s, e in zip(strings, encoded)
        if len(e.ids) == 1 and len(tokenizer.pre_tokenizer.pre_tokenize_str(s)) == 1
    )


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text."""

    def run(batch):
        return {
            "doc_id": batch.column("doc_id"),
            "n_bytes": batch.column("n_bytes"),
            "n_tokens": counter(path).count(batch.column("text").to_pylist()),
        }

    rows = documents.select(
        F.col("doc_id").cast("bigint"),
        whole_text().alias("text"),
        F.octet_length(whole_text()).cast("bigint").alias("n_bytes"),
    )
    return arrow_map(rows, run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
