"""Language identification by mixture inference.

Each language is a distribution over hashed byte trigrams of lower-case letters, counted on a
sample of the labelled texts. A text is taken as a mixture of languages and of noise (every
trigram alike): expectation-maximisation estimates the shares, and the set of components is the
one with the best penalised likelihood, found by taking away the smallest one after the other.

Contract: ``und`` where the text is null, empty or holds no letter, or where no language was
learned. Rows without a lang teach nothing. Whole texts are used whatever their length. Ties
go to the language whose name is first. Repeated rows give repeated rows; extra columns are
ignored; an empty table gives no rows. The model holds ``BUCKETS`` numbers for each lang value;
more than ``MOST_LANGUAGES`` values raise an error, as that is no language column.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import arrow_map, rows_where, whole_text

BUCKETS = 1 << 16
DOCS_PER_LANGUAGE = 4000  # expected size of the training sample of each language
MOST_LANGUAGES = 256  # their counts, table and model take MODEL_BYTES in the driver at most
MODEL_BYTES = MOST_LANGUAGES * BUCKETS * (16 + 4 + 4)  # 0.4 GB; what is broadcast is a sixth
SMOOTH = 0.1
OVERLAP = 3  # each character is in three trigrams; likelihoods count a third
STEPS = 25
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams; all that is no letter counts as one blank."""
    data = _FOLD[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    stay = np.ones(len(data), bool)
    stay[1:] = (data[1:] != 32) | (data[:-1] != 32)
    data = data[stay].astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.uint32)
    joined = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return joined * np.uint32(2654435761) >> np.uint32(16)


def counted(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(buckets) > BUCKETS // 8:
        counts = np.bincount(buckets, minlength=BUCKETS)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(buckets, return_counts=True)


class Model:
    def __init__(self, names: list[str], counts: np.ndarray):
        """``counts``: a row for each language, a column for each bucket."""
        self.names = names
        self.chance = np.full((BUCKETS, len(names) + 1), 1 / BUCKETS, np.float32)  # the last: noise
        for i, row in enumerate(counts):
            self.chance[:, i] = (row + SMOOTH) / (row.sum() + SMOOTH * BUCKETS)

    def shares(self, text: str) -> tuple[np.ndarray, float]:
        """Share of each language, the last one of noise; how many letters' worth of evidence."""
        buckets, times = counted(trigrams(text))
        size = float(times.sum()) / OVERLAP
        if not len(buckets):
            return np.full(len(self.names) + 1, 1 / (len(self.names) + 1)), 0.0
        return choose(times.astype(float), self.chance[buckets].astype(float), size), size

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score, share of noise."""
        return self.infer(text)[:3]

    def infer(self, text: str) -> tuple[str, float, float, list[dict]]:
        """Language, score, share of noise, and all languages chosen with their shares, largest first."""
        if not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0, 1.0, []
        shares, size = self.shares(text)
        best = int(np.argmax(shares[:-1]))
        score = (size * shares[best] + 1) / (size + len(self.names))
        order = sorted(np.flatnonzero(shares[:-1]).tolist(), key=lambda i: (-shares[i], i))
        chosen = [{"lang": self.names[i], "share": float(shares[i])} for i in order]
        return self.names[best], float(score), float(shares[-1]), chosen


def mixture(times: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the components by expectation-maximisation, and the log-likelihood."""
    shares = np.full(chance.shape[1], 1 / chance.shape[1])
    total = times.sum()
    for _ in range(STEPS):
        before = shares
        shares = shares * ((times / (chance @ shares)) @ chance) / total
        if np.abs(shares - before).max() < 1e-3:
            break
    return shares, float(times @ np.log(chance @ shares))


def choose(times: np.ndarray, chance: np.ndarray, size: float) -> np.ndarray:
    """Shares under the set of components whose penalised likelihood is best."""
    n = chance.shape[1]
    price = 0.5 * np.log(max(size, 2.0)) + np.log(n)
    single = times @ np.log(chance)
    result = np.zeros(n)
    result[int(np.argmax(single))] = 1.0
    value = single.max() / OVERLAP
    shares, likelihood = mixture(times, chance)
    if likelihood / OVERLAP - value <= price:
        return result  # no set can gain more than all components together
    active = np.flatnonzero(shares > 1e-3)
    while len(active) > 1:
        shares, likelihood = mixture(times, chance[:, active])
        gained = likelihood / OVERLAP - price * (len(active) - 1)
        if gained > value:
            value, result = gained, np.zeros(n)
            result[active] = shares
        active = np.delete(active, int(np.argmin(shares)))
    return result


def learn(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """From ``doc_id, text, lang``: a sample by a hash of the row, about so many of each language."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {
        r.lang: r.n
        for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    }
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    names = sorted(sizes)
    if not names:
        return Model([], np.zeros((0, BUCKETS)))
    place = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30))
    limits = F.create_map(
        *[
            F.lit(x)
            for name in names
            for x in (name, int(min(1.0, docs_per_language / sizes[name]) * (1 << 30)))
        ]
    )
    sample = rows.where(place < limits[F.col("lang")]).select("lang", "text")
    number = {name: i for i, name in enumerate(names)}

    def count(batch):
        totals = np.zeros((len(names), BUCKETS), np.int64)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            buckets, times = counted(trigrams(text))
            totals[number[lang], buckets] += times
        lang, bucket = np.nonzero(totals)
        return {"lang": lang, "bucket": bucket, "n": totals[lang, bucket]}

    counts_of = arrow_map(sample, count, "lang int, bucket int, n bigint", rows=1 << 20)
    summed = counts_of.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = summed.toArrow()  # at most BUCKETS rows for each language
    counts = np.zeros((len(names), BUCKETS), np.uint32)
    for part in table.to_batches():
        at = part.column("lang").to_numpy(), part.column("bucket").to_numpy()
        counts[at] = np.minimum(part.column("n").to_numpy(), np.iinfo(np.uint32).max)
    return Model(names, counts)


def languages(
    documents: DataFrame, model: Model, *extra: Column, shares: bool = False
) -> DataFrame:
    """``doc_id``, the extra columns, ``lang_pred, score, noise`` of every text.

    With ``shares`` also ``languages``: the set of languages chosen, each with its share of the
    text, largest first; empty where ``lang_pred`` is ``und`` or all is noise.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("bigint"), whole_text().alias("text"), *extra)
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batch):
        found = [shared.value.infer(t) for t in batch.column("text").to_pylist()]
        return {f.name: batch.column(f.name) for f in kept} | {
            "lang_pred": [x[0] for x in found],
            "score": [x[1] for x in found],
            "noise": [x[2] for x in found],
            "languages": [x[3] for x in found],
        }

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    every = ", languages array<struct<lang:string,share:double>>" if shares else ""
    return arrow_map(rows, run, f"{names}, lang_pred string, score double, noise double{every}")


def recognised(documents: DataFrame, model: Model, noise: float) -> DataFrame:
    """The rows with a language, no larger share of which than ``noise`` fits none."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def test(text: str) -> bool:
        name, _, share = shared.value.predict(text)
        return name != UNKNOWN and share <= noise

    return rows_where(documents, test)
