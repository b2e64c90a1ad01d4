"""Toxicity by compression distance.

Two zstandard dictionaries are trained. Both hold the commonest words of ordinary texts; the
toxic one also holds starts of words that toxic texts have far more often, with their commonest
endings. A text is cut into windows at white space, each is compressed with either dictionary,
and the bytes the toxic one saves are compared with thresholds calibrated on labelled texts that
did not train the dictionaries used (two folds). Saved bytes of all windows, and the largest,
give the score by a logistic curve.

Contract: null and empty texts have no windows and the score of a text that saves nothing.
Labels that are null, or not 0 or 1, teach nothing. With one class only in the labels, every
score is the share of label 1 (0 without labels). Whole texts are used; repeated rows give
repeated rows; extra columns are ignored; an empty table gives no rows. The labelled sample is
bounded before it is collected: by ``DOCS_PER_LABEL`` ids, an expected size, one text of each id and
label, no longer than ``LONGEST_SAMPLED``, and ``SAMPLE_CHARS`` of texts for each label. Everything
else covers all rows.

Dictionaries trained on whole windows (zstandard's own training, or segments that cover what the
windows of one class have more often) were tried in place of starts of words and found fewer toxic
texts with more false alarms; the README has the figures.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import arrow_map, rows_where, whole_text, written

DOCS_PER_LABEL = 1500
SAMPLE_CHARS = 16 << 20
LONGEST_SAMPLED = 1 << 20  # characters; longer texts are scored whole, but teach nothing
WINDOW = 48  # bytes, then up to the next blank
HEAD = 6  # bytes of a word that are told from the inside of other words
SHORTEST, LONGEST = 4, 12  # bytes of a start of a word
ODDS = 20.0  # how many times likelier it must be in toxic texts
SURE = 25.0  # log-likelihood that this is no chance, for a Poisson count
ENDINGS = 40  # of a start that the dictionary holds
FOLDS = 2
COMMON_BYTES, TOXIC_BYTES = 6 << 10, 10 << 10
LEVEL = 5
FALSE_ALARM = 3.0
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def view(text: str) -> bytes:
    """Lower-case bytes, but the first HEAD of each word as capitals.

    So the start of a word never matches the inside of another.
    """
    data = np.frombuffer(text.lower().encode(), np.uint8)
    if not len(data):
        return b""
    letter = _LETTER[data]
    at = np.arange(len(data), dtype=np.int32)
    first = np.maximum.accumulate(np.where(letter, -1, at))  # the last byte that is no letter
    small = (at - first <= HEAD) & (data >= 97) & (data <= 122)
    return (data - (small * np.uint8(32))).tobytes()


def windows(data: bytes) -> list[bytes]:
    """Pieces cut at blanks where there are any."""
    out, at = [], 0
    while at < len(data):
        stop = data.find(b" ", at + WINDOW, at + 2 * WINDOW)
        stop = min(at + 2 * WINDOW, len(data)) if stop < 0 else stop
        out.append(data[at:stop])
        at = stop
    return out


_WORD = re.compile(rb"[A-Za-z\x80-\xff]+")


def starts(texts: list[bytes]) -> tuple[Counter, int]:
    """How often each start of a word occurs, and how many words there are.

    A word with the word after it counts once in all texts, so that copies add nothing.
    """
    pairs = set()
    for text in texts:
        words = _WORD.findall(text)
        pairs.update(zip(words, [*words[1:], b""]))
    words = Counter(word for word, _ in pairs)
    times: Counter = Counter()
    for word, n in words.items():
        for size in range(SHORTEST, min(len(word), LONGEST) + 1):
            times[word[:size]] += n
    return times, len(pairs)


def stems(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Starts of words that toxic texts have far more often, best first; none begins another."""
    times, n_toxic = starts(toxic)
    base, n_ordinary = starts(ordinary)
    found = {}
    for stem, n in times.items():
        expected = (base[stem] + 0.5) * n_toxic / max(1, n_ordinary)
        sure = n * math.log(n / expected) - (n - expected) if n > expected else 0.0
        if n >= ODDS * expected and sure >= SURE:
            found[stem] = sure
    chosen: list[bytes] = []
    for stem in sorted(found, key=lambda x: (-found[x], -len(x), x)):
        # As long as nearly all words that begin so go on alike.
        longer = [x for x in found if x.startswith(stem) and times[x] >= 0.9 * times[stem]]
        stem = max(longer, key=lambda x: (len(x), x))
        if not any(stem.startswith(x) or x.startswith(stem) for x in chosen):
            chosen.append(stem)
    # With what follows, as far as it cannot match the inside of a word: longer matches save more.
    out = []
    ratio = ODDS * n_toxic / max(1, n_ordinary)
    for stem in chosen:
        on = [x for x in times if len(x) == HEAD + 2 and x.startswith(stem) and times[x] > 1]
        on = [x for x in on if times[x] >= ratio * (base[x] + 0.5)]
        out += sorted(on, key=lambda x: (-times[x], x))[:ENDINGS] or [stem]
    return out


def common_words(texts: list[bytes]) -> list[bytes]:
    times: Counter = Counter()
    for text in texts:
        times.update(set(text.split()))
    return sorted(times, key=lambda w: (-times[w], w))


def dictionary(words: list[bytes], size: int) -> bytes:
    """The first words that fit, the best ones last: zstandard finds those with fewest bits."""
    content, held = [], 0
    for word in words:
        if held + len(word) + 1 > size:
            break
        content.append(word)
        held += len(word) + 1
    return b" " + b" ".join(reversed(content)) + b" "


class Compressors:
    """The two dictionaries, ready for use; they are made again in each process."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.contents = (toxic, ordinary)
        self._ready = None

    def __getstate__(self):
        return self.contents

    def __setstate__(self, state):
        self.contents, self._ready = state, None

    def saved(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves, by window."""
        if self._ready is None:
            self._ready = []
            for content in self.contents:
                given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters.from_level(
                    LEVEL, source_size=2 * WINDOW, dict_size=len(content), min_match=4,
                    write_content_size=False, write_checksum=False, write_dict_id=False,
                )
                given.precompute_compress(compression_params=how)
                self._ready.append(
                    zstandard.ZstdCompressor(dict_data=given, compression_params=how).compress
                )
        toxic, ordinary = self._ready
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(view(text))], float)


def evidence(saved: np.ndarray, threshold: float) -> np.ndarray:
    """Of a text: windows that save enough, how much they and the best one save, each dampened."""
    over = saved[saved >= threshold]
    best = saved.max() if len(saved) else 0.0
    return np.array(
        [
            1.0,
            np.log1p(over.sum()),
            max(best, 0.0) / 8,
            np.log1p(over.sum() / max(1, len(saved))),
            float(len(over) > 0),
        ]
    )


def fit(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; label 0 weighs FALSE_ALARM times label 1 in all."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 * FALSE_ALARM / max(1, (1 - y).sum()))
    weight *= len(y)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w


def trained(views: list[bytes], y: np.ndarray, use: np.ndarray) -> Compressors:
    """Dictionaries of the texts to use."""
    toxic, ordinary = ([v for v, a, u in zip(views, y, use) if a == label and u] for label in (1, 0))
    usual = dictionary(common_words(ordinary), COMMON_BYTES)
    own = dictionary(stems(toxic, ordinary), TOXIC_BYTES)
    # Filled up to the same length, so that common words cost the same with either.
    return Compressors(usual + own, usual + bytes([1]) * len(own))


class Model:
    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.share = float(toxic.mean()) if len(toxic) else 0.0
        self.compressors = None
        if not 0 < self.share < 1:
            return
        # Texts come in no order. Each fold is calibrated with dictionaries of the others.
        y = np.asarray(toxic, float)
        views = [view(t) for t in texts]
        fold = np.zeros(len(texts), int)
        for label in (0, 1):
            fold[y == label] = np.arange(int((y == label).sum())) % FOLDS
        saved: list[np.ndarray] = [np.empty(0)] * len(texts)
        for part in range(FOLDS):
            rest = fold != part
            if not 0 < y[rest].sum() < rest.sum():
                rest[:] = True
            own = trained(views, y, rest)
            for i in np.flatnonzero(fold == part):
                saved[i] = own.saved(texts[i])
        self.compressors = trained(views, y, np.ones(len(texts), bool))
        best = None
        for threshold in range(1, 13):
            x = np.array([evidence(s, threshold) for s in saved])
            w = fit(x, y)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            loss = -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1))
            value = loss[y == 1].mean() + FALSE_ALARM * loss[y == 0].mean()
            if best is None or value < best[0]:
                best = value, threshold, w
        _, self.threshold, self.weights = best

    def score(self, text: str) -> float:
        if self.compressors is None:
            return self.share
        x = evidence(self.compressors.saved(text), self.threshold) @ self.weights
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def learn(documents: DataFrame, labels: DataFrame, docs_per_label: int = DOCS_PER_LABEL) -> Model:
    """From documents and ``doc_id, toxic``: a sample by a hash of the id for each label."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("of"), F.col("toxic").cast("int")
    )
    sizes = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("of"), F.lit(1 << 30))
    limits = {k: int(min(1.0, docs_per_label / n) * (1 << 30)) for k, n in sizes.items()}
    limit = F.when(F.col("toxic") == 1, limits.get(1, 0)).otherwise(limits.get(0, 0))
    # Written, so that Spark sees how small it is and leaves the documents where they are.
    sample = written(marks.where(place < limit))
    texts = documents.where(F.col("text").isNotNull() & (F.length("text") <= LONGEST_SAMPLED)).select(
        F.col("doc_id").cast("bigint").alias("id"), "text"
    )
    # One text for each id and label, so that no more rows are sorted than ids are sampled.
    rows = texts.join(sample, F.col("id") == F.col("of")).groupBy("of", "toxic").agg(F.min("text").alias("text"))
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("of"), "of").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("total", F.sum(F.length("text")).over(before)).where(F.col("total") <= SAMPLE_CHARS)
    found = rows.select("of", "toxic", "text").toArrow().to_pylist()  # 2 * SAMPLE_CHARS at most
    found.sort(key=lambda r: (hash_of(r["of"]), r["toxic"]))
    return Model([r["text"] for r in found], np.array([r["toxic"] for r in found]))


def hash_of(number: int) -> int:
    return (number * 0x9E3779B97F4A7C15 >> 7) & 0xFFFFFFFF


def toxicity(documents: DataFrame, model: Model, *extra: Column) -> DataFrame:
    """``doc_id``, the extra columns, ``score, predicted`` of every text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("bigint"), whole_text().alias("text"), *extra)
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batch):
        score = [shared.value.score(t) for t in batch.column("text").to_pylist()]
        return {f.name: batch.column(f.name) for f in kept} | {"score": score}

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return arrow_map(rows, run, f"{names}, score double").withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def harmless(documents: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows whose score is below ``most``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return rows_where(documents, lambda text: shared.value.score(text) < most)
