"""Packing of token ids into sequences, in the order of the documents.

Each task takes its documents in the order they are read, a few million ids at a time, and
chooses where to cut by dynamic programming. Places to cut are ends of documents (free),
ends of sentences (a small penalty) and, where no such end lies near the end of a full
window, the full window (a larger penalty). Padding counts one for each id; a sequence whose
length is a power of two has none. The best cut before a place is the least of a sliding
window of places, kept in a monotone queue, as padding is linear in the distance.

Contract: null texts count as empty, and empty ones hold the end id alone; repeated rows are
packed each; extra columns are ignored; an empty table gives no rows; a text of any length is
cut into as many sequences as it takes. Sequence numbers are unique, not gapless.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import parts, whole_text
from tallyfold.llm.words import encoder, library

WINDOW = 1024
PIECE_IDS = 1 << 21  # ids that are cut together; only the last sequence of them is cut short
SEQUENCE, SENTENCE, FORCED = 8.0, 0.25, 24.0  # costs, in padded ids
SHORTEST = 64  # sequences of a power of two below it are not aimed at

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


@lru_cache(maxsize=4)
def sentence_ends(path: str) -> np.ndarray:
    """By id, whether its text ends a sentence or a line."""
    tokenizer = library(path)
    size = max(tokenizer.get_vocab().values()) + 1
    return np.fromiter(
        ((tokenizer.decode([i]) or " ")[-1] in ".!?\n。" for i in range(size)), bool, size
    )


def cuts(ends: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> list[int]:
    """Chosen ends of sequences. ``ends`` ascend, the last one is the end of all ids."""
    total = int(ends[-1])
    small = [1 << k for k in range(SHORTEST.bit_length() - 1, window.bit_length() - 1)]
    places, before, best = [0], [-1], [0.0]
    at_place = {0: 0}
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (best + place, index)
    forced: deque[int] = deque()
    reach = 0  # the furthest end within a window of the place at hand
    ends_list, costs_list = ends.tolist(), costs.tolist()
    n, i = len(ends_list), 0

    def force(place: int) -> None:
        nonlocal reach
        while reach < n and ends_list[reach] <= place + window:
            reach += 1
        nearest = ends_list[reach - 1] if reach else 0
        if nearest <= place + window - FORCED and place + window < total:
            forced.append(place + window)

    force(0)
    while i < n or forced:
        if forced and (i >= n or forced[0] < ends_list[i]):
            place, cost = forced.popleft(), FORCED
            if place in at_place:
                continue
        else:
            place, cost = ends_list[i], costs_list[i]
            i += 1
            if forced and forced[0] == place:
                forced.popleft()
        while queue and places[queue[0][1]] < place - window:
            queue.popleft()
        if not queue:
            continue  # nothing chosen so far reaches here; a forced place does
        low, via = queue[0]
        value = low + window - place
        for size in small:
            j = at_place.get(place - size)
            if j is not None and best[j] < value:
                value, via = best[j], j
        value += SEQUENCE + cost
        index = len(places)
        places.append(place)
        before.append(via)
        best.append(value)
        at_place[place] = index
        key = value + place
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, index))
        force(place)
    chosen, j = [], at_place[total]
    while j > 0:
        chosen.append(places[j])
        j = before[j]
    return chosen[::-1]


def pieces(docs: list, ids: list[np.ndarray], is_end: np.ndarray, sequence: int) -> dict:
    """Columns of the pieces of whole documents, which are cut together."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids).astype("<u4")
    doc_ends = np.cumsum(lengths)
    cost = np.full(len(flat) + 1, -1.0)
    cost[np.flatnonzero(is_end[flat]) + 1] = SENTENCE
    cost[doc_ends] = 0.0
    ends = np.flatnonzero(cost >= 0)
    chosen = np.array(cuts(ends, cost[ends]))
    borders = np.union1d(doc_ends, chosen)
    begins = np.concatenate([[0], borders[:-1]])
    doc = np.searchsorted(doc_ends, begins, side="right")
    own = np.searchsorted(chosen, begins, side="right")
    first = np.concatenate([[0], chosen])[own]
    data = memoryview(flat.tobytes())
    return {
        "doc_id": pa.array([docs[d] for d in doc.tolist()], pa.int64()),
        "start": pa.array(begins - (doc_ends - lengths)[doc]),
        "length": pa.array(borders - begins),
        "ids_crc32": pa.array(
            [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), borders.tolist())],
            pa.int64(),
        ),
        "doc_tokens": pa.array(lengths[doc]),
        "sequence_id": pa.array(own + sequence),
        "offset": pa.array(begins - first),
    }


def packed(documents: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """The pieces of every document: where each lies in its document and in its sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, is_end = encoder(path), sentence_ends(path)
        sequence = TaskContext.get().partitionId() << 40
        docs: list = []
        ids: list[np.ndarray] = []
        held = 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(pieces(docs, ids, is_end, sequence))

        for batch in (part for whole in batches for part in parts(whole)):
            names = batch.column("doc_id").to_pylist()
            for rows, flat, lengths in own.batches(batch.column("text").to_pylist()):
                for doc, run_ids in zip(names[rows], np.split(flat, np.cumsum(lengths)[:-1])):
                    docs.append(doc)
                    ids.append(np.append(run_ids, end_id))
                    held += len(ids[-1])
                    if held >= PIECE_IDS:
                        out = full()
                        yield out
                        sequence = out.column("sequence_id")[-1].as_py() + 1
                        docs, ids, held = [], [], 0
        if docs:
            yield full()

    rows = documents.select(F.col("doc_id").cast("bigint"), whole_text().alias("text"))
    return rows.mapInArrow(run, PIECES)
