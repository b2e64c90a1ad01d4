"""Ranked lexical search in a K2-treap over the grid of terms and documents.

The index is made of shards: runs of documents, each with its own grid. Columns are the shard's
documents in order of doc_id, rows its terms, those of most documents first. The grid is a column
of square tiles, as wide as there are documents (rounded up to a power of two), and each tile is a
quadtree: a cell that holds anything keeps the largest impact inside it and four bits that say which
of its quarters hold anything. Cells are numbered level by level, so that children need no pointers:
they stand one after the other in the order of their parents, and counting bits finds them. Maxima
are kept as differences from the parent's, which are mostly zero, and compressed.

An item descends in a shard for all its terms at once. A state is a range of documents with the cell
of each term's row above that range; its bound adds up the maxima of those cells by weight. States
are taken best first, several at a time, and cut in half, until the range is one document: its cells
are the impacts themselves and the bound is the exact score. States that cannot come before the k-th
document found so far are dropped, and what was found in earlier shards of a task counts as well.

Scores: with N documents that hold a term, L terms in all, n of a document, df documents of a term
and tf occurrences, the weight of a term is floor(1000 * ln((2N + 2) / (2df + 1))), a document's m
is 75 + (25 * n * N) div L, the impact is (10**9 * tf) div (1000 * tf + 12 * m), and the score adds
up weight times impact over the item's terms, repeats included.

Contract: terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z as a-z. A
null text holds none. Rows without doc_id take no part, nor in N, L and df; each other row is a
document of its own. Items without an id are left out, equal items are one, and items that share an
id and not the text are ranked each by itself. Items without a term, or whose terms no document
holds, give no rows. Ties go to the smaller doc_id. Texts are read whole, CHARS bytes at a time. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import parts, whole_text, written

SHARD_DOCS, SHARD_CELLS = 4096, 1 << 20  # a shard ends at either; one document is never split
CHARS = 1 << 22  # of a text that are cut into terms at a time
BLOCK_CHARS = 4 << 20  # of items searched for together
STATES = 64  # taken at once
CELL_BITS = 20  # an impact is below 10**6

INDEX = (
    "shard bigint, n_docs int, doc_ids binary, terms binary, dfs binary, n_strips int, depth int, "
    "cells binary, masks binary, drops binary"
)

_TERM = bytearray(b" " * 256)
_TERM[0x30:0x3A] = range(0x30, 0x3A)
_TERM[0x41:0x5B] = range(0x61, 0x7B)
_TERM[0x61:0x7B] = range(0x61, 0x7B)
_TERM[0x80:] = range(0x80, 0x100)
_TERM = bytes(_TERM)
_SIDES = np.arange(2)[:, None, None]


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    at = 0
    while at < len(text):
        part = text[at : at + CHARS].translate(_TERM)
        if at + CHARS < len(text):
            stop = part.rfind(b" ")
            while stop < 0:  # one term, so far
                more = text[at + len(part) : at + len(part) + CHARS].translate(_TERM)
                part += more
                stop = part.rfind(b" ") if more else len(part)
            part = part[: stop + 1]
        yield part.split()
        at += len(part)


def sizes(documents: DataFrame) -> tuple[int, int]:
    """N and L: how many documents hold a term, and how many terms all of them hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                n = sum(map(len, terms(text)))
                docs += n > 0
                total += n
        yield pa.RecordBatch.from_pydict({"docs": [docs], "total": [total]})

    counted = documents.where("doc_id is not null").select(whole_text().alias("text"))
    row = counted.mapInArrow(run, "docs bigint, total bigint").agg(F.sum("docs"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2**31 at every other place."""
    x = x.astype(np.uint64)
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333), (1, 0x5555555555555555),
    ):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def squeezed(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers))


def numbers(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def built(row: np.ndarray, column: np.ndarray, impact: np.ndarray, n_rows: int, n_columns: int) -> dict:
    """The quadtrees of a grid: levels from the tiles down, without the places of cells."""
    depth = max(1, (n_columns - 1).bit_length())
    low = row & ((1 << depth) - 1)
    place = (row.astype(np.uint64) >> np.uint64(depth)) << np.uint64(2 * depth)
    place |= spread(low) << np.uint64(1) | spread(column)
    # Places and impacts are sorted as one number.
    cells = np.sort(place << np.uint64(CELL_BITS) | impact.astype(np.uint64))
    most = (cells & np.uint64((1 << CELL_BITS) - 1)).astype(np.uint32)
    place = cells >> np.uint64(CELL_BITS)
    masks, drops = [], []
    for _ in range(depth):
        parent = place >> np.uint64(2)
        new = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        above = np.maximum.reduceat(most, new)
        quarter = np.uint8(1) << (place & np.uint64(3)).astype(np.uint8)
        masks.append(np.bitwise_or.reduceat(quarter, new))
        drops.append(np.repeat(above, np.diff(np.append(new, len(place)))) - most)
        place, most = parent[new], above
    return {
        "n_strips": len(place),
        "depth": depth,
        "cells": squeezed(most),
        "masks": squeezed(np.concatenate(masks[::-1])),
        "drops": squeezed(np.concatenate(drops[::-1])),
    }


class Treap:
    """A shard, ready to be searched."""

    def __init__(self, row: dict):
        self.doc_ids = np.frombuffer(row["doc_ids"], "<i8")
        self.depth, strips = row["depth"], row["n_strips"]
        masks = numbers(row["masks"], np.uint8)
        count = np.bitwise_count(masks)
        ends = np.cumsum(count, dtype=np.int64)
        # Of each cell: the number of its first child, and four bits. The last one stands for empty cells.
        self.children = np.append((strips + ends - count) << 4 | masks, 0)
        drops = numbers(row["drops"], np.uint32)
        self.most = np.zeros(strips + len(drops) + 1, np.int64)
        self.most[:strips] = numbers(row["cells"], np.uint32)
        above, below = 0, strips  # where a level and the next begin
        while below < len(self.most) - 1:
            stop = strips + int(ends[below - 1])
            parents = np.repeat(self.most[above:below], count[above:below])
            self.most[below:stop] = parents - drops[below - strips : stop - strips]
            above, below = below, stop

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int, best: list[tuple[int, int]]) -> None:
        """Add this shard's documents to the k best (score, -doc_id), a heap."""
        cell = rows >> self.depth
        bound = int(self.most[cell] @ weights)
        # States: -bound, the smallest doc_id, first column, level, cell of each row (-1: empty).
        states = [(-bound, int(self.doc_ids[0]), 0, 0, cell)]
        while states:
            taken = []
            while states and len(taken) < STATES:
                state = heapq.heappop(states)
                if len(best) == k and (-state[0], -state[1]) < best[0]:
                    states = []  # nor can any other
                    break
                if state[3] < self.depth:
                    taken.append(state)
                elif len(best) < k:
                    heapq.heappush(best, (-state[0], -state[1]))
                else:
                    heapq.heappushpop(best, (-state[0], -state[1]))
            if not taken:
                continue
            half = self.depth - 1 - np.array([s[3] for s in taken])
            above = np.array([s[4] for s in taken])
            own = self.children[above]  # of an empty cell: no quarter
            # Quarters of the left half of the documents, then of the right one.
            quarter = 2 * ((rows >> half[:, None]) & 1) + _SIDES
            alive = (own >> quarter) & 1 == 1
            below = (own >> 4) + np.bitwise_count(own & ((1 << quarter) - 1))
            below[~alive] = -1
            bounds = self.most[below] @ weights
            for right in (0, 1):
                for s, b, h, cells in zip(taken, bounds[right].tolist(), half.tolist(), below[right]):
                    column = s[2] + (right << h)
                    if b and (len(best) < k or (b, -int(self.doc_ids[column])) >= best[0]):
                        heapq.heappush(states, (-b, int(self.doc_ids[column]), column, s[3] + 1, cells))


def index(documents: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The shards of the documents; N and L are those of the documents searched together."""

    def shard(number: int, ids: list[int], lengths: list[int], held: list[Counter]) -> dict:
        df: Counter = Counter()
        for counts in held:
            df.update(counts.keys())
        order = sorted(df, key=lambda t: (-df[t], t))
        name = {t: i for i, t in enumerate(order)}
        by_id = sorted(range(len(ids)), key=ids.__getitem__)
        distinct = np.fromiter((len(held[i]) for i in by_id), np.int64, len(ids))
        row = np.fromiter((name[t] for i in by_id for t in held[i]), np.int64, int(distinct.sum()))
        tf = np.fromiter((x for i in by_id for x in held[i].values()), np.int64, len(row))
        m = np.array([75 + 25 * lengths[i] * n_docs // n_terms for i in by_id], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, distinct))
        return {
            "shard": number,
            "n_docs": len(ids),
            "doc_ids": np.array([ids[i] for i in by_id], "<i8").tobytes(),
            "terms": zstandard.ZstdCompressor(level=1).compress(b" ".join(order)),
            "dfs": squeezed(np.array([df[t] for t in order], np.uint32)),
        } | built(row, np.repeat(np.arange(len(ids)), distinct), impact, len(order), len(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cells = TaskContext.get().partitionId() << 32, 0
        ids, lengths, held = [], [], []
        for batch in (part for whole in batches for part in parts(whole)):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                counts: Counter = Counter()
                for some in terms(text):
                    counts.update(some)
                if not counts:
                    continue
                ids.append(doc)
                lengths.append(counts.total())
                held.append(counts)
                cells += len(counts)
                if len(ids) == SHARD_DOCS or cells >= SHARD_CELLS:
                    yield pa.RecordBatch.from_pylist([shard(number, ids, lengths, held)], schema=schema)
                    number, cells, ids, lengths, held = number + 1, 0, [], [], []
        if ids:
            yield pa.RecordBatch.from_pylist([shard(number, ids, lengths, held)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(INDEX))
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), whole_text().alias("text"))
    return rows.mapInArrow(run, INDEX)


def rows_of(row: dict, wanted: set[bytes] | dict[bytes, int]) -> dict[bytes, int]:
    """The rows of some terms in a shard."""
    own = zstandard.ZstdDecompressor().decompress(row["terms"]).split(b" ")
    return {t: i for i, t in enumerate(own) if t in wanted}


def document_counts(shards: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """df of the terms of one block of items, from the terms of all shards."""
    shared = shards.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                df = numbers(row["dfs"], np.uint32)
                for term, place in rows_of(row, shared.value).items():
                    total[term] += int(df[place])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(total.values(), pa.int64())], names=["term", "df"]
        )

    counted = shards.select("terms", "dfs").mapInArrow(run, "term binary, df bigint")
    summed = counted.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    return dict(zip(summed["term"].to_pylist(), summed["df"].to_pylist()))


def blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """``item_id, text`` of the distinct items, about BLOCK_CHARS of text at a time."""
    rows = written(
        items.where("item_id is not null and text is not null")
        .select(F.col("item_id").cast("bigint"), "text")
        .distinct()
        .withColumn("at", F.xxhash64("item_id", "text"))
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for block in range(n):
        own = rows.where(F.pmod("at", F.lit(n)) == block).toArrow()
        yield list(zip(own["item_id"].to_pylist(), own["text"].cast(pa.binary()).to_pylist()))


def search(shards: DataFrame, items: DataFrame, n_docs: int, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents with the highest scores above 0."""
    session = shards.sparkSession
    found = None
    for block in blocks(items):
        asked = [(item, Counter(t for some in terms(text) for t in some)) for item, text in block]
        df = document_counts(shards, {t for _, counts in asked for t in counts})
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        shared = session.sparkContext.broadcast((asked, weight))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, weight = shared.value
            best: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    treap, place = Treap(row), rows_of(row, weight)
                    for item, (_, counts) in enumerate(asked):
                        own = [t for t in counts if t in place]
                        if own:
                            rows = np.array([place[t] for t in own], np.int64)
                            treap.search(rows, np.array([weight[t] * counts[t] for t in own]), k, best[item])
            flat = [(item, doc, score) for item, heap in best.items() for score, doc in heap]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([item for item, _, _ in flat], pa.int32()),
                    pa.array([asked[item][0] for item, _, _ in flat], pa.int64()),
                    pa.array([-doc for _, doc, _ in flat], pa.int64()),
                    pa.array([score for _, _, score in flat], pa.int64()),
                ],
                names=["item", "item_id", "doc_id", "score"],
            )

        rows = shards.mapInArrow(run, "item int, item_id bigint, doc_id bigint, score bigint")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return session.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(documents: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Index the documents in a shared folder and search it."""
    n_docs, n_terms = sizes(documents)
    return search(written(index(documents, n_docs, n_terms)), items, n_docs, k)
