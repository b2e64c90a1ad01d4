"""Hard negatives by Four-Russians scoring.

Vectors become whole numbers, floor(scale * x), kept as bit planes in two's complement: of each
plane, eight components make one byte. For every eight components of an anchor a table holds the
sums of all 256 subsets. A byte of a candidate's plane picks the sum of those anchor components
whose bit is set, so a score is one lookup for each plane and eight components, added up from the
sign's plane (which counts negative) down, doubling in between. Scores are whole inner products,
exact in 64 bits.

Anchors are dealt into blocks and candidates into parts; a block meets a part in one tile, in
which the anchors are held and the candidates pass by as packed planes. The first pass finds each
anchor's positives, its best rows of the same label. The second finds for each score of a positive
the best rows of other labels between ``least`` and ``most`` percent of it. A tile keeps as many
rows of each anchor, or of each of its positives, as are wanted in the end, and those are merged.

Contract: rows take no part whose vec_id, label or vector is null, whose vector holds a null or a
non-finite number, a component of 2**24 or more once scaled, or more than 2**14 components (the
last two keep scores within 64 bits). Vectors of different lengths are not compared; empty ones
have a score of 0 with each other. Rows of the anchor's own vec_id are never its positives or
negatives; apart from that each repeated row counts for itself, while equal anchors are one. Ties
go to the smaller vec_id. Anchors without a positive, and positives without a negative, give no
rows. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import written

SCALE = 256
GROUP = 8  # components that share a table, and a byte
LARGEST, LONGEST = 1 << 24, 1 << 14  # of a scaled component, of a vector
BLOCK_ANCHORS = 16384  # of a block at most; BLOCK_BYTES may make it fewer
BLOCK_BYTES = 32 << 20
PARTS = 8  # of the candidates, at least
PART_ROWS = 1 << 20  # of a part, about; more candidates make more parts
TILE_ROWS, TABLE_BYTES = 1024, 4 << 20  # scored at once
MOST_TASKS = 1 << 15
HELD = 8  # times the rows wanted are held of a block before they are thinned out

PACKED = "dim int, vec_id bigint, label bigint, planes binary"
FOUND = "anchor_id bigint, anchor_key bigint, bar bigint, vec_id bigint, score bigint"


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, embedding`` (doubles) of the rows that take part."""
    rows = vectors.select(
        F.col("vec_id").cast("bigint"),
        F.col("label").cast("bigint"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    # NaN is larger than any number; a null is no answer and counts as odd.
    odd = F.exists("embedding", lambda x: F.coalesce(F.abs(x) * scale >= LARGEST, F.lit(True)))
    return rows.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~odd & (F.size("embedding") <= LONGEST)
    )


def n_planes(rows: DataFrame, scale: int = SCALE) -> tuple[int, int, int]:
    """Bits that hold every scaled component with its sign, how many rows, and the longest vector."""
    size = F.greatest(F.abs(F.array_max("embedding")), F.abs(F.array_min("embedding")))
    most, n, longest = rows.agg(
        F.max(F.ceil(size * scale)), F.count(F.lit(1)), F.max(F.size("embedding"))
    ).first()
    return int(most or 0).bit_length() + 1, n, longest or 0


def planes_of(codes: np.ndarray, planes: int) -> np.ndarray:
    """Bytes of whole numbers, by row, plane and group; the lowest plane first."""
    groups = -(-codes.shape[1] // GROUP)
    wide = np.zeros((len(codes), groups * GROUP), np.int64)
    wide[:, : codes.shape[1]] = codes
    bits = np.stack([(wide >> b) & 1 for b in range(planes)], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little")


def codes_of(planes: np.ndarray) -> np.ndarray:
    """The whole numbers again, with zeros up to a whole group."""
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(np.int64)
    weight = np.int64(1) << np.arange(planes.shape[1], dtype=np.int64)
    weight[-1] = -weight[-1]
    return np.einsum("rpd,p->rd", bits, weight)


def packed(rows: DataFrame, planes: int, scale: int = SCALE) -> DataFrame:
    """``dim, vec_id, label, planes`` of usable rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            flat = np.floor(vectors.flatten().to_numpy() * scale).astype(np.int64)
            sizes = np.diff(vectors.offsets.to_numpy())
            ends = np.cumsum(sizes)
            out: list[bytes] = [b""] * batch.num_rows
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                codes = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                for i, row in zip(at.tolist(), planes_of(codes, planes)):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes, pa.int32()), batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())],
                names=["dim", "vec_id", "label", "planes"],
            )

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, PACKED)


def tables(codes: np.ndarray, dtype: type) -> np.ndarray:
    """Sums of all subsets of each eight components, by group, subset and anchor."""
    by_place = codes.reshape(len(codes), -1, GROUP).transpose(1, 2, 0).astype(dtype)
    sums = np.zeros((by_place.shape[0], 1 << GROUP, len(codes)), dtype)
    for place in range(GROUP):
        half = 1 << place
        sums[:, half : 2 * half] = sums[:, :half] + by_place[:, place, None, :]
    return sums


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products by row of ``planes`` and anchor of the tables."""
    total = np.zeros((len(planes), sums.shape[2]), sums.dtype)
    for b in reversed(range(planes.shape[1])):
        total <<= 1
        for g in range(sums.shape[0]):
            part = sums[g].take(planes[:, b, g], axis=0)
            if b == planes.shape[1] - 1:
                total -= part
            else:
                total += part
    return total


def first_of(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each slot, best first."""
    order = np.lexsort((ids, -score, slot))
    begins = np.flatnonzero(np.diff(slot[order], prepend=-1))
    sizes = np.diff(np.append(begins, len(order)))
    return order[np.arange(len(order)) - np.repeat(begins, sizes) < k]


class Block:
    """Some anchors, and the best rows found of each slot: an anchor, or one with a positive's score."""

    def __init__(self, anchors: pa.Table, planes: int, k: int, least: int, most: int):
        self.k, self.least, self.most = k, least, most
        self.ids, self.keys, self.labels = (anchors[c].to_numpy() for c in ("vec_id", "anchor_key", "label"))
        dim = anchors["dim"][0].as_py()
        self.shape = (-1, planes, -(-dim // GROUP))
        self.codes = codes_of(self.unpacked(anchors["planes"])) if dim else np.zeros((len(self.ids), 0), np.int64)
        bound = dim << 2 * (planes - 1)
        self.dtype = np.int32 if bound < 1 << 30 else np.int64
        bars = anchors["bars"].combine_chunks()
        if bars.null_count:
            self.anchor, self.bar = np.arange(len(self.ids)), None
        else:
            self.anchor = np.repeat(np.arange(len(self.ids)), np.diff(bars.offsets.to_numpy()))
            self.bar = bars.flatten().to_numpy()
        self.limit = np.full(len(self.anchor), np.iinfo(np.int64).min)  # the k-th best score, once there are k
        self.held = [(np.empty(0, np.int64),) * 3]
        self.size = 0

    def unpacked(self, column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(self.shape)

    def add(self, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray | None) -> None:
        """Score some candidates; no planes: vectors without components."""
        groups = self.codes.shape[1] // GROUP
        step = max(1, TABLE_BYTES // (max(1, groups) * (8 << GROUP)))
        for i in range(0, len(self.ids), step):
            near = slice(i, i + step)
            if planes is None:
                score = np.zeros((len(ids), len(self.ids[near])), np.int64)
            else:
                score = scores(tables(self.codes[near], self.dtype), planes)
            same = labels[:, None] == self.labels[None, near]
            slots = slice(*np.searchsorted(self.anchor, [i, i + step]))
            own = self.anchor[slots] - i
            fits = ids[:, None] != self.ids[None, near]
            if self.bar is None:
                fits &= same
            else:
                fits &= ~same
                score, fits, bar = score[:, own].astype(np.int64), fits[:, own], self.bar[slots]
                fits &= 100 * score <= self.most * bar
                fits &= 100 * score >= self.least * bar
            self.keep(slots, score, fits, ids)

    def keep(self, slots: slice, score: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        limit = self.limit[slots]
        fits &= score >= limit
        n = np.count_nonzero(fits)
        if n > 2 * self.k * len(limit) and len(ids) > self.k:
            low = np.where(fits, score, np.iinfo(score.dtype).min)
            limit = np.maximum(limit, np.partition(low, len(ids) - self.k, axis=0)[len(ids) - self.k])
            fits &= score >= limit
        row, slot = np.nonzero(fits)
        self.held.append((slot + slots.start, score[row, slot].astype(np.int64), ids[row]))
        self.size += len(row)
        if self.size > HELD * self.k * len(self.anchor):
            self.thin()

    def thin(self) -> None:
        slot, score, ids = (np.concatenate(x) for x in zip(*self.held))
        stay = first_of(slot, score, ids, self.k)
        slot, score, ids = slot[stay], score[stay], ids[stay]
        last = np.flatnonzero(np.bincount(slot, minlength=len(self.anchor)) == self.k)
        self.limit[last] = score[np.searchsorted(slot, last, side="right") - 1]
        self.held, self.size = [(slot, score, ids)], len(slot)

    def found(self) -> pa.RecordBatch:
        self.thin()
        slot, score, ids = self.held[0]
        of = self.anchor[slot]
        bar = score if self.bar is None else self.bar[slot]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (self.ids[of], self.keys[of], bar, ids, score)],
            names=["anchor_id", "anchor_key", "bar", "vec_id", "score"],
        )


def tiled(anchors: DataFrame, rows: DataFrame, n_rows: int, planes: int, longest: int, k: int, least: int, most: int) -> DataFrame:
    """The k best rows of each slot in every tile: same labels, or other ones where ``bars`` are given."""
    block = max(1, min(BLOCK_ANCHORS, BLOCK_BYTES // (8 * (longest or 1))))
    blocks = max(1, -(-anchors.count() // block))
    parts = max(PARTS, -(-n_rows // PART_ROWS))
    tile = ["dim", "anchor_block", "part"]

    def dealt(df: DataFrame, own: str, n: int, other: str, copies: int, kind: int) -> DataFrame:
        return df.select(
            "dim",
            F.pmod(F.xxhash64("vec_id", "planes"), F.lit(n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other),
            F.lit(kind).alias("kind"),
            *("vec_id", "label", "planes", "anchor_key", "bars"),
        )

    candidates = rows.withColumn("anchor_key", F.lit(0).cast("bigint")).withColumn(
        "bars", F.lit(None).cast("array<bigint>")
    )
    both = dealt(anchors, "anchor_block", blocks, "part", parts, 0).unionByName(
        dealt(candidates, "part", parts, "anchor_block", blocks, 1)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, asked, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in [*tile, "kind"]], axis=1)
            border = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for a, b in zip([0, *border.tolist()], [*border.tolist(), len(keys)]):
                here = tuple(keys[a, :3].tolist())
                if here != of:
                    if block is not None:
                        yield block.found()
                    of, asked, block = here, [], None
                part = batch.slice(a, b - a)
                if keys[a, 3] == 0:
                    asked.append(part)
                elif asked:
                    if block is None:
                        block = Block(pa.Table.from_batches(asked), planes, k, least, most)
                    for i in range(0, b - a, TILE_ROWS):
                        some = part.slice(i, TILE_ROWS)
                        ids, labels = some.column("vec_id").to_numpy(), some.column("label").to_numpy()
                        block.add(ids, labels, block.unpacked(some.column("planes")) if here[0] else None)
        if block is not None:
            yield block.found()

    # As many tasks as tiles: their rows are few bytes and much work.
    dealt_out = both.repartition(min(blocks * parts, MOST_TASKS), *tile)
    return dealt_out.sortWithinPartitions(*tile, "kind").mapInArrow(run, FOUND)


def best(found: DataFrame, k: int, *slot: str) -> DataFrame:
    """The k best rows of each slot over all tiles, with their ``rank``."""
    order = Window.partitionBy(*slot).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
    scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    rows, asked = usable(vectors, scale), usable(anchors, scale)
    planes, n_rows, longest = (max(x, y) for x, y in zip(n_planes(rows, scale), n_planes(asked, scale)))
    candidates = written(packed(rows, planes, scale))
    asked = written(
        packed(asked, planes, scale).distinct().withColumn("anchor_key", F.xxhash64("dim", "label", "planes"))
    )
    no_bars = F.lit(None).cast("array<bigint>").alias("bars")
    near = tiled(asked.select("*", no_bars), candidates, n_rows, planes, longest, positives, least, most)
    chosen = written(
        best(near, positives, "anchor_id", "anchor_key").select(
            "anchor_id", "anchor_key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        )
    )
    # At most as many scores as positives for each anchor.
    bars = chosen.groupBy("anchor_id", "anchor_key").agg(F.collect_set("positive_score").alias("bars"))
    barred = asked.join(
        bars.withColumnRenamed("anchor_key", "bar_key"),
        (F.col("vec_id") == F.col("anchor_id")) & (F.col("anchor_key") == F.col("bar_key")),
    ).select(*asked.columns, "bars")
    far = tiled(written(barred), candidates, n_rows, planes, longest, negatives, least, most)
    far = best(far, negatives, "anchor_id", "anchor_key", "bar").select(
        F.col("anchor_id").alias("of_id"),
        F.col("anchor_key").alias("of_key"),
        "bar",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    same = (
        (F.col("anchor_id") == F.col("of_id"))
        & (F.col("anchor_key") == F.col("of_key"))
        & (F.col("positive_score") == F.col("bar"))
    )
    return chosen.join(far, same).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
