"""Nearest neighbours by inner product: a block matrix join with error bounds.

Vectors are quantised to int8 once, and what that leaves over to int8 again. Queries are dealt into
blocks by a hash, as many as it takes, and candidates into parts of about PART_ROWS rows, PARTS of
them at least; what is dealt is codes, two bytes for each component, with the steps and lengths of
each vector. Each block meets each part in one tile: the queries are held, the candidates pass by.
First codes are multiplied (as whole numbers in float32, which is exact); the product of two differs
from the true inner product by a bounded error, known from what quantising left over. A pair survives
unless its upper bound is below the k-th largest lower bound of its query. Survivors are bounded anew
with both codes, in double precision and 250 times closer, so that little more than the k best of a
tile are left, and only these leave it. Over all tiles they are thinned out in the same way. The
original vectors of the last survivors are fetched once, by a join on the row, for their exact
products; the k best of each query are kept by bounded heaps ahead of the last shuffle and after it
(Spark's group limit).

Of equal vectors, which tie, only those that can be among the k best are candidates: the k + 1
smallest ids, k rows of each. So a vector that fills much of the table does not survive often.

Nothing is lost by the bounds, so the result is that of brute force. Vectors nearer to each other
than the error of their codes all survive where they are among the best.

Contract: vectors that are null, empty, zero, or hold a null or a non-finite number take no
part. Vectors of different lengths are not compared. Of ties the smaller vec_id is first.
A row is never compared with rows of its own vec_id; apart from that, each repeated row is a
candidate of its own, while equal rows are one query. Rows without vec_id take no part. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import written

BLOCK_QUERIES = 16384  # of a block at most; BLOCK_BYTES may make it fewer
BLOCK_BYTES = 16 << 20
PARTS = 8  # of the candidates, at least; each block of queries meets each part in one tile
PART_ROWS = 1 << 20  # of a part, about; more candidates make more parts
TILE_QUERIES, TILE_ROWS = 512, 2048  # multiplied at once
EXACT_DIMS = 1024  # products of so many int8 pairs add up exactly in float32
MOST_TASKS = 1 << 15
PAIRS_AT_ONCE = 1 << 16
HELD = 8  # times k survivors are held of a query before those ruled out since are dropped
CODED = (
    "row bigint, vec_id bigint, dim int, codes binary, fine binary, step double, fine_step double, "
    "length double, rest double, fine_rest double"
)
FOUND = "query bigint, row bigint, low double, high double"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that take part."""
    rows = vectors.select(
        F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    infinite = F.lit(float("inf"))
    odd = F.exists(
        "embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite)
    )
    return rows.where(
        F.col("vec_id").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0)
    )


def candidates_of(rows: DataFrame, k: int) -> DataFrame:
    """The rows that can be among the k best of a query: of equal vectors only the first."""
    digest = F.xxhash64("embedding")
    many = written(
        rows.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).select("digest")
    )
    if many.isEmpty():
        return rows
    named = rows.withColumn("digest", digest)
    copies = named.join(many, "digest", "left_semi")
    by_id = Window.partitionBy("digest", "embedding").orderBy("vec_id")
    by_row = Window.partitionBy("digest", "embedding", "vec_id").orderBy("row")
    # Both are cut ahead of their shuffles, so that no task gets all copies.
    copies = copies.withColumn("place", F.row_number().over(by_row)).where(F.col("place") <= k).drop("place")
    copies = copies.withColumn("place", F.dense_rank().over(by_id)).where(F.col("place") <= k + 1).drop("place")
    return named.join(many, "digest", "left_anti").unionByName(copies).drop("digest")


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of one byte, and the step of each vector."""
    step = np.abs(vectors).max(axis=1) / 127
    step[step == 0] = 1  # too small to divide; its codes are 0, all is left over
    return np.rint(vectors / step[:, None]).astype(np.int8), step


def coded(rows: DataFrame) -> DataFrame:
    """Codes, codes of what these leave over, their steps, and the lengths that bound the errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            flat, ends = vectors.flatten().to_numpy(), np.cumsum(np.diff(vectors.offsets.to_numpy()))
            dims = np.diff(ends, prepend=0)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                part = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                codes, step = quantised(part)
                left = part - codes * step[:, None]
                fine, fine_step = quantised(left)
                left_over = left - fine * fine_step[:, None]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(pa.array(at)),
                        batch.column("vec_id").take(pa.array(at)),
                        pa.array(np.full(len(at), dim, np.int32)),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array([c.tobytes() for c in fine], pa.binary()),
                        pa.array(step),
                        pa.array(fine_step),
                        pa.array(np.linalg.norm(part, axis=1)),
                        pa.array(np.linalg.norm(left, axis=1)),
                        pa.array(np.linalg.norm(left_over, axis=1)),
                    ],
                    schema=schema,
                )

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(CODED))
    return rows.select("row", "vec_id", "embedding").mapInArrow(run, CODED)


class Quantised:
    """Some vectors of one length, as codes."""

    def __init__(self, rows: pa.Table | pa.RecordBatch):
        def matrix(name: str) -> np.ndarray:
            flat = np.frombuffer(b"".join(rows.column(name).to_pylist()), np.int8)
            return flat.reshape(rows.num_rows, -1)

        self.rows, self.ids, self.step, self.length, self.rest, self.fine_rest = (
            rows.column(c).to_numpy() for c in ("row", "vec_id", "step", "length", "rest", "fine_rest")
        )
        self.codes = matrix("codes")
        self.about = self.codes * self.step[:, None]
        self.about += matrix("fine") * rows.column("fine_step").to_numpy()[:, None]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of codes."""
    total = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT_DIMS):
        part = slice(d, d + EXACT_DIMS)
        total += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return total


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up from the first component to the last, so equal vectors tie."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def error_of(length_a, rest_a, length_b, rest_b):
    """How far the product of two vectors may be from that of their codes.

    By Cauchy-Schwarz on what was left over; the last two terms allow for rounding.
    """
    error = rest_a * (length_b + 2 * rest_b) + (length_a + rest_a) * rest_b
    return error * (1 + 1e-9) + 1e-12 * (length_a + rest_a) * (length_b + rest_b) + 1e-300


def bounds(about: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums that overflow bound nothing."""
    low, high = about - error, about + error
    low[~np.isfinite(low)] = -np.inf
    high[np.isnan(high)] = np.inf
    return low, high


class Search:
    """A block of queries, and the candidates of each that may be among its k best."""

    def __init__(self, asked: Quantised, k: int):
        self.asked, self.k = asked, k
        self.least = np.full(len(asked.rows), -np.inf)  # the k-th largest lower bound, once there are k
        self.held: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 2 + (np.empty(0),) * 2]
        self.size, self.room = 0, HELD * k * len(asked.rows)

    def add(self, block: Quantised) -> None:
        """Compare with some candidates."""
        asked = self.asked
        for i in range(0, len(asked.rows), TILE_QUERIES):
            some = slice(i, i + TILE_QUERIES)
            about = products(asked.codes[some], block.codes)
            about *= asked.step[some, None] * block.step
            error = error_of(asked.length[some, None], asked.rest[some, None], block.length, block.rest)
            low, high = bounds(about, error)
            own = asked.ids[some, None] == block.ids[None, :]
            low[own] = -np.inf
            least = self.least[some]
            if low.shape[1] >= self.k:
                at = low.shape[1] - self.k
                np.maximum(least, np.partition(low, at, axis=1)[:, at], out=least)
            query, which = np.nonzero((high >= least[:, None]) & ~own)
            query += i
            for j in range(0, len(query), PAIRS_AT_ONCE):
                self.refine(query[j : j + PAIRS_AT_ONCE], which[j : j + PAIRS_AT_ONCE], block)
        if self.size > self.room:
            self.thin()
            self.room = max(self.room, 2 * self.size)

    def refine(self, query: np.ndarray, which: np.ndarray, block: Quantised) -> None:
        """Bound some pairs with both codes."""
        asked = self.asked
        about = np.einsum("ij,ij->i", asked.about[query], block.about[which])
        error = error_of(asked.length[query], asked.fine_rest[query], block.length[which], block.fine_rest[which])
        low, high = bounds(about, error)
        stay = high >= self.least[query]
        self.held.append((query[stay], block.rows[which[stay]], low[stay], high[stay]))
        self.size += int(stay.sum())

    def thin(self) -> None:
        query, row, low, high = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((-low, query))
        sizes = np.bincount(query, minlength=len(self.least))
        enough = np.flatnonzero(sizes >= self.k)
        kth = order[(np.cumsum(sizes) - sizes)[enough] + self.k - 1]
        self.least[enough] = np.maximum(self.least[enough], low[kth])
        stay = high >= self.least[query]
        self.held = [(query[stay], row[stay], low[stay], high[stay])]
        self.size = int(stay.sum())

    def found(self) -> Iterator[pa.RecordBatch]:
        self.thin()
        query, row, low, high = self.held[0]
        table = pa.table({"query": self.asked.rows[query], "row": row, "low": low, "high": high})
        yield from table.to_batches(max_chunksize=1 << 16)


def n_parts(candidates: int) -> int:
    return max(PARTS, -(-candidates // PART_ROWS))


def survivors(asked: DataFrame, rows: DataFrame, blocks: int, parts: int, k: int) -> DataFrame:
    """``query, row, low, high``: pairs whose upper bound is not below the query's k-th lower one."""
    tile = ["dim", "query_block", "part"]

    def dealt(df: DataFrame, own: str, n: int, other: str, copies: int, kind: int) -> DataFrame:
        return df.select(
            "*",
            F.pmod(F.xxhash64("vec_id", "codes", "row"), F.lit(n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other),
            F.lit(kind).alias("kind"),
        )

    # A tile: its queries first, then its candidates, as many as there are.
    tiles = (
        dealt(asked, "query_block", blocks, "part", parts, 0)
        .unionByName(dealt(rows, "part", parts, "query_block", blocks, 1))
        .repartition(min(blocks * parts, MOST_TASKS), *tile)
        .sortWithinPartitions(*tile, "kind")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, state = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in [*tile, "kind"]], axis=1)
            border = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for a, b in zip([0, *border.tolist()], [*border.tolist(), len(keys)]):
                here = tuple(keys[a, :3].tolist())
                if here != of:
                    if state is not None:
                        yield from state.found()
                    of, held, state = here, [], None
                part = batch.slice(a, b - a)
                if keys[a, 3] == 0:
                    held.append(part)
                elif held:
                    if state is None:
                        state = Search(Quantised(pa.Table.from_batches(held)), k)
                    for i in range(0, b - a, TILE_ROWS):
                        state.add(Quantised(part.slice(i, TILE_ROWS)))
        if state is not None:
            yield from state.found()

    found = written(tiles.mapInArrow(search, FOUND))
    by_low = Window.partitionBy("query").orderBy(F.desc("low"))
    limit = (
        found.select("query", "low")
        .withColumn("place", F.row_number().over(by_low))
        .where(F.col("place") <= k)
        .groupBy(F.col("query").alias("of"))
        .agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == k)
    )
    return (
        found.join(limit, F.col("query") == F.col("of"), "left")
        .where(F.col("least").isNull() | (F.col("high") >= F.col("least")))
        .select("query", "row")
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates with the largest inner products."""
    numbered = F.monotonically_increasing_id().alias("row")  # holds once written
    rows = written(usable(vectors).select(numbered, "vec_id", "embedding"))
    asked = written(usable(queries).distinct().select(numbered, "vec_id", "embedding"))
    n, longest = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    parts = n_parts(rows.count())
    block = max(1, min(BLOCK_QUERIES, BLOCK_BYTES // (8 * (longest or 1))))
    pairs = survivors(
        written(coded(asked)), written(coded(candidates_of(rows, k))), max(1, -(-n // block)), parts, k
    )
    both = pairs.join(rows.withColumnRenamed("embedding", "other"), "row").join(
        asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "embedding"), "query"
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("embedding"), batch.column("other")
            ends = np.cumsum(np.diff(a.offsets.to_numpy()))
            dims = np.diff(ends, prepend=0)
            x, y = a.flatten().to_numpy(), b.flatten().to_numpy()
            total = np.empty(batch.num_rows)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                place = (ends[at] - dim)[:, None] + np.arange(dim)
                total[at] = inner(x[place], y[place])
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), batch.column("query_id"), batch.column("vec_id"), pa.array(total)],
                names=["query", "query_id", "vec_id", "score"],
            )

    scored = both.select("query", "query_id", "vec_id", "embedding", "other").mapInArrow(
        score, "query bigint, query_id bigint, vec_id bigint, score double"
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (
        scored.withColumn("rank", F.row_number().over(order).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
