"""Near-duplicates by SetSketch registers, estimated jointly by likelihood, then verified.

A document is the set of its distinct five-word shingles. Its SetSketch has one register for
each of a number of hash functions: the least hash of the set as an exponential variable, cut to a
whole power of B close to 1. Registers of a union are the larger registers, and two registers
are equal about as often as the sets are similar.

1.  Documents with the same set are one class, with one text, that of its smallest doc_id. Only
    classes go on.
2.  Registers are cut into bands; classes that share all registers of a band share a bucket.
3.  In each bucket one class, chosen anew by band, is compared with all others. The number
    of registers that are larger, smaller and equal, with the known sizes of both sets, gives
    the likelihood of each similarity; pairs go on unless the least similarity wanted is
    e**EVIDENCE times less likely than the best. Those are confirmed on their full sets.
4.  Confirmed links make components. Buckets that still hold more than one component have all
    pairs of different components compared in the same way, with one bit each of FINE further
    registers, made for their classes alone. Nothing is emitted for pairs of one component, as a
    further link could not change the result, and each pair is emitted only for the first band
    it shares. Large buckets are dealt out as tiles of two blocks, one of which holds members
    outside the bucket's largest component.
5.  Links of both rounds make the final components.

Rows, never groups, pass through a task: buckets are streamed in order, a tile holds twice
TILE rows, and the many partners of one class are dealt out in lots.

The least similarity wanted is given in percent. A link is missed if the two share no band, with
a chance of (1 - s**ROWS)**bands: there are as many bands as make it MISSED at most for two
documents of just that similarity (25 for 0.85, 37 for 0.80, 4e-7 either way), less above it; or
if the estimate is off by more than six standard deviations, 2e-9.

Contract: words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z as a-z. Fewer words
than five are one shingle. A text that is null, empty or has no words has no shingles, is
linked with nothing and is its own component. Very long texts are whole sets; one text is held at
a time beside batches of BATCH_BYTES. Repeated rows have the same set and so one
class. Rows without doc_id take no part: their component is null and they are kept. Rows that
share a doc_id and not a text are linked each by its own text. Sets are told apart by two 64-bit
sums of the hashes of their shingles; where texts share a doc_id, classes are told apart by 64 bits
of doc_id and text. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import arrow_map, parts, sizes_within, whole_text, written

WORDS = 5
PERCENT = 85  # 100 * intersection >= PERCENT * union, where no other number is given
ROWS = 5  # registers of a band
MISSED = 5e-7  # the chance that two documents just similar enough share no band, at most
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2  # spacing, rate and largest value of registers
EVIDENCE = 20.0
FINE = 2048  # further registers, of which one bit each is kept, where buckets stay open
TILE = 256  # classes of a block
LOT = 256  # partners of one class that are confirmed together
BATCH_BYTES = 1 << 21
PLACED = 64  # bytes of a word that have a random number for each value and place

_RANDOM = np.random.default_rng(1729)
_BYTES = _RANDOM.integers(0, 1 << 63, size=256 * PLACED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.integers(0, 1 << 63, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def n_bands(percent: int) -> int:
    """How many bands miss a pair of this similarity with a chance of MISSED at most."""
    return math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS)))


@lru_cache
def hashes(n: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of as many hash functions; other ones for each number and kind."""
    random = np.random.default_rng([1729, n, kind])
    factors = random.integers(0, 1 << 31, size=n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factors, random.integers(0, 1 << 32, size=n, dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The ascending distinct 64-bit hashes of each text's shingles."""
    out: list[np.ndarray] = []
    for rows in sizes_within([len(t) for t in texts], BATCH_BYTES):
        part = texts[rows]
        # A blank after each text ends its last word.
        data = _LOWER[np.frombuffer(b" ".join(part) + b" ", np.uint8)]
        ends = np.cumsum([len(t) + 1 for t in part], dtype=np.int64)
        white = _WHITE[data]
        first = ~white
        first[1:] &= white[:-1]
        starts = np.flatnonzero(first)
        n_words = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
        if len(starts):
            place = np.arange(len(data)) - np.repeat(
                np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]]))
            )
            value = _BYTES[data.astype(np.int64) * PLACED + np.minimum(place, PLACED - 1)]
            value[white] = 0
            word = mixed(np.add.reduceat(value, starts))
            # Longer words are hashed over all their bytes.
            stops = np.flatnonzero(white[1:] & ~white[:-1]) + 1
            for i in np.flatnonzero(stops - starts > PLACED):
                word[i] = xxhash.xxh64_intdigest(data[starts[i] : stops[i]].tobytes(), 1729)
        else:
            word = np.empty(0, np.uint64)
        last = np.cumsum(n_words)
        five = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
        for i in range(WORDS):
            five += word[i : len(word) - WORDS + 1 + i] * _PLACES[i]
        five = mixed(five)
        for end, n in zip(last.tolist(), n_words.tolist()):
            if n >= WORDS:
                found = np.sort(five[end - n : end - WORDS + 1])
                out.append(found[np.append(True, found[1:] != found[:-1])])
            elif n:
                few = np.uint64(n) + (word[end - n : end] * _PLACES[:n]).sum(dtype=np.uint64)
                out.append(mixed(np.array([few], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def registers(found: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
    """The SetSketch of a set that is not empty, of n registers."""
    factors, shifts = hashes(n, kind)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    thin = found.astype(np.uint32)
    step = max(1, (1 << 17) // n)
    for i in range(0, len(thin), step):
        part = np.multiply.outer(thin[i : i + step], factors)
        part += shifts
        np.minimum(low, part.min(axis=0), out=low)
    least = -np.log1p(-(low.astype(float) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def fine_bits(found: np.ndarray) -> bytes:
    """The lowest bit of each further register."""
    return np.packbits(registers(found, FINE, 1) & 1).tobytes()


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A hash of the registers of each band, for every row."""
    bands = sketch.reshape(len(sketch), -1, ROWS).astype(np.uint64)
    total = np.zeros(bands.shape[:2], np.uint64)
    for i in range(ROWS):
        total = mixed(total + bands[:, :, i] + np.uint64(i + 1))
    return total


def likely(
    a: np.ndarray,
    b: np.ndarray,
    size_a: np.ndarray,
    size_b: np.ndarray,
    percent: int,
    agreed: np.ndarray | None = None,
) -> np.ndarray:
    """Which pairs of sketches may have the similarity wanted, by a likelihood ratio.

    With u and v the sizes as shares of their sum, a register of the first set is the larger
    one with chance p(u - v * J), of the second with p(v - u * J), and they are equal else.
    ``agreed`` counts equal fine bits: a bit is equal with chance (1 + J) / 2, as registers
    that differ agree in it half of the time.
    """
    larger = (a > b).sum(axis=1)
    smaller = (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    grid = np.concatenate([np.arange(0, percent, 2), np.arange(percent, 101)]) / 100
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    # A similarity cannot exceed the smaller size by the larger.
    most = np.minimum(u, v) / np.maximum(u, v)

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    j = np.minimum(grid[None, :], most)
    more, less = chance(u - v * j), chance(v - u * j)
    same = np.clip(1 - more - less, 1e-12, 1)
    value = (
        larger[:, None] * np.log(np.clip(more, 1e-12, 1))
        + smaller[:, None] * np.log(np.clip(less, 1e-12, 1))
        + equal[:, None] * np.log(same)
    )
    if agreed is not None:
        value += agreed[:, None] * np.log((1 + j) / 2)
        value += (FINE - agreed)[:, None] * np.log(np.maximum((1 - j) / 2, 1e-12))
    wanted = grid >= percent / 100
    near = value[:, wanted].max(axis=1) >= value.max(axis=1) - EVIDENCE
    return near & (100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b))


def sketches(documents: DataFrame, percent: int) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, sketch, text_hash``; two numbers stand for the set (null: none)."""

    n = n_bands(percent) * ROWS

    def run(batch):
        sets = shingles([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
        return {
            "doc_id": batch.column("doc_id"),
            "n_shingles": [len(s) for s in sets],
            "set_a": [int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets],
            "set_b": [
                int(np.bitwise_xor.reduce(mixed(s)).view(np.int64)) if len(s) else None for s in sets
            ],
            "sketch": [registers(s, n).tobytes() if len(s) else None for s in sets],
            "text_hash": batch.column("text_hash"),
        }

    return arrow_map(
        named_texts(documents),
        run,
        "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sketch binary, text_hash bigint",
    )


def named_texts(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text``: the first two tell texts apart, even those that share a doc_id."""
    text = whole_text()
    return documents.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _streamed(
    df: DataFrame, keys: list[str], function: Callable[[pa.Table], pa.Table], schema: str
) -> DataFrame:
    """Apply a function to runs of whole groups; rows must come sorted by the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            new = _borders(held, keys)
            if len(new) > 1:
                yield from function(held.slice(0, new[-1])).to_batches()
                held = held.slice(new[-1])
        if held is not None and held.num_rows:
            yield from function(held).to_batches()

    return df.mapInArrow(run, schema)


def _borders(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups begin."""
    new = np.zeros(table.num_rows, bool)
    if table.num_rows:
        new[0] = True
    for key in keys:
        column = table[key].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


def _matrix(column) -> np.ndarray:
    """The sketches of one row or more."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _pair_table(a, b) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def tile_pairs(table: pa.Table, percent: int) -> pa.Table:
    """Similar pairs of different components in each tile; rows of equal distance at a time."""
    new = _borders(table, ["band", "key", "one", "two"])
    ends = np.append(new[1:], table.num_rows)
    left = np.repeat(ends, ends - new) - np.arange(table.num_rows)  # rows from here to the end
    sketch, size, ids = _matrix(table["sketch"]), table["size"].to_numpy(), table["id"].to_numpy()
    fine = np.frombuffer(b"".join(table["fine"].to_pylist()), np.uint64).reshape(-1, FINE // 64)
    label, block = table["label"].to_numpy(), table["block"].to_numpy()
    one, two, band = table["one"].to_numpy(), table["two"].to_numpy(), table["band"].to_numpy()
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, int(left.max())):
        every = np.flatnonzero(left > step)
        for i in range(0, len(every), 1 << 15):
            x = every[i : i + (1 << 15)]
            y = x + step
            # In a tile of two blocks, pairs within one of them belong to another tile.
            stay = (label[x] != label[y]) & ((one[x] == two[x]) | (block[x] != block[y]))
            small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            stay &= 100 * small >= percent * large
            x, y = x[stay], y[stay]
            if not len(x):
                continue
            same = (sketch[x] == sketch[y]).reshape(len(x), -1, ROWS).all(axis=2)
            stay = same.argmax(axis=1) == band[x]
            x, y = x[stay], y[stay]
            agreed = FINE - np.bitwise_count(fine[x] ^ fine[y]).sum(axis=1, dtype=np.int64)
            stay = likely(sketch[x], sketch[y], size[x], size[y], percent, agreed)
            out_a.append(ids[x[stay]])
            out_b.append(ids[y[stay]])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return _pair_table(np.minimum(a, b), np.maximum(a, b))


def bands(members: DataFrame) -> DataFrame:
    """``band, key, id``: a row for each band of each class."""

    def run(batch):
        keys = band_keys(_matrix(batch.column("sketch")))
        return {
            "band": np.tile(np.arange(keys.shape[1], dtype=np.int16), len(keys)),
            "key": keys.view(np.int64).ravel(),
            "id": np.repeat(batch.column("id").to_numpy(), keys.shape[1]),
        }

    return arrow_map(members.select("id", "sketch"), run, "band smallint, key bigint, id bigint")


def buckets(members: DataFrame) -> DataFrame:
    """``band, key, id, n, first``: of buckets with more than one class, its members.

    ``first`` is the member that the others are compared with, by a hash that differs by band.
    """
    rows = bands(members)
    crowded = written(
        rows.groupBy("band", "key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct(F.xxhash64("id", "band"), "id")).alias("first"),
        )
        .where("n > 1")
        .select("band", "key", "n", F.col("first.id").alias("first"))
    )
    return written(rows.join(crowded, ["band", "key"]))


def star_pairs(in_buckets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the first class of each bucket with the others, where similar enough."""
    pairs = written(
        in_buckets.where("id <> first")
        .select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b"))
        .distinct()
    )
    a = members.select(*(F.col(c).alias(f"{c}_a") for c in members.columns))
    b = members.select(*(F.col(c).alias(f"{c}_b") for c in members.columns))
    both = pairs.join(a, F.col("a") == F.col("id_a")).join(b, F.col("b") == F.col("id_b")).where(
        100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    )

    def run(batch):
        x, y = _matrix(batch.column("sketch_a")), _matrix(batch.column("sketch_b"))
        size_a, size_b = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
        good = likely(x, y, size_a, size_b, percent)
        return {c: batch.column(c).to_numpy()[good] for c in "ab"}

    return arrow_map(
        both.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b"), run, "a bigint, b bigint"
    )


def refined(ids: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, size, sketch, fine`` of the classes named."""

    def run(batch):
        sets = shingles([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
        return {
            "id": batch.column("id"),
            "size": batch.column("size"),
            "sketch": batch.column("sketch"),
            "fine": [fine_bits(s) if len(s) else bytes(FINE // 8) for s in sets],
        }

    rows = texts.join(ids, "id", "left_semi").join(members, "id")
    return arrow_map(
        rows.select("id", "size", "sketch", "text"), run, "id bigint, size bigint, sketch binary, fine binary"
    )


def open_members(labelled: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with the largest one, ``main``.

    ``rest`` and ``mains`` are how many blocks the members outside and inside of it make.
    """
    by_label = labelled.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("members"))
    several = written(
        by_label.groupBy("band", "key")
        .agg(F.max(F.struct("members", "label")).alias("most"), F.sum("members").alias("all"))
        .where("most.members < all")
        .select(
            "band",
            "key",
            F.col("most.label").alias("main"),
            F.ceil((F.col("all") - F.col("most.members")) / TILE).cast("int").alias("rest"),
            F.ceil(F.col("most.members") / TILE).cast("int").alias("mains"),
        )
    )
    return labelled.join(several, ["band", "key"])


def tiles(open_rows: DataFrame) -> DataFrame:
    """Members by tile: two blocks, the first of members outside the largest component.

    Pairs within that component are settled, so that two of its blocks never meet.
    """
    main, rest, mains = F.col("label") == F.col("main"), F.col("rest"), F.col("mains")
    of = F.xxhash64("id")
    block = F.when(main, rest + F.pmod(of, mains)).otherwise(F.pmod(of, rest)).cast("int")
    others = F.when(main, rest).otherwise(rest + mains)
    return (
        open_rows.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
        .withColumn("one", F.least("block", "other"))
        .withColumn("two", F.greatest("block", "other"))
    )


def open_pairs(
    in_buckets: DataFrame, members: DataFrame, labels: DataFrame, texts: DataFrame, percent: int
) -> DataFrame:
    """``a, b``: similar pairs of different components, in buckets that hold several."""
    labels = labels.withColumnRenamed("id", "of")
    labelled = in_buckets.join(labels, F.col("id") == F.col("of"), "left").select(
        "band", "key", "id", "n", F.coalesce("label", "id").alias("label")
    )
    # Of two members, the one pair there is has been looked at.
    open_rows = written(open_members(labelled.where("n > 2")))
    finer = written(refined(open_rows.select("id").distinct(), members, texts))
    keys = ["band", "key", "one", "two"]
    rows = tiles(open_rows.join(finer, "id")).select(*keys, "block", "id", "label", "size", "sketch", "fine")
    return _streamed(
        rows.repartition(*keys).sortWithinPartitions(*keys),
        keys,
        lambda table: tile_pairs(table, percent),
        "a bigint, b bigint",
    )


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two ascending sets are as similar as wanted."""
    if not len(a) or not len(b):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    shared = int(np.count_nonzero(a[at] == b))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the pairs whose full sets are similar enough. ``texts``: ``id, text`` of classes."""
    pairs = written(pairs.distinct())
    many = written(
        pairs.groupBy(F.col("a").alias("of"))
        .agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots"))
        .where("lots > 1")
    )
    lots = written(
        pairs.join(many, F.col("a") == F.col("of"), "left").select(
            "a", "b", F.pmod(F.xxhash64("b"), F.coalesce("lots", F.lit(1))).cast("int").alias("lot")
        )
    )
    centres = lots.select("a", "lot").distinct().join(texts, F.col("a") == F.col("id"))
    partners = lots.join(texts, F.col("b") == F.col("id"))
    rows = centres.select("a", "lot", F.lit(0).alias("kind"), "id", "text").unionByName(
        partners.select("a", "lot", F.lit(1).alias("kind"), "id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = centre = None
        for batch in (part for whole in batches for part in parts(whole)):
            sets = shingles([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            kind, lot = batch.column("kind").to_pylist(), batch.column("lot").to_pylist()
            a, b = batch.column("a").to_pylist(), batch.column("id").to_pylist()
            found = []
            for i, own in enumerate(sets):
                if kind[i] == 0:
                    of, centre = (a[i], lot[i]), own
                elif (a[i], lot[i]) == of and similar(centre, own, percent):
                    found.append(i)
            if found:
                yield pa.RecordBatch.from_pydict(
                    {
                        "a": pa.array([a[i] for i in found], pa.int64()),
                        "b": pa.array([b[i] for i in found], pa.int64()),
                    }
                )

    return (
        rows.repartition("a", "lot")
        .sortWithinPartitions("a", "lot", "kind")
        .mapInArrow(run, "a bigint, b bigint")
    )


def components(links: DataFrame) -> DataFrame:
    """``id, label``: the smallest id reachable, for each id that has a link.

    Each round links every id, and all its neighbours, to the smallest of them; small ids
    first with larger neighbours, then with smaller ones, until nothing changes.
    """
    edges = written(links.select("a", "b").where("a <> b"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
        up = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(up.where("a <> b").distinct())
        least = written(large.groupBy("a").agg(F.min("b").alias("low")))
        down = large.join(least, "a")
        edges = written(
            down.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(least.select("a", F.col("low").alias("b")))
            .where("a <> b")
            .distinct()
        )
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
    labels = edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("id"), "label").distinct())


def class_name(shared: bool) -> Column:
    """The number of a row's class, if it is the first of it: the doc_id, unless texts share one."""
    return F.xxhash64("doc_id", "text_hash") if shared else F.col("doc_id")


def set_classes(found: DataFrame, shared: bool) -> DataFrame:
    """``id, least, copies`` and the set and sketch of each class; ``id`` names the row of its text."""
    return (
        found.where("set_a is not null and doc_id is not null")
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(
            F.min(F.struct("doc_id", "text_hash")).alias("first"),
            F.count(F.lit(1)).alias("copies"),
            F.min("sketch").alias("sketch"),
        )
        .select("first.*", "copies", "set_a", "set_b", "n_shingles", "sketch")
        .withColumn("id", class_name(shared))
        .withColumnRenamed("doc_id", "least")
        .drop("text_hash")
    )


def class_texts(documents: DataFrame, asked: DataFrame, shared: bool, repeated: bool) -> DataFrame:
    """``id, text`` of the classes asked for (``id``), one text each."""
    texts = named_texts(documents).where("doc_id is not null").select(class_name(shared).alias("id"), "text")
    texts = texts.join(asked, "id", "left_semi")
    # Rows that are wholly the same; their text is moved a second time only where there are any.
    return texts.groupBy("id").agg(F.first("text").alias("text")) if repeated else texts


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    found = written(sketches(documents, percent))
    rows = found.where("set_a is not null and doc_id is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("text_hash").alias("low"), F.max("text_hash").alias("high")
    )
    repeated, shared = rows.agg(F.max(F.col("n") > 1), F.max(F.col("low") < F.col("high"))).first()
    classes = written(set_classes(found, bool(shared)))
    members = classes.select("id", F.col("n_shingles").alias("size"), "sketch")
    in_buckets = buckets(members)
    first = written(star_pairs(in_buckets, members, percent))
    # The documents are moved once, for all classes whose text may be asked for.
    asked = (
        first.select(F.explode(F.array("a", "b")).alias("id"))
        .unionByName(in_buckets.where("n > 2").select("id"))
        .distinct()
    )
    texts = written(class_texts(documents, written(asked), bool(shared), bool(repeated)))
    links = written(confirmed(first, texts, percent))
    labels = components(links)
    more = written(confirmed(open_pairs(in_buckets, members, labels, texts, percent), texts, percent))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    rooted = written(
        classes.join(labels.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left")
        .where("copies > 1 or label is not null")
        .select("least", "set_a", "set_b", "n_shingles", F.coalesce("label", "id").alias("root"))
    )
    least = written(rooted.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component")))
    sets = rooted.join(least, F.col("root") == F.col("of")).select(
        F.col("set_a").alias("c_a"), F.col("set_b").alias("c_b"), F.col("n_shingles").alias("c_n"), "component"
    )
    same = (
        (F.col("set_a") == F.col("c_a"))
        & (F.col("set_b") == F.col("c_b"))
        & (F.col("n_shingles") == F.col("c_n"))
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.join(written(sets), same, "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
