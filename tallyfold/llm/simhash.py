"""Near-duplicates by SimHash fingerprints, found by deletion variants of their halves.

1.  A text's fingerprint has a bit set where more than half of the hashes of its three-word
    shingles have it set. Documents of one fingerprint are one class, named by its smallest
    doc_id; only classes go on.
2.  Two fingerprints that differ in at most two bits agree, in one of their two halves of 32 bits,
    but for one bit at most. So each half is indexed once for each of its bits, with that bit
    taken out: classes that share a variant share a bucket, by equality alone.
3.  Buckets are streamed in order. Members are compared in full where their halves differ in the
    bit taken out, or are equal (for the first bit only, as equal halves share all 32 buckets).
    What is emitted is one link for each member to the least one linked with it inside the bucket,
    never all pairs.
4.  A bucket is held in memory only if neither of the two halves it can hold has more than LIMIT
    classes, counted beforehand. The others are cut again, by two bits taken out: one of the half
    and one of the rest, or two of the rest. What remains is shared by four fingerprints at most,
    which all are within two bits of each other, so work grows with the members and not their square.
5.  Links make components.

Contract: words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z as a-z; shingles are
three words joined by a blank, repeats included; fewer words are one shingle. A null text counts as
empty; without words the fingerprint is zero, which is linked like any other. Hashes are XXH64 of
the bytes, seed 42. Texts of any length are read whole, SLICE words at a time. Rows without doc_id
take no part: their component is null. Repeated rows are of one class. Rows that share a doc_id and
not a text have each the fingerprint of its own text, and the component of that fingerprint. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import arrow_map, whole_text, written
from tallyfold.llm.minhash import components

WORDS = 3
SEED = 42
HALF = 32
LIMIT = 512  # classes of one half, above which its buckets are cut again
SLICE = 1 << 16  # words of one text that are hashed at a time

_SETS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # bits of each byte


def hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of the shingles of some words."""
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], stops[: -WORDS]])
    found = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (stops[WORDS - 1 :] - 1).tolist())]
    return np.array(found, np.uint64)


def fingerprint(text: bytes) -> int:
    """The bits set in more than half of the hashes, as an unsigned number."""
    words = text.lower().split()
    times, total = np.zeros((8, 256), np.int64), 0
    for i in range(0, max(1, len(words) - WORDS + 1), SLICE):
        found = hashes(words[i : i + SLICE + WORDS - 1])
        total += len(found)
        # How often each byte stands at each of the eight places gives the count of every bit.
        at = found.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(8) * 256
        times += np.bincount(at.ravel(), minlength=2048).reshape(8, 256)
    bits = (times @ _SETS).ravel() * 2 > total
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, bits``: the fingerprint of every text as a signed number."""

    def run(batch):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        return {
            "doc_id": batch.column("doc_id"),
            "bits": np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64),
        }

    rows = documents.select(F.col("doc_id").cast("bigint"), whole_text().alias("text"))
    return arrow_map(rows, run, "doc_id bigint, bits bigint")


def halves(of: str, which: Column) -> Column:
    """The half of a fingerprint: 0 for the lower bits, 1 for the upper ones."""
    upper = F.shiftrightunsigned(of, HALF)
    return F.when(which == 0, F.col(of).bitwiseAND(F.lit((1 << HALF) - 1))).otherwise(upper)


def without(value: Column, bit: Column) -> Column:
    one = F.lit(1).cast("bigint")
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, bit)))


def variants(classes: DataFrame) -> DataFrame:
    """``variant, rest, bits``: each half with each of its bits taken out."""
    return (
        classes.select("bits", F.explode(F.sequence(F.lit(0), F.lit(2 * HALF - 1))).alias("variant"))
        .withColumn("half", F.floor(F.col("variant") / HALF).cast("int"))
        .withColumn("bit", F.pmod("variant", F.lit(HALF)))
        .select("variant", without(halves("bits", F.col("half")), F.col("bit")).alias("rest"), "bits")
    )


def crowded(classes: DataFrame, limit: int) -> DataFrame:
    """``variant, rest`` of the buckets that hold a half of more than ``limit`` classes."""
    half = (
        classes.select("bits", F.explode(F.array(F.lit(0), F.lit(1))).alias("which"))
        .select("which", halves("bits", F.col("which")).alias("half"))
        .groupBy("which", "half")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > limit)
    )
    return (
        half.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))))
        .select((F.col("which") * HALF + F.col("bit")).alias("variant"), without(F.col("half"), F.col("bit")).alias("rest"))
        .distinct()
    )


def linked(variant: np.ndarray, new: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member with the least one it is linked with, for whole buckets that begin at ``new``."""
    sizes = np.diff(np.append(new, len(bits)))
    left = np.repeat(new + sizes, sizes) - np.arange(len(bits))  # members from here to the end
    x_all, y_all = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for step in range(1, int(sizes.max(initial=0))):
        every = np.flatnonzero(left > step)
        for i in range(0, len(every), 1 << 18):
            x = every[i : i + (1 << 18)]
            y = x + step
            apart = bits[x] ^ bits[y]
            near = np.bitwise_count(apart) <= 2
            differs = (apart >> variant[x]) & np.uint64(1) == 1
            first = variant[x] % HALF == 0
            stay = near & (differs | first)
            x_all.append(x[stay])
            y_all.append(y[stay])
    x, y = np.concatenate(x_all), np.concatenate(y_all)
    label = np.arange(len(bits))
    while len(x):
        before = label.copy()
        np.minimum.at(label, y, label[x])
        np.minimum.at(label, x, label[y])
        label = label[label]
        if (label == before).all():
            break
    at = np.flatnonzero(label != np.arange(len(bits)))
    return bits[at], bits[label[at]]


def bucket_links(rows: DataFrame) -> DataFrame:
    """``a, b``: links inside each bucket. ``rows``: ``variant, rest, bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in chain(batches, [None]):  # the null ends the last bucket
            if batch is not None:
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
            if held is None or not held.num_rows:
                continue
            variant, rest = held["variant"].to_numpy(), held["rest"].to_numpy()
            new = np.flatnonzero(np.diff(variant, prepend=-1) | np.diff(rest, prepend=rest[0]))
            stop = held.num_rows
            if batch is not None:  # the last bucket may go on
                stop, new = int(new[-1]), new[:-1]
            if not len(new):
                continue
            bits = held["bits"].to_numpy()[:stop].view(np.uint64)
            a, b = linked(variant[:stop].astype(np.uint64), new, bits)
            held = held.slice(stop)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    keys = ["variant", "rest"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def crowded_links(rows: DataFrame) -> DataFrame:
    """``a, b``: links inside large buckets, by a further bit or two taken out."""
    parts = (
        rows.withColumn("which", F.floor(F.col("variant") / HALF).cast("int"))
        .withColumn("own", halves("bits", F.col("which")))
        .withColumn("other", halves("bits", 1 - F.col("which")))
    )
    # The half with one bit taken out, and one bit of the rest.
    one = parts.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(HALF - 1)))).select(
        "variant", "rest", "bit", F.lit(-1).alias("second"), without(F.col("other"), F.col("bit")).alias("left"), "bits"
    )
    # Equal halves, and two bits of the rest; once for each half.
    two = (
        parts.where(F.pmod("variant", F.lit(HALF)) == 0)
        .withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(HALF - 2))))
        .withColumn("second", F.explode(F.sequence(F.col("bit") + 1, F.lit(HALF - 1))))
        .select(
            "variant",
            F.col("own").alias("rest"),
            "bit",
            "second",
            without(without(F.col("other"), F.col("bit")), F.col("second")).alias("left"),
            "bits",
        )
    )
    # Four members at most.
    return (
        one.unionByName(two)
        .groupBy("variant", "rest", "bit", "second", "left")
        .agg(F.collect_set("bits").alias("members"))
        .where(F.size("members") > 1)
        .select(F.array_min("members").alias("b"), F.explode("members").alias("a"))
        .where("a <> b")
        .select("a", "b")
    )


def links(classes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``a, b``: enough to connect all fingerprints within two bits; the two of a row may be a chain apart."""
    rows = variants(classes)
    large = written(crowded(classes, limit))
    if large.isEmpty():
        return bucket_links(rows)
    small = rows.join(large, ["variant", "rest"], "left_anti")
    return bucket_links(small).unionByName(crowded_links(rows.join(large, ["variant", "rest"], "left_semi")))


def near_duplicates(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    found = written(fingerprints(documents))
    classes = written(
        found.where("doc_id is not null")
        .groupBy("bits")
        .agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )
    # Components are made of fingerprints and named afterwards, as texts may share a doc_id.
    labels = components(written(links(classes, limit).distinct())).withColumnRenamed("id", "of")
    rooted = written(
        classes.join(labels, F.col("bits") == F.col("of"), "left").withColumn("root", F.coalesce("label", "bits"))
    )
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    named = written(
        rooted.where("copies > 1 or label is not null")
        .select(F.col("bits").alias("c_bits"), F.col("root").alias("c_root"))
        .join(least, F.col("c_root") == F.col("root"))
        .select("c_bits", "component")
    )
    return found.join(named, F.col("bits") == F.col("c_bits"), "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )
