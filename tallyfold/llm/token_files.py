"""Token ids in files, compressed by a grammar of id pairs (Re-Pair), in blocks.

Documents are dealt out by ranges of doc_id and sorted, so files hold them in ascending
order. A block is a run of whole documents of one file. In each block the most frequent
pairs of neighbouring ids are replaced by nonterminals, round after round, until none repeats LEAST
times or the block has RULES rules; a pair never spans two documents. A block keeps

    shard, block      its place: files in order of doc_id, blocks in order within a file
    doc_ids           int64 little-endian, ascending; nulls are listed apart and come first
    doc_tokens        ids of each document, uint32
    doc_symbols       symbols of each document, uint32
    base              ids below it are tokens, the symbol base + k is rule k
    rules             left and right symbol of each rule, uint32
    expansions        how many ids each rule stands for, uint32
    width, symbols    2 or 4 bytes for each symbol

The rows are kept as parquet, so any store Spark can write to will do and a lost task is
written again. A document is found by its symbols alone, and a place inside it by adding up
expansion lengths, without decoding what comes before.

Contract: null texts count as empty and hold only the end id; rows with the same doc_id are
ordered by a hash of their text; a very long text is one document of one block, which may then be
longer than BLOCK_TOKENS; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import parts, whole_text, written
from tallyfold.llm.words import encoder, ragged
from tallyfold.sources import new_shared_folder

BLOCK_TOKENS = 1 << 20
LEAST = 8  # a pair must repeat so often to become a rule
MOST = 8_000  # rules made in one round; pairs left out are counted again
RULES = 16_000  # of a block at most, so that symbols of 49,408 tokens fit 16 bits
CELL_BITS = 18

BLOCKS = (
    "shard int, block int, n_docs int, n_tokens bigint, null_ids int, base int, width int, "
    "doc_ids binary, doc_tokens binary, doc_symbols binary, rules binary, expansions binary, "
    "symbols binary"
)


def compress(ids: np.ndarray, doc_tokens: np.ndarray, base: int, rounds: int | None = None):
    """Symbols, symbols of each document, rules and their expansion lengths.

    In each round pairs are counted exactly, by sorting, and those that stand LEAST times or more
    are replaced, the MOST most frequent ones at most. It ends when there is none, when there are
    RULES rules, or after so many rounds, where a number is given.
    """
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(ids) + 1, bool)  # of a document: pairs with the next symbol are not taken
    last[np.cumsum(doc_tokens)[doc_tokens > 0] - 1] = True
    last[-1] = True
    kind, bits = (np.uint32, 16) if base + RULES <= 1 << 16 else (np.uint64, 32)
    hashed = kind(0x9E3779B1 if bits == 16 else 0x9E3779B97F4A7C15), kind(2 * bits - CELL_BITS)
    rules = np.empty((0, 2), np.uint32)
    expansions = np.empty(0, np.uint32)
    touched = np.flatnonzero(~last[:-1])  # left symbols of the pairs to count
    while len(touched) >= LEAST and len(rules) < RULES and rounds != 0:
        rounds = rounds and rounds - 1
        pairs = symbols[touched].astype(kind) << kind(bits) | symbols[touched + 1]
        order = np.sort(pairs)
        new = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
        counts = np.diff(np.append(new, len(order)))
        often = np.flatnonzero(counts >= LEAST)
        room = min(MOST, RULES - len(rules))
        every = len(often) <= room
        if not every:
            often = np.sort(often[np.argsort(-counts[often], kind="stable")[:room]])
        if not len(often):
            break
        chosen = order[new[often]]
        # A table by hash has nearly all places of the chosen pairs; those that share a cell are searched.
        table = np.full(1 << CELL_BITS, -1, np.int32)
        table[chosen * hashed[0] >> hashed[1]] = np.arange(len(chosen))
        which = table[pairs * hashed[0] >> hashed[1]]
        some = np.flatnonzero(which >= 0)
        which, found = which[some], pairs[some]
        other = np.flatnonzero(chosen[which] != found)
        which[other] = np.minimum(np.searchsorted(chosen, found[other]), len(chosen) - 1)
        same = chosen[which] == found
        at, which = touched[some[same]], which[same]
        # Of pairs that overlap, every other one from the left is replaced, and the others vanish.
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at, which = at[place % 2 == 0], which[place % 2 == 0]
        present = np.zeros(len(chosen), bool)
        present[which] = True
        number = np.cumsum(present) - 1
        left = (chosen[present] >> kind(bits)).astype(np.uint32)
        right = (chosen[present] & kind((1 << bits) - 1)).astype(np.uint32)
        size = np.concatenate([np.ones(base, np.uint32), expansions])
        symbols[at] = base + len(rules) + number[which]
        last[at] = last[at + 1]
        stay = np.ones(len(last), bool)
        stay[at + 1] = False
        symbols, last = symbols[stay[:-1]], last[stay]
        rules = np.concatenate([rules, np.stack([left, right], axis=1)])
        expansions = np.concatenate([expansions, size[left] + size[right]])
        if every:
            # Pairs of symbols that were there before are now too rare: those with a new one are left.
            at -= np.arange(len(at))
            fresh = np.zeros(len(last), bool)
            fresh[at] = fresh[at - 1] = True
            touched = np.flatnonzero(fresh & ~last)
        else:
            touched = np.flatnonzero(~last[:-1])
    ends = np.flatnonzero(last[:-1]) + 1
    doc_symbols = np.zeros(len(doc_tokens), np.int64)
    doc_symbols[doc_tokens > 0] = np.diff(ends, prepend=0)
    return symbols, doc_symbols, rules, expansions


def expand(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: rules are taken apart until none is left."""
    symbols = symbols.astype(np.uint32)
    while True:
        pair = symbols >= base
        if not pair.any():
            return symbols
        twice = np.repeat(symbols, 1 + pair)
        first = np.cumsum(1 + pair)[pair] - 2
        rule = rules[symbols[pair] - base]
        twice[first], twice[first + 1] = rule[:, 0], rule[:, 1]
        symbols = twice


class Block:
    """One row of the files."""

    def __init__(self, row: dict):
        def numbers(name, kind="<u4"):
            return np.frombuffer(row[name], kind)

        self.base = row["base"]
        self.doc_ids = [None] * row["null_ids"] + numbers("doc_ids", "<i8").tolist()
        self.doc_tokens, self.doc_symbols = numbers("doc_tokens"), numbers("doc_symbols")
        self.rules, self.expansions = numbers("rules").reshape(-1, 2), numbers("expansions")
        self.symbols = numbers("symbols", f"<u{row['width']}")
        self.first = np.cumsum(self.doc_symbols, dtype=np.int64) - self.doc_symbols

    def ids(self) -> np.ndarray:
        """Of all documents, one after the other."""
        # What each rule stands for is made once; symbols are then looked up.
        pool = expand(np.arange(self.base, self.base + len(self.rules), dtype=np.uint32), self.base, self.rules)
        count = np.concatenate([np.ones(self.base, np.int64), self.expansions])
        first = np.cumsum(count) - count
        pool = np.concatenate([np.arange(self.base, dtype=np.uint32), pool])
        return ragged(pool, first[self.symbols], count[self.symbols])

    def slice(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the document at place ``doc`` of the block."""
        symbols = self.symbols[self.first[doc] : self.first[doc] + self.doc_symbols[doc]]
        rule = symbols.astype(np.int64) - self.base
        size = np.where(rule >= 0, np.append(self.expansions, 1)[np.where(rule >= 0, rule, -1)], 1)
        ends = np.cumsum(size)
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[a - 1]) if a else 0
        return expand(symbols[a:b], self.base, self.rules)[start - before : stop - before]


def write_ids(documents: DataFrame, path: str, folder: str, end_id: int = 2) -> None:
    """Encode every text, append the end id, and write the blocks to the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block = TaskContext.get().partitionId(), 0
        own = encoder(path)
        base = own.splitter.tokenizer.get_vocab_size()
        docs: list = []
        ids: list[np.ndarray] = []
        held = 0

        def full() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            symbols, doc_symbols, rules, expansions = compress(np.concatenate(ids), lengths, base)
            width = 2 if base + len(rules) <= 1 << 16 else 4
            known = [d for d in docs if d is not None]
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "shard": shard,
                        "block": block,
                        "n_docs": len(docs),
                        "n_tokens": int(lengths.sum()),
                        "null_ids": len(docs) - len(known),
                        "base": base,
                        "width": width,
                        "doc_ids": np.array(known, "<i8").tobytes(),
                        "doc_tokens": lengths.astype("<u4").tobytes(),
                        "doc_symbols": doc_symbols.astype("<u4").tobytes(),
                        "rules": rules.astype("<u4").tobytes(),
                        "expansions": expansions.astype("<u4").tobytes(),
                        "symbols": symbols.astype(f"<u{width}").tobytes(),
                    }
                ],
                schema=schema,
            )

        for batch in (part for whole in batches for part in parts(whole)):
            names = batch.column("doc_id").to_pylist()
            for rows, flat, lengths in own.batches(batch.column("text").to_pylist()):
                ends = np.cumsum(lengths)
                flat, ends = np.insert(flat, ends, end_id), ends + np.arange(1, len(ends) + 1)
                for doc, run_ids in zip(names[rows], np.split(flat, ends[:-1])):
                    docs.append(doc)
                    ids.append(run_ids)
                    held += len(run_ids)
                    if held >= BLOCK_TOKENS:
                        yield full()
                        docs, ids, held, block = [], [], 0, block + 1
        if docs:
            yield full()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))
    rows = documents.select(
        F.col("doc_id").cast("bigint"), whole_text().alias("text"), F.xxhash64("text").alias("h")
    )
    (
        rows.repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h")
        .select("doc_id", "text")
        .mapInArrow(run, BLOCKS)
        .write.parquet(folder)
    )


def block_starts(blocks: DataFrame) -> DataFrame:
    """``shard, block, before``: ids in all blocks before. First files are added up, then blocks."""
    sizes = written(blocks.select("shard", "block", "n_tokens"))
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn(
        "shard_before",
        F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("in_shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(
        shards, "shard"
    ).select("shard", "block", (F.col("shard_before") + F.col("in_shard")).alias("before"))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row)
                sizes = block.doc_tokens.astype(np.int64)
                ends = np.cumsum(sizes)
                data = memoryview(block.ids().astype("<u4").tobytes())
                n = len(sizes)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([row["shard"]] * n, pa.int32()),
                        "block": pa.array([row["block"]] * n, pa.int32()),
                        "doc_id": pa.array(block.doc_ids, pa.int64()),
                        "in_block": pa.array(ends - sizes),
                        "n_tokens": pa.array(sizes),
                        "ids_crc32": pa.array(
                            [
                                zlib.crc32(data[4 * a : 4 * b])
                                for a, b in zip((ends - sizes).tolist(), ends.tolist())
                            ],
                            pa.int64(),
                        ),
                    }
                )

    blocks = spark.read.schema(BLOCKS).parquet(folder)
    rows = blocks.mapInArrow(
        run,
        "shard int, block int, doc_id bigint, in_block bigint, n_tokens bigint, ids_crc32 bigint",
    )
    return rows.join(written(block_starts(blocks)), ["shard", "block"]).select(
        "doc_id", (F.col("before") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32"
    )


def stored_ids(documents: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the ids to a new shared folder and read them back."""
    spark = documents.sparkSession
    folder = new_shared_folder(spark)
    write_ids(documents, path, folder, end_id)
    return read_ids(spark, folder)
