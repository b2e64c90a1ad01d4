"""Hard negatives, against all scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import hard_negatives

from .test_operators import by_key

INF, NAN = float("inf"), float("nan")


def brute(rows, is_anchor, positives=5, negatives=10, least=30, most=90):
    good = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if len(v) <= hard_negatives.LONGEST and all(abs(256 * x) < hard_negatives.LARGEST for x in v):
            good.append((i, tuple(math.floor(256 * x) for x in v), label))
    out = []
    for a, v, own in {r for r in good if is_anchor(r[0])}:
        scored = [
            (-sum(x * y for x, y in zip(v, w)), i, label) for i, w, label in good if i != a and len(w) == len(v)
        ]
        for minus, p, _ in sorted(s for s in scored if s[2] == own)[:positives]:
            far = sorted(s for s in scored if s[2] != own and least * -minus <= 100 * -s[0] <= most * -minus)
            out += [(a, p, n + 1, i, -minus, -s) for n, (s, i, _) in enumerate(far[:negatives])]
    return out


def odd_rows():
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).round(2).tolist(), int(rng.integers(3))) for i in range(400)]
    rows += [(400 + i, [0.5] * 12, i % 2) for i in range(90)]  # ties
    rows += [(i, rows[i][1], rows[i][2]) for i in (100, 7, 7, 200)]  # repeated rows
    rows += [(300, [1.0] * 12, 1)]  # another anchor of the same id
    rows += [(500, None, 1), (600, [], 1), (601, [], 1), (602, [], 2), (603, [1.0, None], 1), (604, [NAN] * 12, 0)]
    rows += [(605, [INF] + [1.0] * 11, 0), (606, [1e300] * 12, 0), (607, [70_000.0] * 12, 0), (None, [1.0] * 12, 0)]
    rows += [(608, [1.0] * 12, None), (700, [2.0, 1.0], 5), (701, [2.0, 1.1], 5), (702, [1.0, 1.0], 6)]
    rows += [(800, [0.0] * 12, 0), (801, [60_000.0] * 12, 0), (900, [-1.0] * 12, 2)]
    return rows


@pytest.mark.parametrize("wide", [True, False])
def test_negatives_match_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 50)
    monkeypatch.setattr(hard_negatives, "TABLE_BYTES", 1 << 14)
    rows = [r for r in odd_rows() if wide or r[0] != 801]  # without it scores fit 32 bits
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    df = df.withColumn("bars", F.lit(1)).withColumn("planes", F.lit("x")).repartition(3)
    found = by_key(hard_negatives.hard_negatives(df, df.where("vec_id % 100 = 0")).collect())
    assert found == by_key(brute(rows, lambda i: i % 100 == 0))
    assert {100, 300, 600, 700} < {r[0] for r in found}


def test_blocks_and_parts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "HELD", 1)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=9).round(1).tolist(), int(rng.integers(4))) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    rows = [(i, [float(np.float32(x)) for x in v], n) for i, v, n in rows]
    found = hard_negatives.hard_negatives(df, df.where("vec_id % 20 = 0"), positives=3, negatives=4, least=10, most=50)
    assert by_key(found.collect()) == by_key(brute(rows, lambda i: i % 20 == 0, 3, 4, 10, 50))


@pytest.mark.parametrize("planes", [2, 9, 25])
def test_lookups_are_inner_products(planes):
    rng = np.random.default_rng(planes)
    top = 1 << (planes - 1)
    a, b = (rng.integers(-top, top, (n, 19)) for n in (5, 40))
    sums = hard_negatives.tables(hard_negatives.codes_of(hard_negatives.planes_of(a, planes)), np.int64)
    assert (hard_negatives.scores(sums, hard_negatives.planes_of(b, planes)) == b @ a.T).all()


def test_an_empty_table_gives_no_rows(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    some = spark.createDataFrame([(1, [1.0], 2)], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(none, none).collect() == []
    assert hard_negatives.hard_negatives(some, none).collect() == []
    assert hard_negatives.hard_negatives(none, some).collect() == []
