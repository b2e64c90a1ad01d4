"""Ranked search, against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyfold.llm import treap

from .conftest import LONG, ODD
from .test_operators import by_key

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def brute(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t in rows if i is not None]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if i is not None and t is not None}:
        scored = []
        for doc, counts in docs:
            m = 75 + 25 * counts.total() * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10**9 * counts[t] // (1000 * counts[t] + 12 * m))
                for t in terms(text)
                if counts[t]
            )
            if score > 0:
                scored.append((-score, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k])]
    return out


def some_rows(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.4)) % 900}" for _ in range(2000)] + ["Été", "字", "x_y", "a-B"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 200])))) for i in range(50, 50 + n)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:60])] + rows[:2]  # ties, and a row again
    return rows, words


ITEMS = [(-1, "Same TEXT twice"), (-2, "été ÉTÉ 字 x"), (-3, "nothing-of-this-kind"), (-4, ""), (-5, None), (None, "the")]


@pytest.mark.parametrize("shard", [(4096, 1 << 20), (16, 1 << 20), (1, 5), (4096, 900)])
def test_ranks_match_brute_force(spark, documents, monkeypatch, shard):
    monkeypatch.setattr(treap, "SHARD_DOCS", shard[0])
    monkeypatch.setattr(treap, "SHARD_CELLS", shard[1])
    monkeypatch.setattr(treap, "STATES", 5)
    rows, words = some_rows(4)
    rows = rows[:80] if shard[0] == 1 else rows
    rows += ODD
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30])))) for i in range(25)]
    items += [*ITEMS, items[0], (3, "a b c w1")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id bigint, text string, doc_id int, rank int")
    found = treap.ranked(documents(rows), df, k=7)
    assert by_key(found.collect()) == by_key(brute(rows, items, 7))


def test_blocks_of_items_give_the_same(spark, documents, monkeypatch):
    rows, words = some_rows(6, 100)
    items = [(i, " ".join(words[i * 5 : i * 5 + 5])) for i in range(30)]
    monkeypatch.setattr(treap, "BLOCK_CHARS", 200)
    df = spark.createDataFrame(items, "item_id bigint, text string")
    assert by_key(treap.ranked(documents(rows), df, k=5).collect()) == by_key(brute(rows, items, 5))


def test_cells_hold_the_largest_impact_below_them():
    rng = np.random.default_rng(0)
    at = rng.choice(37 * 21, 150, replace=False)
    row, column, impact = at // 21, at % 21, rng.integers(1, 1_000_000, 150)
    tree = treap.Treap({"doc_ids": np.arange(21, dtype="<i8").tobytes()} | treap.built(row, column, impact, 37, 21))
    assert tree.depth == 5 and tree.most[0] == impact[row < 32].max() and tree.most[1] == impact[row >= 32].max()
    assert sorted(tree.most[-151:-1].tolist()) == sorted(impact.tolist())
    for term in range(37):
        best = []
        tree.search(np.array([term]), np.array([3]), 4, best)
        wanted = sorted(((3 * int(v), -int(c)) for r, c, v in zip(row, column, impact) if r == term), reverse=True)[:4]
        assert sorted(best, reverse=True) == wanted


def test_terms_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(treap, "CHARS", 10)
    for text in ("ab " * 40, "x" * 35 + " y", LONG[:500], "", "abcdefghi jklmnopqrs", "0123456789", "字" * 30):
        assert [t for some in treap.terms(text.encode()) for t in some] == [t.encode() for t in terms(text)]


def test_empty_tables_give_no_rows(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert treap.ranked(documents([]), items).collect() == []
    assert treap.ranked(documents(ODD), items.limit(0)).collect() == []
