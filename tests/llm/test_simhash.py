"""SimHash near-duplicates, against fingerprints made bit by bit and all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tallyfold.llm import simhash

from .conftest import LONG, ODD
from .test_operators import by_key


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """Components of fingerprints, from all pairs; their names are the smallest ids."""
    prints = [brute_fingerprint(t) for _, t in rows]
    known = sorted({p for (i, _), p in zip(rows, prints) if i is not None})
    label = {p: p for p in known}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for n, b in enumerate(known):
        for a in known[:n]:
            if (a ^ b).bit_count() <= 2:
                label[root(a)] = root(b)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root(p)] = min(least.get(root(p), i), i)
    return [(i, f"{p:016x}", None if i is None else least[root(p)]) for (i, _), p in zip(rows, prints)]


def edited(seed, copies=40):
    rng = random.Random(seed)
    out = []
    for _ in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([20, 200, 900]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = f"X{rng.randrange(3000)}"
            out.append((1000 + len(out), " ".join(text)))
    return out


ROWS = ODD + edited(1) + [(500, "A\x0bb\x0cC d"), (501, "a b c d"), (502, "a b"), (503, "A  B\n"), (-9, None)]


@pytest.mark.parametrize("limit", [simhash.LIMIT, 2, 0])
def test_near_duplicates_match_brute_force(documents, limit):
    found = by_key(simhash.near_duplicates(documents(ROWS), limit).collect())
    assert found == by_key(brute(ROWS))
    assert len({r[2] for r in found}) < len(ROWS) / 2


def test_long_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 7)
    for text in (LONG[:3000], "one two three", "one two three four five six seven eight nine", "a", ""):
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("limit", [simhash.LIMIT, 5])
def test_links_connect_all_fingerprints_within_two_bits(spark, limit):
    """Dense groups of fingerprints, so that buckets hold many."""
    rng = random.Random(3)
    prints = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(150)}
        prints |= {base ^ (rng.getrandbits(32) << 32) for _ in range(40)}  # one half is the same
    prints = sorted(prints)
    signed = [int(x) for x in np.array(prints, np.uint64).view(np.int64)]
    classes = spark.createDataFrame([(x,) for x in signed], "bits bigint")
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(classes, limit).distinct().collect()]
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for a, b in found:
        label[root(a)] = root(b)
    got = {p: root(p) for p in prints}
    label = {p: p for p in prints}
    for n, b in enumerate(prints):
        for a in prints[:n]:
            if (a ^ b).bit_count() <= 2:
                label[root(a)] = root(b)
    want = {p: root(p) for p in prints}
    names = {}
    assert all(names.setdefault(got[p], want[p]) == want[p] for p in prints)
    assert len(set(got.values())) == len(set(want.values())) > 4


def test_an_empty_table_gives_no_rows(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
