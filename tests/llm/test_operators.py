"""Each operator on odd rows and empty tables, against results made without it."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import TESTDATA
from tallyfold.llm import (
    bpe,
    chat,
    counts,
    exact_dedup,
    language,
    minhash,
    nearest,
    packing,
    token_files,
    toxicity,
)

from .conftest import LONG, ODD

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def by_key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def as_rows(df):
    return [tuple(r) for r in df.collect()]


@lru_cache
def tokenizer_of(path):
    return Tokenizer.from_file(path)


def ids_of(path, text):
    return tokenizer_of(path).encode(text or "", add_special_tokens=False).ids


def some_texts(n=120, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé'1 ") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) + "." for _ in range(n)]


ROWS = ODD + [(100 + i, t) for i, t in enumerate(some_texts())]


# Tokens


def test_round_trip_is_that_of_the_library(documents):
    tokenizer = Tokenizer.from_file(WORD)

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    wanted = []
    for doc, text in ROWS:
        ids = ids_of(WORD, text)
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        wanted.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    assert by_key(bpe.round_trip(documents(ROWS), WORD).collect()) == by_key(wanted)


def test_backtracking_agrees_with_merging_letter_by_letter():
    rng = random.Random(5)
    own, tokenizer = bpe.Backtracker(WORD), Tokenizer.from_file(WORD)
    letters = "aaabeehilnorstu" + "éß"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 24))) for _ in range(3000)]
    assert own.words(words) == [e.ids for e in tokenizer.encode_batch(words, add_special_tokens=False)]


def test_every_character_of_the_fast_path_splits_as_the_library_does():
    from tallyfold.llm.words import RANGE, Encoder

    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}'s{chr(c)}" for c in range(1, RANGE)]
    for path in (WORD, BYTE):
        found = []
        for _, ids, lengths in Encoder(path).batches(texts, chars=700):
            found += [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
        assert found == [ids_of(path, t) for t in texts]


def test_texts_of_any_script_are_encoded_as_the_library_does():
    from tallyfold.llm.words import Encoder

    texts = [
        "J\u030cx \u01f0 字漢 it’s a<|endoftext|>b Ωσς İstanbul 🙂🙂 don’t J\u030c",
        "привет мир 1234 ﬁ e\u0301 <|endoftext|><|startoftext|>  z\u200b\n\n x",
        "I\u0307\u0307'S 'LL K\u212a A\u030a",
        "",
        "plain",
    ]
    for path, make in ((WORD, None), (WORD, bpe.Backtracker(WORD).words), (BYTE, None)):
        found = []
        for _, ids, lengths in Encoder(path, make).batches(texts):
            found += [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
        assert found == [ids_of(path, t) for t in texts]
    for path in (WORD, BYTE):
        assert counts.Counter(path).count(texts) == [len(ids_of(path, t)) for t in texts]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_counts_are_those_of_the_library(documents, path):
    wanted = []
    for doc, text in ROWS:
        n = len(ids_of(path, text))
        wanted.append((doc, len((text or "").encode()), n, n > 2048))
    assert by_key(counts.token_counts(documents(ROWS), path).collect()) == by_key(wanted)


def test_files_hold_the_ids_in_order_of_doc_id(spark, documents):
    found = token_files.stored_ids(documents(ROWS), WORD).orderBy("start").collect()
    wanted = {}
    for doc, text in ROWS:
        ids = [*ids_of(WORD, text), 2]
        wanted[(doc, zlib.crc32(np.array(ids, "<u4").tobytes()))] = len(ids)
    assert len(found) == len(ROWS)
    assert {(r.doc_id, r.ids_crc32): r.n_tokens for r in found} == wanted
    place = 0
    for row in found:
        assert row.start == place
        place += row.n_tokens
    order = [-math.inf if r.doc_id is None else r.doc_id for r in found]
    assert order == sorted(order)


@pytest.mark.parametrize("seed", range(4))
def test_grammars_expand_to_what_they_were_made_of(seed):
    rng = np.random.default_rng(seed)
    phrases = [rng.integers(0, 500, rng.integers(1, 9)) for _ in range(30)]
    docs = []
    for _ in range(200):
        parts = [phrases[i] for i in rng.integers(0, 30, rng.integers(0, 40))]
        docs.append(np.concatenate([*parts, [2]]))
    docs.append(np.full(3000, 7))  # pairs that overlap
    docs.insert(3, np.empty(0, np.int64))
    sizes = np.array([len(d) for d in docs])
    symbols, doc_symbols, rules, expansions = token_files.compress(np.concatenate(docs), sizes, 500)
    assert len(symbols) < sizes.sum() / 2
    row = {
        "base": 500, "width": 4, "null_ids": 1, "doc_ids": np.arange(len(docs) - 1, dtype="<i8").tobytes(),
        "doc_tokens": sizes.astype("<u4").tobytes(), "doc_symbols": doc_symbols.astype("<u4").tobytes(),
        "rules": rules.astype("<u4").tobytes(), "expansions": expansions.astype("<u4").tobytes(),
        "symbols": symbols.astype("<u4").tobytes(),
    }
    block = token_files.Block(row)
    assert (block.ids() == np.concatenate(docs)).all()
    for place in rng.integers(0, len(docs), 80):
        a, b = sorted(rng.integers(0, sizes[place] + 1, 2))
        assert block.slice(place, a, b).tolist() == docs[place][a:b].tolist()


def left_over(symbols, doc_symbols):
    """How often the commonest pair inside documents still stands."""
    inside = np.ones(max(0, len(symbols) - 1), bool)
    inside[np.cumsum(doc_symbols)[:-1] - 1] = False
    pairs = Counter(zip(symbols[:-1][inside].tolist(), symbols[1:][inside].tolist()))
    return max(pairs.values(), default=0)


def test_no_pair_that_repeats_is_left_and_more_rounds_never_give_more_symbols(spark, monkeypatch):
    from tallyfold.llm.words import encoder

    rows = spark.read.parquet(f"{TESTDATA}/sf0.1/documents.parquet").where("doc_id < 2300").orderBy("doc_id")
    _, flat, sizes = next(encoder(WORD).batches([r.text for r in rows.collect()], chars=1 << 30))
    sizes = sizes[: np.searchsorted(np.cumsum(sizes), token_files.BLOCK_TOKENS)]
    flat = flat[: sizes.sum()]
    assert len(flat) > 900_000
    for most, bits in ((token_files.MOST, 18), (2500, 6)):
        monkeypatch.setattr(token_files, "MOST", most)
        monkeypatch.setattr(token_files, "CELL_BITS", bits)
        before = len(flat)
        for rounds in (1, 2, 3, 6, 20, None):
            symbols, doc_symbols, rules, _ = token_files.compress(flat, sizes, 49_408, rounds)
            assert len(symbols) <= before and len(np.unique(rules, axis=0)) == len(rules)
            assert (token_files.expand(symbols, 49_408, rules) == flat).all()
            before = len(symbols)
        assert left_over(symbols, doc_symbols) < token_files.LEAST and before <= 0.56 * len(flat)
    monkeypatch.setattr(token_files, "RULES", 100)
    symbols, doc_symbols, rules, _ = token_files.compress(flat, sizes, 49_408)
    assert len(rules) == 100 and left_over(symbols, doc_symbols) >= token_files.LEAST
    # Ids that do not fit 16 bits.
    symbols, _, rules, _ = token_files.compress(flat + 100_000, sizes, 200_000)
    assert (token_files.expand(symbols, 200_000, rules) == flat + 100_000).all()


def test_pre_tokens_that_share_a_cell_are_told_apart(monkeypatch):
    from tallyfold.llm import words

    monkeypatch.setattr(words, "CELL_BITS", 3)
    texts = some_texts(60)
    for known in (10_000, 40):
        encoder = words.Encoder(WORD)
        encoder.book = words.Book(encoder.make, known)
        for _ in range(2):
            found = []
            for _, ids, lengths in encoder.batches(texts, chars=300):
                found += [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
            assert found == [ids_of(WORD, t) for t in texts]


def check_pieces(rows, documents_, path, end):
    texts = {}
    for doc, text in documents_:
        texts.setdefault(doc, []).append([*ids_of(path, text), end])
    sequences, starts = defaultdict(list), defaultdict(Counter)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        starts[(r.doc_id, r.doc_tokens)][(r.start, r.length, r.ids_crc32)] += 1
    for pieces in sequences.values():
        place = 0
        for offset, length in sorted(pieces):
            assert offset == place and length > 0
            place += length
        assert place <= 1024
    assert sum(r.length for r in rows) == sum(len(x) for d in texts.values() for x in d)
    for (doc, size), pieces in starts.items():
        own = [x for x in texts[doc] if len(x) == size]
        crcs = {
            (s, n): {zlib.crc32(np.array(x[s : s + n], "<u4").tobytes()) for x in own}
            for s, n, _ in pieces
        }
        assert all(crc in crcs[(s, n)] for s, n, crc in pieces)
        assert sum(n * k for (_, n, _), k in pieces.items()) == size * len(own)
    filled = [sum(n for _, n in p) for p in sequences.values()]
    return sum(0 if n & (n - 1) == 0 else 1024 - n for n in filled), sum(filled)


def test_packing_holds_each_id_once(documents):
    rows = packing.packed(documents(ROWS), BYTE).collect()
    check_pieces(rows, ROWS, BYTE, 0)


def test_packing_pads_little(spark):
    df = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").coalesce(1)
    rows = packing.packed(df, BYTE).collect()
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in filled.values())
    assert padding < 0.02 * sum(filled.values())


@pytest.mark.parametrize("seed", range(5))
def test_cuts_cost_no_more_than_any_other_choice(seed):
    """Against dynamic programming over all places, without a queue."""
    rng = np.random.default_rng(seed)
    ends = np.unique(rng.integers(1, 400, 60))
    costs = rng.choice([0.0, packing.SENTENCE], len(ends))
    costs[-1] = 0
    window = 128
    chosen = packing.cuts(ends, costs, window)
    price = dict(zip(ends.tolist(), costs.tolist()))

    def cost(a, b):
        n = b - a
        pad = 0 if n in (64, window) else window - n
        return pad + packing.SEQUENCE + price.get(b, packing.FORCED)

    places = sorted({0, *ends.tolist()})
    best = {0: 0.0}
    for b in places[1:]:
        best[b] = min((best[a] + cost(a, b) for a in places if a < b <= a + window), default=math.inf)
    total = sum(cost(a, b) for a, b in zip([0, *chosen], chosen))
    assert chosen[-1] == ends[-1] and all(b - a <= window for a, b in zip([0, *chosen], chosen))
    assert total <= best[int(ends[-1])] + 1e-9


# Duplicates


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def brute_components(rows, percent=85):
    """Every pair that shares a shingle is compared; groups are joined one by one."""
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    having = defaultdict(list)
    for i in sorted(sets):
        for shingle in sets[i]:
            having[shingle].append(i)
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for b in sorted(sets):
        shared = Counter(a for shingle in sets[b] for a in having[shingle] if a < b)
        for a, both in shared.items():
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return [
        (i, len(shingle_set(t)), root(i) if i is not None else None, i is None or root(i) == i)
        for i, t in rows
    ]


def edited(seed=1, groups=6, copies=25):
    """Groups of texts that differ in a few words, about as similar as is wanted."""
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(text) // 45 + 1)):
                text[rng.randrange(len(text))] = f"X{rng.randrange(5000)}"
            out.append((1000 + len(out), " ".join(text)))
    rng.shuffle(out)
    return out


def test_near_duplicates_match_brute_force(documents):
    rows = ODD + edited()
    found = minhash.near_duplicates(documents(rows))
    assert by_key(found.collect()) == by_key(brute_components(rows))


def test_tiles_of_large_buckets_match_brute_force(documents, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 4)
    monkeypatch.setattr(minhash, "LOT", 3)
    rows = edited(seed=2, groups=3, copies=60)
    found = minhash.near_duplicates(documents(rows))
    assert by_key(found.collect()) == by_key(brute_components(rows))


def test_tiles_meet_members_outside_the_largest_component_once_with_all(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 4)
    label = {i: 0 for i in range(80)} | {80: 80} | {i: 81 + i % 3 for i in range(81, 90)}
    rows = [(0, 7, i, n) for i, n in label.items()] + [(1, 7, i, n) for i, n in label.items() if i <= 80]
    rows += [(2, 7, i, 0) for i in range(50)]  # one component: settled
    df = spark.createDataFrame(rows, "band smallint, key bigint, id bigint, label bigint")
    found = minhash.tiles(minhash.open_members(df)).collect()
    met, held = Counter(), defaultdict(list)
    for r in found:
        held[(r.band, r.one, r.two)].append(r)
    for (band, one, two), members in held.items():
        for n, x in enumerate(members):
            for y in members[:n]:
                if x.label != y.label and (one == two or x.block != y.block):
                    met[(band, *sorted((x.id, y.id)))] += 1
    wanted = {(b, i, j) for b, last in ((0, 90), (1, 81)) for j in range(last) for i in range(j) if label[i] != label[j]}
    assert set(met) == wanted and set(met.values()) == {1}
    # 80 once, and the one outside with its own block and 20 more.
    assert sum(r.band == 1 for r in found) == 80 + 21


def test_long_words_are_told_apart(documents):
    """Blocks of 64 bytes in another order, alone and in sentences, and texts without blanks."""
    p, q = "a" * 64, "b" * 64
    rows = [(1, p + q + q + p), (2, q + p + p + q)]
    rows += [(10 + i, f"one two {t} four five six seven eight nine ten") for i, (_, t) in enumerate(rows[:2])]
    rng = random.Random(8)
    for n, script in enumerate(("字漢語文書中国人大日本年会社", "абвгдежзик", "กขฃคฅฆง", "QWxhZGRpbjpvcGVu")):
        words = ["".join(rng.choice(script) for _ in range(rng.randrange(1, 90))) for _ in range(20)]
        for m in range(4):
            some = words * 3 if m else list(words)
            some[m] = some[m][::-1]
            rows.append((100 + 10 * n + m, " ".join(some)))
    found = by_key(minhash.near_duplicates(documents(rows)).collect())
    assert found == by_key(brute_components(rows))
    assert {r[0] for r in found if r[0] == r[2]} >= {1, 2, 10, 11}


def test_many_texts_of_few_ids_stay_as_many(documents, spark, monkeypatch):
    texts = [f"same words here and there {i // 6} in all of these texts but for one {i}" for i in range(240)]
    texts += [" ".join(f"w{j}" if j != i else "X" for j in range(150)) for i in range(60)]
    rows = [(1 + i % 2, t) for i, t in enumerate(texts)] + [(7, texts[5])] * 2000
    sizes = []
    keep = minhash.written

    def counted(df):
        out = keep(df)
        sizes.append(out.count() if "sketch" not in out.columns and "set_a" not in out.columns else 0)
        if out.columns == ["id", "text"]:
            assert out.groupBy("id").count().where("count > 1").isEmpty() and out.count() <= 300
        return out

    monkeypatch.setattr(minhash, "written", counted)
    found = minhash.near_duplicates(documents(rows)).collect()
    by_text = brute_components([(1000 + i, t) for i, t in enumerate(dict.fromkeys(texts))], 85)
    of = dict(zip(dict.fromkeys(texts), (r[2] for r in by_text)))
    least = {}
    for doc, t in rows:
        least[of[t]] = min(least.get(of[t], doc), doc)
    assert by_key((r.doc_id, r.component_id) for r in found) == by_key((d, least[of[t]]) for d, t in rows)
    assert max(sizes) < 25 * 300  # a row for each band at most


def test_sketches_of_a_union_are_the_larger_registers():
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (700, 40))
    both = minhash.registers(np.union1d(a, b), 125)
    assert (both == np.maximum(minhash.registers(a, 125), minhash.registers(b, 125))).all()
    assert (both != minhash.registers(a, 125)).any()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    ids = rng.sample(range(10_000), 400)
    links = list(zip(ids[:150], ids[1:151])) + [(ids[200], x) for x in ids[201:]]
    label = {x: min(ids[:151]) for x in ids[:151]} | {x: min(ids[200:]) for x in ids[200:]}
    found = minhash.components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r.id: r.label for r in found.collect()} == label


def brute_exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    out = []
    for doc, text in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256((text or "").encode()).hexdigest()
        out.append((doc, keep, len(ids), doc == keep, sha))
    return out


@pytest.mark.parametrize("name", [F.xxhash64, lambda c: (F.length(c) % 3).cast("bigint")])
def test_exact_duplicates_match_brute_force_even_if_names_clash(documents, name):
    rng = random.Random(7)
    rows = ODD + [(200 + i, rng.choice(some_texts(30)) * rng.choice([1, 1, 40])) for i in range(150)]
    found = exact_dedup.exact_duplicates(documents(rows), name)
    assert by_key(found.collect()) == by_key(brute_exact(rows))


def test_chunks_make_up_the_text(spark):
    texts = [t for _, t in ROWS if t] + ["é" * 5000, "a.\n" * 3000, "🙂" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, chunks in df.select("text", exact_dedup.chunks(F.col("text"))).collect():
        assert "".join(chunks) == text
        assert all(len(c) <= 2048 for c in chunks)


# Search


def brute_nearest(rows, k):
    good = [
        (i, [float(x) for x in v]) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % 20 == 0}:
        scored = []
        for i, w in good:
            if i != q and len(w) == len(v):
                total = 0.0
                for x, y in zip(v, w):
                    total += x * y
                scored.append((-total, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def test_search_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(nearest, "TILE_ROWS", 50)
    rng = np.random.default_rng(1)
    nan, inf = float("nan"), float("inf")
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(400)]
    rows += [(400 + i, [1.0] + [0.0] * 7) for i in range(90)]  # ties
    rows += [(20, None), (40, []), (60, [0.0] * 8), (80, [1.0, None] + [0.0] * 6), (100, [nan] * 8)]
    rows += [(120, [inf] + [1.0] * 7), (140, [1.0, 2.0]), (141, [2.0, 2.0]), (None, [1.0] * 8)]
    rows += [(160, rows[160][1]), (161, rows[161][1]), (180, [1e30] * 8), (181, [1e-30] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("kind", F.lit(1))
    found = nearest.nearest(df, df.where("vec_id % 20 = 0"), k=20)
    assert by_key(found.collect()) == by_key(brute_nearest(rows, 20))


@pytest.mark.parametrize("repeated", [False, True])
def test_copies_of_one_vector_survive_k_times(spark, monkeypatch, repeated):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(200)]
    rows += [((205 if repeated and i % 2 else 1000) + i % 1000 * (not repeated), [3.0, 3.0, 0.0, -0.0]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    numbered = nearest.usable(df).withColumn("row", F.monotonically_increasing_id())
    assert nearest.candidates_of(numbered, 5).where("embedding[0] = 3").count() == (10 if repeated else 6)
    found = nearest.nearest(df, df.where("vec_id % 20 = 0"), k=5)
    assert by_key(found.collect()) == by_key(brute_nearest(rows, 5))


def test_more_candidates_make_more_parts(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART_ROWS", 5)
    assert nearest.n_parts(3) == 8 and nearest.n_parts(500) == 100
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = nearest.nearest(df, df.where("vec_id % 20 = 0"), k=3)
    tiles = []
    monkeypatch.setattr(nearest, "n_parts", lambda n: tiles.append(n) or 100)
    again = nearest.nearest(df, df.where("vec_id % 20 = 0"), k=3)
    assert by_key(found.collect()) == by_key(again.collect()) == by_key(brute_nearest(rows, 3))
    assert tiles == [500]


# Classifiers


def test_languages_are_told_apart_on_held_out_texts(spark):
    from tallyfold.llm.queries import op3_language

    root = f"{TESTDATA}/sf0.01"
    wanted = {r.doc_id: r.lang for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    rows = [r for r in op3_language(spark, root).collect() if r.held_out]
    assert sum(r.lang_pred == wanted[r.doc_id] for r in rows) >= 0.97 * len(rows) > 200
    assert all(0 <= r.score <= 1 for r in rows)


def test_a_mixed_text_has_both_languages():
    rng = np.random.default_rng(0)
    words = {n: ["".join(rng.choice(list(a), 5)) for _ in range(300)] for n, a in (("a", "abcdef"), ("b", "uvwxyz"))}
    table = np.zeros((2, language.BUCKETS))
    for row, name in enumerate("ab"):
        buckets, times = language.counted(language.trigrams(" ".join(words[name])))
        table[row, buckets] = times
    model = language.Model(["a", "b"], table)
    shares, _ = model.shares(" ".join(words["a"][:70] + words["b"][:30]))
    assert abs(shares[0] - 0.7) < 0.05 and abs(shares[1] - 0.3) < 0.05
    assert model.shares(" ".join(words["a"][:50]))[0].tolist() == [1, 0, 0]
    assert model.predict("qgqg hkhk 9")[2] > 0.5
    assert model.predict("12 !?")[0] == language.UNKNOWN


@pytest.mark.parametrize("seed", range(12))
def test_the_set_chosen_is_the_best_of_all_sets(seed):
    """Penalised likelihoods of every set of up to five components, each by expectation-maximisation."""
    rng = np.random.default_rng(seed)
    chance = rng.dirichlet(np.full(60, 0.3), 4).T + 1e-4
    chance = np.concatenate([chance / chance.sum(axis=0), np.full((60, 1), 1 / 60)], axis=1)
    shares = np.zeros(5)
    some = rng.choice(4, rng.integers(1, 4), replace=False)
    shares[some] = rng.dirichlet(np.full(len(some), 5.0))
    times = rng.multinomial(900, chance @ shares).astype(float)
    times, chance = times[times > 0], chance[times > 0]
    size = times.sum() / language.OVERLAP
    price = 0.5 * math.log(max(size, 2)) + math.log(5)
    values = {}
    for mask in range(1, 32):
        active = [i for i in range(5) if mask >> i & 1]
        _, likelihood = language.mixture(times, chance[:, active])
        values[tuple(active)] = likelihood / language.OVERLAP - price * (len(active) - 1)
    found = language.choose(times, chance, size)
    assert values[tuple(np.flatnonzero(found).tolist())] >= max(values.values()) - 1e-6
    assert abs(found.sum() - 1) < 1e-6


def test_as_many_languages_as_are_allowed_fit_the_driver():
    model = language.Model(["a"] * 3, np.ones((3, language.BUCKETS), np.uint32))
    assert model.chance.nbytes == 4 * language.BUCKETS * 4
    assert language.MODEL_BYTES == 24 * language.MOST_LANGUAGES * language.BUCKETS < 500e6


def test_all_languages_of_a_mixed_text_are_given(spark):
    from tallyfold.llm.queries import op3_language

    root = f"{TESTDATA}/sf0.01"
    real = spark.read.parquet(f"{root}/documents.parquet")
    model = language.learn(real)
    longest = {}
    for r in real.orderBy("n_chars", "doc_id").where("n_chars < 4000").collect():
        longest[r.lang] = r.text
    a, b = sorted(longest)[:2]
    rows = [(1, f"{longest[a][:2000]} {longest[b][:1000]}"), (2, "12 !?"), (3, longest[b])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in language.languages(df, model, shares=True).collect()}
    assert [x.lang for x in found[1].languages] == [a, b] and found[1].lang_pred == a
    assert abs(found[1].languages[0].share - 2 / 3) < 0.1
    assert found[2].languages == [] and [x.lang for x in found[3].languages] == [b]
    for r in op3_language(spark, root).collect():
        assert (r.languages[0].lang == r.lang_pred) if r.languages else r.noise == 1
        assert abs(sum(x.share for x in r.languages) + r.noise - 1) < 0.01


@pytest.mark.parametrize("lang", ["en", None])
def test_languages_of_odd_rows(documents, lang):
    df = documents(ODD, lang)
    found = by_key(language.languages(df, language.learn(df)).collect())
    has_letter = {4, 5, 6, 7, 8, 9, 10, -5}
    for doc, name, score, _ in found:
        if doc is not None:
            assert name == ("en" if lang and doc in has_letter else "und")
        assert 0 <= score <= 1
    assert len(found) == len(ODD)


def test_toxic_texts_are_found_among_held_out_ones(spark):
    from tallyfold.llm.queries import op7_toxicity

    root = f"{TESTDATA}/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    rows = [r for r in op7_toxicity(spark, root).collect() if r.held_out and r.doc_id in toxic]
    hits = sum(r.predicted for r in rows if toxic[r.doc_id] == 1)
    alarms = sum(r.predicted for r in rows if toxic[r.doc_id] == 0)
    n = sum(toxic[r.doc_id] for r in rows)
    assert hits >= 0.85 * n and alarms <= 0.03 * (len(rows) - n)


@pytest.mark.parametrize("marks", [[], [(4, 1), (5, 1)], [(4, 1), (7, 0), (8, None), (None, 1), (5, 7)]])
def test_toxicity_of_odd_rows(spark, documents, marks):
    df = documents(ODD)
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    rows = toxicity.toxicity(df, toxicity.learn(df, labels)).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_scores_are_those_of_a_plain_version(spark):
    """Each window compressed anew with dictionaries made anew, thresholds and sums by hand."""
    import zstandard

    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    texts = [" ".join(rng.choice(plain + ["grumpify", "zornig"] * 8 * (i % 2)) for _ in range(80)) for i in range(120)]
    model = toxicity.Model(texts, np.array([i % 2 for i in range(120)]))

    def size(window, content):
        how = zstandard.ZstdCompressionParameters.from_level(
            toxicity.LEVEL, source_size=2 * toxicity.WINDOW, dict_size=len(content), min_match=4,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        given.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(dict_data=given, compression_params=how).compress(window))

    toxic, ordinary = model.compressors.contents
    for text in [*texts[:6], "", "grumpify", "nothing of the kind here"]:
        data = toxicity.view(text)
        windows = toxicity.windows(data)
        assert b"".join(windows) == data
        saved = [size(w, ordinary) - size(w, toxic) for w in windows]
        over = [x for x in saved if x >= model.threshold]
        best = max([0, *saved])
        found = [1, math.log1p(sum(over)), best / 8, math.log1p(sum(over) / max(1, len(saved))), bool(over)]
        score = 1 / (1 + math.exp(-sum(a * b for a, b in zip(found, model.weights))))
        assert abs(score - model.score(text)) < 1e-9
    assert sum(model.score(t) >= 0.5 for t in texts[1::2]) >= 54 and sum(model.score(t) >= 0.5 for t in texts[::2]) <= 6


def test_the_toxicity_sample_is_bounded_before_it_is_collected(spark, documents, monkeypatch):
    held = {}

    class Model(toxicity.Model):
        def __init__(self, texts, toxic):
            held["texts"] = list(zip(texts, toxic.tolist()))
            super().__init__(texts, toxic)

    monkeypatch.setattr(toxicity, "Model", Model)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 300)
    monkeypatch.setattr(toxicity, "LONGEST_SAMPLED", 200)
    rows = [(1, f"text {i} of one id") for i in range(500)] + [(i, f"word {i} " * 5) for i in range(2, 40)]
    rows += [(40, "x" * 201), (2, "word 2 " * 5)]
    marks = [(i, i % 2) for i in range(1, 41)] + [(1, 1), (2, 1)]
    labels = spark.createDataFrame(
        [(i, n, 1, "x") for i, n in marks], "doc_id bigint, toxic int, id int, text string"
    )
    toxicity.learn(documents(rows), labels)
    for label in (0, 1):
        own = [t for t, n in held["texts"] if n == label]
        assert 200 < sum(map(len, own)) <= 300 and max(map(len, own)) <= 200
    assert sum("one id" in t for t, _ in held["texts"]) <= 1


# Dialogues


def brute_perspectives(rows):
    turns = [(c, t, "unknown" if r is None else r, x or "") for c, t, r, x in rows]
    out = []
    for conv in {t[0] for t in turns}:
        own = sorted(
            (t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3])
        )
        for me in {t[2] for t in own} - {"system"}:
            place = 0
            for n, (_, turn, who, text) in enumerate(own):
                head = "<|system|>\n" if who == "system" else f"<|user name={who}|>\n"
                head = "<|assistant|>\n" if who == me else head
                whole = f"{head}{text}<|end|>\n"
                train = (place + len(head), place + len(whole) - 1) if who == me else (None, None)
                out.append((conv, me, n, turn, who, whole, place, place + len(whole), *train))
                place += len(whole)
    return out


def test_perspectives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 4)
    rng = random.Random(2)
    rows = [
        (rng.choice([1, 2, None]), rng.choice([None, *range(-3, 20)]),
         rng.choice(["user", "assistant", "system", "critic", None]), rng.choice([None, "", "hé🙂", "text"]))
        for _ in range(150)
    ] + [(7, 0, "system", "alone")] + [(8, 1, "user", "again")] * 3 + [(9, i, "user", "x") for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = chat.perspectives(df.withColumn("size", F.lit(1)).withColumn("of", F.lit(2)))
    assert by_key(found.collect()) == by_key(brute_perspectives(rows))


def test_blocks_split_null_and_tied_turns_in_order(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 50)
    rows = [(None if i % 3 else 1, None if i % 2 else 7, f"s{i % 4}", f"text {i:05}", 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, speaker string, text string, copies bigint")
    found = chat.in_blocks(df).collect()
    sizes = Counter(r.block for r in found)
    assert len(found) == 4000 and max(sizes.values()) <= 4 * 50
    low = -(1 << 60)
    order = sorted(found, key=lambda r: (r.conv_id or low, r.turn or low, r.speaker, r.text))
    assert [r.block for r in order] == sorted(r.block for r in found)
    turns = df.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.col("speaker").alias("role"), "text")
    turns = turns.where("text < 'text 00300'")
    found = chat.perspectives(turns)
    assert by_key(found.collect()) == by_key(brute_perspectives([tuple(r) for r in turns.collect()]))


# Empty tables


def test_empty_tables_give_no_rows(spark, documents):
    none = documents([])
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    results = [
        minhash.near_duplicates(none),
        nearest.nearest(vectors, vectors),
        language.languages(none, language.learn(none)),
        token_files.stored_ids(none, WORD),
        counts.token_counts(none, WORD),
        packing.packed(none, BYTE),
        toxicity.toxicity(none, toxicity.learn(none, labels)),
        exact_dedup.exact_duplicates(none),
        chat.perspectives(turns),
        bpe.round_trip(none, WORD),
    ]
    assert [r.collect() for r in results] == [[]] * len(results)


def test_a_long_text_counts_whole(documents):
    found = counts.token_counts(documents([(1, LONG)]), WORD).first()
    assert found.n_tokens == 6 * 40_000
