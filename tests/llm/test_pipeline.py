"""The stages of the pipeline, each against brute force on its own input."""

import random
from collections import Counter

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from conftest import TESTDATA
from tallyfold.llm import queries as registered
from tallyfold.llm.common import written

from .test_operators import as_rows, brute_components, by_key, check_pieces, edited, shingle_set

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_are_those_wanted():
    assert list(STAGES) == ["language", "toxicity", "exact", "near", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def mixed(spark):
    """Documents with nulls, copies, near copies, toxic words and clashing extra columns."""
    rng = random.Random(6)
    real = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in real]
    rows += [(r[0] + 10_000, *r[1:]) for r in rng.sample(rows, 40)]
    rows += [(20_000 + i, t, "en", "s", len(t)) for i, t in edited(seed=9, groups=2, copies=10)]
    rows += [(i, t, None, None, None) for i, t in ((30_000, None), (30_001, ""), (30_002, "1 2 3"), (None, "the and of them"))]
    rows += rows[:3]
    clash = "score double, kept int, id int, sha string, _kept_doc_id int"
    return spark.createDataFrame(
        [r + (0.5, 1, 2, "x", 3) for r in rows],
        f"doc_id bigint, text string, lang string, source string, n_chars bigint, {clash}",
    )


def test_stages_keep_what_brute_force_keeps(spark, mixed):
    root = f"{TESTDATA}/sf0.01"
    docs = written(mixed)
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = written(stage(spark, docs, root))
        assert after.dtypes == docs.dtypes
        before, kept = as_rows(docs), as_rows(after)
        assert not Counter(map(repr, kept)) - Counter(map(repr, before))
        texts = {r[1] for r in kept}
        if name == "language":
            gone = Counter(map(repr, before)) - Counter(map(repr, kept))
            assert {r[0] for r in before if repr(r) in gone} == {30_000, 30_001, 30_002}
        elif name == "toxicity":
            words = ("idiot", "clown", "pathetic", "worthless", "scum", "moron", "loser", "stupid")
            bad = [r for r in before if sum(r[1].lower().split().count(w) for w in words) > 2]
            assert bad and sum(r[1] not in texts for r in bad) >= 0.9 * len(bad)
            clean = [r for r in before if r[2] == "en" and not any(w in r[1].lower() for w in words)]
            assert sum(r[1] in texts for r in clean) >= 0.97 * len(clean)
        elif name == "exact":
            best = {}
            for r in before:
                best[r[1]] = max(best.get(r[1], -1), -1 if r[0] is None else r[0])
            assert by_key((t, i) for t, i in best.items()) == by_key(
                (r[1], -1 if r[0] is None else r[0]) for r in kept
            )
        else:
            wanted = {i for i, _, _, stays in brute_components([(r[0], r[1]) for r in before], 80) if stays}
            assert {r[0] for r in kept} == wanted and len(kept) == len(wanted)
            assert len(kept) < len(before)
        docs = after
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = STAGES["packing"](spark, docs, root).collect()
    check_pieces(pieces, [(r[0], r[1]) for r in as_rows(docs)], path, 0)


def components_at(rows, percent):
    """The smallest id of each component, from all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for b in sorted(sets):
        for a in (a for a in sorted(sets) if a < b):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {root(i) for i in sets}


def test_near_copies_from_a_similarity_of_80_percent_go(spark):
    # Without the last words two texts are similar by 80/100, 81/100, 84/100, 79/100 shingles.
    rows = []
    for n, shared in enumerate((80, 81, 84, 79)):
        words = [f"{n}w{k}" for k in range(104)]
        rows += [(10 * n, " ".join(words)), (10 * n + 1, " ".join(words[: shared + 4]))]
    rows += edited(seed=9, groups=2, copies=10) + edited(seed=11, groups=4, copies=12)[::4]
    rows = [(i if i < 1000 else 1000 + n, t) for n, (i, t) in enumerate(rows)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    kept = as_rows(STAGES["near"](spark, docs, f"{TESTDATA}/sf0.001"))
    wanted = components_at(rows, 80)
    assert {r[0] for r in kept} == wanted and len(kept) == len(wanted)
    assert {0, 10, 20, 30, 31} == {i for i in wanted if i < 1000}
    assert wanted < components_at(rows, 85)


def test_empty_tables_pass_through(spark, mixed):
    docs = mixed.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, f"{TESTDATA}/sf0.001"))
        assert docs.count() == 0


def test_queries_with_sql_match_it(spark):
    con = duckdb.connect()
    root = f"{TESTDATA}/sf0.01"
    for table in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet'")
    for name, sql in registered.oracle_sql().items():
        found = registered.queries()[name](spark, root)
        wanted = con.execute(sql)
        names = [column[0] for column in wanted.description]
        assert by_key(found.select(names).collect()) == by_key(wanted.fetchall())
