"""Pruned searches against the full ones."""

import random

import numpy as np
import pytest

from siltstone.operators import pruned, retrieval


@pytest.fixture(scope="module")
def index(spark):
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    texts = []
    for i in range(1500):
        tongue = i % 5
        texts.append((i, " ".join([f"t{tongue}"] * rng.randrange(1, 4) + [f"{rng.choice(common)}x{tongue}" for _ in range(rng.randrange(2, 30))] + [rng.choice(rare) for _ in range(rng.randrange(0, 4))])))
    texts += [(2000 + i, texts[7][1]) for i in range(30)] + [(3000, None), (3001, ""), (3002, "only once here")]
    return retrieval.build_lexical(spark.createDataFrame(texts, "chunk_id long, text string"))


@pytest.mark.parametrize("idf", ["floor", "raw"])
def test_lexical(spark, index, idf):
    rng = random.Random(6)
    asked = [(i, " ".join(rng.choice([f"c{rng.randrange(12)}x{i % 5}", f"r{rng.randrange(400)}", f"t{i % 5}"]) for _ in range(rng.randrange(1, 8)))) for i in range(60)]
    queries = spark.createDataFrame([*asked, (90, "only"), (91, "nowhere"), (92, ""), (93, None)], "query_id long, query string")
    hits, read = pruned.search_lexical_pruned(pruned.build_blocks(index, bits=4), queries, 7, idf, seeds=4)
    want = retrieval.search_lexical(index, queries, 7, negative_idf=idf)
    columns = ("query_id", "chunk_id", "rank", "score")
    assert sorted(tuple(r) for r in hits.select(*columns).collect()) == sorted(tuple(r) for r in want.select(*columns).collect())
    total = read.groupBy().sum("n_postings", "n_read").first()
    assert total[1] < 0.7 * total[0]


def test_lexical_on_nothing(spark):
    none = retrieval.build_lexical(spark.createDataFrame([], "chunk_id long, text string"))
    queries = spark.createDataFrame([(1, "a word")], "query_id long, query string")
    assert pruned.search_lexical_pruned(pruned.build_blocks(none), queries)[0].count() == 0


def vectors(spark, rows, name):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], f"{name} long, embedding array<double>")


@pytest.mark.parametrize("digits", [None, 6])
def test_dense(spark, digits):
    rng = np.random.default_rng(3)
    heads = 8 * rng.normal(size=(12, 16))
    x = np.concatenate([h + rng.normal(size=(200, 16)) for h in heads])
    x[50:90] = x[40]  # equal vectors tie
    rows, asked = vectors(spark, enumerate(x), "chunk_id"), vectors(spark, ((i, x[i * 37] / 3) for i in range(50)), "query_id")
    hits, met = pruned.search_dense_pruned(pruned.cluster_vectors(rows, per_cluster=100), asked, 9, digits)
    want = retrieval.search_dense(rows, asked, 9, digits)
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in hits.collect()}
    full = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in want.collect()}
    assert got.keys() == full.keys()
    for key, (chunk, score) in full.items():
        assert got[key][1] == pytest.approx(score, rel=1e-12)
        assert digits is None or got[key][0] == chunk
    total = met.groupBy().sum("n_vectors", "n_met").first()
    assert total[0] == 50 * len(x) and total[1] < 0.5 * total[0]


def test_dense_with_few_rows(spark):
    few = vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 0.0])], "chunk_id")
    asked = vectors(spark, [(5, [1.0, 1.0]), (6, [0.0, 0.0])], "query_id")
    hits, _ = pruned.search_dense_pruned(pruned.cluster_vectors(few), asked, 20)
    assert sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in hits.collect()) == [(5, 1, 1, 1.0), (5, 2, 2, 0.0), (6, 1, 1, 0.0), (6, 2, 2, 0.0)]
    assert pruned.search_dense_pruned(pruned.cluster_vectors(few.where("false")), asked, 20)[0].count() == 0


def test_every_text_with_a_word_has_a_direction(spark):
    """Two words of one component with opposite signs."""
    rows = spark.createDataFrame([(1, "Ennd, eaea."), (2, "..."), (3, None), (4, "Ennd")], "chunk_id long, text string")
    got = {r.chunk_id: r.embedding for r in retrieval.hashed_vectors(rows).collect()}
    assert any(got[1]) and any(got[4]) and not any(got[2]) and not any(got[3])
    assert sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-6)
