"""The pipeline's stages on a small table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import quality
from tests.llm.test_operators import SCHEMA, brute_components, check_packing, corpus, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(120), SCHEMA)


def test_stages_in_order(spark, docs):
    (_, rules), (_, near), (_, scan), (_, mix), (_, pack) = corpus_pipeline.STAGES
    kept = rules(spark, docs, "")
    verdict = {r.doc_id: r.quality.kept for r in quality.judge(docs).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, k in verdict.items() if k}
    unique = near(spark, kept, "")
    groups = brute_components([tuple(r) for r in kept.collect()], 5, 80)
    assert unique.columns == docs.columns and {r.doc_id for r in unique.collect()} == {c for _, c in groups.values()}
    masked = scan(spark, unique, "")
    assert masked.columns == docs.columns and masked.count() == unique.count()
    mixed = mix(spark, masked, "")
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    packed = pack(spark, mixed, "")
    check_packing(packed)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert {d: n for d, n in Counter(r.doc_id for r in packed.where("piece = 0").collect()).items()} == copies
    assert all(words(r.text) for r in mixed.collect())


def test_run_equals_the_stages(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_corpus(spark, docs):
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
    assert none.count() == 0


def test_stages_on_odd_rows(spark):
    """Null, repeated and clashing: nulls in any column, repeated rows and ids, columns named as inner ones."""
    good = " ".join(f"plain{i % 37} words{i % 11} of this text{i}" for i in range(40))
    rows = [(None, good, None, None, None), (None, None, None, None, None), (1, good, "en", "a", 1), (1, good, "en", "a", 1), (2, good + " more", "en", "b", 1), (3, "", None, "a", 0), (4, None, "en", "a", None)]
    names = ("k", "row", "quality", "kept", "of", "copies", "i", "t", "once", "nth", "hit", "__spans", "__quality", "__copy", "id", "node")
    odd = spark.createDataFrame(rows, SCHEMA)
    for name in names:
        odd = odd.withColumn(name, F.lit(f"own {name}"))
    (_, rules), (_, near), (_, scan), (_, mix), (_, pack) = corpus_pipeline.STAGES
    for stage, ids in ((rules, [None, 1, 1, 2]), (near, [None, 1, 3, 4]), (scan, [None, None, 1, 1, 2, 3, 4])):
        got = stage(spark, odd, "")
        assert got.columns == odd.columns
        found = got.collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in found) == sorted((d is not None, d or 0) for d in ids)
        assert all(r[name] == f"own {name}" for r in found for name in names)
    mixed = mix(spark, odd, "")
    assert mixed.columns == odd.columns and {r.doc_id for r in mixed.collect()} <= {None, 1, 2} and all(r.k == "own k" for r in mixed.collect())
    packed = pack(spark, odd, "")
    check_packing(packed)
    assert {r.doc_id for r in packed.collect()} == {None, 1, 2, 3, 4}
