"""Steps that work in a row, once, or on parts that do not grow."""

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import instructions, retrieval, structure, tabular
from siltstone.plans.bindings import OFFERS, bound
from tests.test_growth import shuffled


def test_vectors_of_texts_are_made_in_their_row(spark):
    words = [f"word{i}" for i in range(300)]
    rows = spark.createDataFrame([(i, " ".join(words[i : i + 1 + i % 40])) for i in range(200)] + [(900, None), (901, "")], "chunk_id long, text string")
    got = []
    assert shuffled(spark, lambda: got.extend(retrieval.hashed_vectors(rows).collect())) == 0
    held = {r.chunk_id: r.embedding for r in got}
    assert held[900] == held[901] == [0.0] * 64 and all(abs(sum(x * x for x in held[i]) - 1) < 1e-6 for i in range(200))
    # the vectors of an index are those of its texts
    index = {r.chunk_id: r.embedding for r in retrieval.vectors_of(retrieval.build_lexical(rows)).collect()}
    assert index == held


def test_vectors_are_sent_once_for_each_band(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    v = np.concatenate([base] + [base + 0.05 * rng.standard_normal(base.shape) for _ in range(9)])
    # pairs at both sides of the bound, nearer to it than a step of a direction
    a, b = np.zeros(16), np.zeros(16)
    a[0], b[1] = 1, 1
    edge = [a, (0.95 + 1e-7) * a + (1 - (0.95 + 1e-7) ** 2) ** 0.5 * b, (0.95 - 1e-7) * a - (1 - (0.95 - 1e-7) ** 2) ** 0.5 * b]
    v = np.concatenate([v, edge])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, [float("nan")] * 16)], "k long, embedding array<double>").cache()
    df.count()
    got = []
    # one row a band and vector, and besides them the vectors, the counts of bands and the pairs
    assert shuffled(spark, lambda: got.extend(instructions.near_copies(df, "k", bands=96, bits=8, block=64).collect())) < 2.4 * 96 * len(v)
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = n @ n.T
    assert {(r.key, r.other) for r in got} == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if near[i, j] >= 0.95}
    assert all(abs(r.cosine - near[r.key, r.other]) < 1e-12 for r in got) and (400, 401) in {(r.key, r.other) for r in got}


def test_models_are_compared_on_rows_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        made.add(1)
        return float(x)

    rows = spark.range(400).select("id", seen(F.col("id") % 7).alias("a"), (F.col("id") % 3).cast("double").alias("b"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    train, test = tabular.split_rows(tabular.assemble(rows, ["a", "b"], "y"), "id")
    got = {r.model: r for r in tabular.compare_models(["bayes", "tree", "logistic"], train, test, "id").collect()}
    assert made.value <= 800 and got["tree"].accuracy == 1.0 and set(got) == {"bayes", "tree", "logistic"}


def test_lines_are_dealt_in_parts_of_so_many_characters(spark, monkeypatch):
    monkeypatch.setattr(structure, "PART", 1000, raising=False)
    docs = spark.createDataFrame([(i, "a line\n" * 50) for i in range(60)], "doc_id long, text string")
    found = structure.lines(docs)
    assert found.rdd.getNumPartitions() >= 21 and found.count() == 60 * 51
    assert structure.lines(docs.where("false")).count() == 0


def test_offers_are_dealt_in_parts_of_so_many_rows(spark):
    sf = "/root/testdata/sf0.001"
    dealt = bound(spark, sf, OFFERS, {"lineitem": "l_partkey", "part": "p_partkey"}, rows_each=500)
    assert dealt.rdd.getNumPartitions() >= 12 and sorted(map(str, dealt.collect())) == sorted(map(str, bound(spark, sf, OFFERS).collect()))
