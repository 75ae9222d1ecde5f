"""Trained language filter, probabilities of margins, donors of a fit, places by cells, leaks behind a Bloom filter."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.operators import calibration, donors, instructions, languages, offers, tabular

DATA = "/root/testdata/sf0.001/documents.parquet"


def brute_grams(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(961 * ord(t[i]) + 31 * ord(t[i + 1]) + ord(t[i + 2])) % 4096 for i in range(len(t) - 2)]


def test_grams():
    texts = ["Abc", None, "", "ab", "x", "Über 漢字 \U0001f600!", "the end", "q"]
    found, starts = languages.gram_buckets(pa.array(texts))
    assert [found[starts[i] : starts[i + 1]].tolist() for i in range(len(texts))] == [brute_grams(t) for t in texts]


def test_languages_held_out(spark):
    """Nearly all texts of rows that the model has not seen, and what it makes of odd ones."""
    rows = spark.read.parquet(DATA)
    model = languages.train_languages(rows.where("doc_id % 3 <> 0"))
    judged = languages.guess_language(rows.where("doc_id % 3 = 0"), model).join(rows.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 30").collect()
    assert len(judged) > 40 and sum(r.guess == r.lang for r in judged) / len(judged) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (4, "schÃ¶n und groÃŸ ist der Garten hinter dem Haus"), (5, "der Garten � ist"), (6, "les maisons de la ville sont grandes")], "doc_id long, text string")
    got = {r.doc_id: r for r in languages.guess_language(odd, model).collect()}
    assert [got[i].guess for i in (1, 2, 3)] == [None] * 3 and [got[i].margin for i in (1, 2, 3)] == [None] * 3
    assert got[4].mojibake and got[5].mojibake and not got[6].mojibake and got[6].guess == "fr"
    assert [r.doc_id for r in languages.keep_languages(odd, model, ["fr", "de"], 0.01).collect()] == [6]


def test_languages_of_nothing(spark):
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = languages.train_languages(rows)
    assert model.languages == [] and languages.guess_language(rows, model).first().guess is None
    one = languages.train_languages(rows.withColumn("lang", F.lit("en")))
    got = languages.guess_language(rows, one).first()
    assert (got.guess, got.margin) == ("en", None) and one.table(spark).count() == languages.BUCKETS


def test_curve_is_the_plain_fit(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=600) * 2
    y = (rng.random(600) < 1 / (1 + np.exp(-1.7 * m + 0.6))).astype(int)
    curve = calibration.fit_curve(spark.createDataFrame([(float(a), int(b)) for a, b in zip(m, y, strict=True)] + [(None, 1), (1.0, None)], "score double, label int"))
    p, n = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 0.0, math.log((n + 1) / (p + 1))
    for _ in range(50):
        q = 1 / (1 + np.exp(a * m + b))
        g = np.array([((t - q) * m).sum(), (t - q).sum()])
        w = q * (1 - q)
        da, db = -np.linalg.solve([[(w * m * m).sum(), (w * m).sum()], [(w * m).sum(), w.sum()]], g)
        a, b = a + da, b + db
    assert (curve.slope, curve.shift) == pytest.approx((a, b), rel=1e-6) and curve.slope == pytest.approx(-1.7, abs=0.4)


def test_curve_of_odd_rows(spark):
    parted = calibration.fit_curve(spark.createDataFrame([(float(i), int(i > 5)) for i in range(10)], "score double, label int"))
    assert parted.slope < 0 and math.isfinite(parted.slope) and math.isfinite(parted.shift)
    none = calibration.fit_curve(spark.createDataFrame([], "score double, label int"))
    assert (none.slope, none.shift) == (0.0, 0.0)
    same = calibration.fit_curve(spark.createDataFrame([(1.0, 1)] * 8, "score double, label int"))
    assert 1 / (1 + math.exp(same.slope + same.shift)) == pytest.approx(0.9, abs=1e-6)


def test_calibrated_model(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)]
    df = spark.createDataFrame([(i, a, b, float(a + b + rng.gauss(0, 1) > 1)) for i, a, b in rows], "id long, a double, b double, y double")
    train = tabular.assemble(df, ["a", "b"], "y").select("id", "features", "label")
    model, curve = calibration.fit_calibrated("svm_balanced", train, "id", folds=3)
    got = calibration.calibrated_predictions(model, curve, train, "id").collect()
    assert len(got) == 400 and all(0 < r.probability < 1 for r in got)
    assert abs(sum(r.probability for r in got) - sum(r.label for r in got)) < 25
    ordered = sorted(got, key=lambda r: r.score)
    assert all(x.probability <= y.probability for x, y in zip(ordered, ordered[1:], strict=False))


def brute_impute(train, rows, columns, k):
    out = []
    for r in rows:
        filled = list(r)
        for c in range(columns):
            if r[1 + c] is not None:
                continue
            near = []
            for d in train:
                both = [i for i in range(columns) if r[1 + i] is not None and d[1 + i] is not None]
                if d[1 + c] is not None and both:
                    near.append((math.sqrt(sum((r[1 + i] - d[1 + i]) ** 2 for i in both) * columns / len(both)), d[0], d[1 + c]))
            if near:
                best = sorted(near)[:k]
                filled[1 + c] = sum(v for *_, v in best) / len(best)
        out.append(tuple(filled))
    return sorted(out)


def test_donors_of_another_table(spark):
    rng = random.Random(8)
    hole = lambda x, p: None if rng.random() < p else float(x)
    cluster = [(rng.gauss(0, 30), rng.gauss(0, 30), rng.gauss(0, 30)) for _ in range(9)]
    point = lambda: [x + rng.gauss(0, 1) for x in rng.choice(cluster)]
    train = [(i, *[hole(x, 0.1) for x in point()]) for i in range(1500)] + [(5000 + i, 1.0, 2.0, 3.0) for i in range(40)] + [(6000, None, None, None)]
    rows = [(i, *[hole(x, 0.4) for x in point()]) for i in range(200)] + [(900, None, None, None), (901, 1.0, None, 3.0)]
    schema = "id long, a double, b double, c double"
    index = donors.fit_donors(spark.createDataFrame(train, schema), "id", ["a", "b", "c"], per_cell=60)
    filled, met = donors.impute(index, spark.createDataFrame(rows, schema).withColumn("key", F.lit("own")), "id", 5)
    assert filled.columns == ["id", "a", "b", "c", "key"]
    got = sorted(tuple(r)[:4] for r in filled.collect())
    want = brute_impute(train, rows, 3, 5)
    assert [x[0] for x in got] == [x[0] for x in want]
    for x, y in zip(got, want, strict=True):
        assert [v is None for v in x] == [v is None for v in y]
        assert [v for v in x if v is not None] == pytest.approx([v for v in y if v is not None], rel=1e-12)
    total = met.agg(F.sum("n_donors"), F.sum("n_met")).first()
    assert total[1] < 0.5 * total[0]


def test_donors_of_nothing(spark):
    schema = "id long, a double, b double"
    rows = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 2.0)], schema)
    filled, _ = donors.impute(donors.fit_donors(rows.where("false"), "id", ["a", "b"]), rows, "id")
    assert sorted((r.id, r.a is None or math.isnan(r.a), r.b is None) for r in filled.collect()) == [(1, False, True), (2, True, False)]


def brute_near(points, airports, km, n):
    def far(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(math.sqrt(h), 1.0))

    out = set()
    for p, lat, lon in points:
        near = sorted((far(lat, lon, a, b), i) for i, a, b in airports)
        out |= {(p, r + 1, i) for r, (d, i) in enumerate(x for x in near[:n] if x[0] <= km)}
    return out


@pytest.mark.parametrize("km", [60.0, 400.0, 9000.0])
def test_places_across_the_date_line_and_at_the_poles(spark, km):
    rng = random.Random(2)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(250)]
    spots += [(rng.uniform(-60, 60), rng.choice([-180, 180, 179.9, -179.9]) + rng.uniform(-0.3, 0.3)) for _ in range(120)]
    spots += [(rng.choice([-1, 1]) * rng.uniform(87, 90), rng.uniform(-180, 180)) for _ in range(120)] + [(90.0, 0.0), (-90.0, 77.0), (89.99, 10.0), (0.0, 0.0), (0.0, 0.5)]
    points, airports = [(i, a, b) for i, (a, b) in enumerate(spots[::2])], [(f"A{i:04d}", a + 0.1 if a < 89 else a, b) for i, (a, b) in enumerate(spots)]
    got = offers.airports_near(spark.createDataFrame(points, "point_id int, lat double, lon double"), spark.createDataFrame([*airports, ("NONE", None, 1.0)], "iata string, lat double, lon double"), km, 20)
    assert {(r.point_id, r["rank"], r.iata) for r in got.collect()} == brute_near(points, airports, km, 20)


def test_places_of_one_band_do_not_all_meet(spark):
    """At one latitude, a point meets what is about as near in longitude and not the whole band."""
    ring = spark.range(3600).select(F.concat(F.lit("R"), F.col("id").cast("string")).alias("iata"), F.lit(50.0).alias("lat"), (F.col("id") / 10 - 180).alias("lon"))
    points = spark.createDataFrame([(1, 50.0, 179.99)], "point_id int, lat double, lon double")
    near = offers.airports_near(points, ring, 60.0, 100)
    assert near.count() == 17 and near.where("iata = 'R0'").count() == 1


def test_bloom_filter_holds_back_nothing_it_was_given(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    words, n = instructions.bloom_words(rows.where("h % 2 = 0"), "h", 10_000)
    kept = instructions.maybe_among(rows, "h", words, n)
    assert kept.where("h % 2 = 0").count() == rows.where("h % 2 = 0").count() and words.count() <= n
    assert kept.where("h % 2 <> 0").count() < 0.06 * 10_000


def test_leaks_of_a_hot_gram(spark):
    hot = "one two three four five six seven eight"
    train = spark.createDataFrame([(i, f"{hot} own{i} words{i}") for i in range(30)] + [(99, "nothing of that kind is said in this other row at all"), (100, None)], "k int, text string")
    held = spark.createDataFrame([(i, f"before {hot} after{i}") for i in range(20)] + [(50, "short"), (51, None)], "e int, text string")
    got = sorted(tuple(r) for r in instructions.leaked(train, held, "k", "e").collect())
    assert got == [(k, e, 1) for k in range(30) for e in range(20)]
    assert instructions.leaked(train, held.where("false"), "k", "e").count() == 0
