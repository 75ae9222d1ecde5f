"""Findings of the third review: cut references, whole moments, places and rows that are the same."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import donors, names, offers
from siltstone.sources import files, payloads
from siltstone.streaming import jobs

CUT = "<title>t</title><script>a && b</script><p title='x&amp y'>one&amp</p><p>R&D &amp;amp; &#33; &#33</p><h1>two &lt;&lt</h1>"


def test_references_without_a_semicolon_are_text(spark):
    page = spark.createDataFrame([(1, "https://x.uz", CUT)], "page_id int, url string, html string")
    assert files.pages_text(page).first().text == "t\none&amp\nR&D &amp; ! &#33\ntwo <&lt"


def test_headings_keep_cut_references(spark):
    page = spark.createDataFrame([("https://x.uz", CUT)], "url string, html string")
    assert payloads.product_details(page).first().name == "two <&lt"


def test_points_of_one_place_do_not_meet_all_airports_there(spark):
    """Places meet once, by a shuffle; each point still gets the first airports of its place by code."""
    points = spark.range(300).select(F.col("id").alias("point_id"), F.when(F.col("id") < 299, 10.0).otherwise(10.3).alias("lat"), F.lit(20.0).alias("lon"))
    airports = spark.range(400).select(F.format_string("A%03d", "id").alias("iata"), (10.0 + F.col("id") % 2 * 0.2).alias("lat"), F.lit(20.0).alias("lon"))
    near = offers.airports_near(points, airports, 60.0, 3)
    got = {(r.point_id, r["rank"], r.iata) for r in near.collect()}
    assert got == {(p, i + 1, f"A{2 * i + (p == 299):03d}") for p in range(300) for i in range(3)}
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_a_cached_row_part_of_a_second_too_old_is_not_fresh(spark):
    rows = spark.sql("SELECT 1 AS id, timestamp'2026-01-01 00:00:00.4' AS fetched_at UNION ALL SELECT 2, timestamp'2026-01-01 00:00:00.5'")
    now = F.lit("2026-01-01 00:15:00.5").cast("timestamp")
    assert [r.id for r in offers.fresh(rows, now).collect()] == [2]
    latest = rows.selectExpr("'s' AS store", "CAST(id AS STRING) AS url", "1.0 AS price", "fetched_at").union(spark.sql("SELECT 's', 'now', 1.0, timestamp'2026-01-01 00:15:00.5'"))
    assert {r.url for r in jobs.latest_offers(latest).collect()} == {"2", "now"}


def test_imputation_meets_cells_of_the_columns_that_both_have(spark):
    """What a row lacks cuts no cells, and donors of one place are met at most k times."""
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(4096)] + [(5000 + i, 2.0, float(i), 2.0) for i in range(500)]
    holes = [(9000 + i, rng.random(), None, rng.random()) for i in range(40)] + [(9900, 2.0, None, 2.0), (9901, 2.0, None, 2.0)]
    schema = "id long, a double, b double, c double"
    index = donors.fit_donors(spark.createDataFrame(rows, schema), "id", ["a", "b", "c"], per_cell=64)
    filled, met = donors.impute(index, spark.createDataFrame(holes, schema), "id", 5)
    got = {r.id: r.b for r in filled.collect()}
    for key, a, _, c in holes:
        near = sorted((math.sqrt(((a - x) ** 2 + (c - z) ** 2) * 3 / 2), i, y) for i, x, y, z in rows)[:5]
        assert got[key] == pytest.approx(sum(y for *_, y in near) / 5, rel=1e-12)
    assert met.count() == 42 and met.agg(F.avg("n_met")).first()[0] < 200 and {r.n_donors for r in met.collect()} == {4596}


def test_equal_names_and_equal_queries_are_met_once(spark):
    names_ = ["Small ring Brand#1", "SMALL RING brand#1", "hot bolt 12", None, "vitamin d3"]
    parts = spark.createDataFrame([(i, names_[i % 5]) for i in range(500)], "id long, name string")
    asked = spark.createDataFrame([(i, ["ring zz", "RING zz ring", "bolt mall", "", "nothing", "1 ol"][i % 6]) for i in range(60)], "query_id long, query string")
    index = names.index_names(parts, "id", "name")
    assert index.spellings.count() == 3
    pairs = {(q, i) for q, text in enumerate(["ring zz", "RING zz ring", "bolt mall", "", "nothing", "1 ol"] * 10) for i in range(500) if names_[i % 5] and any(w in names_[i % 5].lower() for w in text.lower().split())}
    assert {tuple(r) for r in names.search_names(index, asked).collect()} == pairs
    want = {(q, len(x := [i for p, i in pairs if p == q]), min(x), max(x)) for q in {q for q, _ in pairs}}
    assert {tuple(r) for r in names.count_names(index, asked).collect()} == want


def test_the_offers_table_needs_no_python_state(spark, tmp_path):
    """One row a window, store and url is written by a batch, by Spark's own aggregation; equal times go to the lower price."""
    schema = "store string, url string, price double, fetched_at timestamp"
    at = lambda second: datetime.datetime(2026, 1, 1, 0, 0, second)
    rows = [("s", "u", 5.0, at(1)), ("s", "u", None, at(2)), ("s", "u", 3.0, at(2)), ("s", "u", 4.0, at(2)), ("s", "v", None, at(1))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = jobs.offers_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/table", f"{tmp_path}/marks", 900)
    q.awaitTermination()
    assert q.recentProgress[0]["stateOperators"][0]["operatorName"] == "stateStoreSave"
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/table").select("url", "price", "fetched_at").collect()} == {("u", 3.0, at(2)), ("v", None, at(1))}
