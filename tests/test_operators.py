"""The library's own operators on hand-made rows."""

import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions import values as V
from siltstone.operators import audit, chunking, instructions, offers, retrieval, structure, sync, tabular
from siltstone.sources import files, payloads
from siltstone.streaming import jobs


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_cleaning_order(spark):
    dirty = "﻿It's  a\r\n\r\n \n\ntest\x00 of é​ \t\nend\tx  "
    assert one(spark, X.clean_text(F.col("t")), t=dirty) == "Itʼs a\n\ntest of é\nend\tx"
    assert one(spark, X.clean_text(F.col("t"), False), t="oʻz '") == "oʻz '"
    assert one(spark, X.sanitize(F.col("t")), t=" a\x07b\rc\x7f ") == "ab\rc"
    assert one(spark, X.clean_query(F.col("t"), 4), t="abc  def") == "abc"
    assert one(spark, X.clean_query(F.col("t")), t="  \n ") is None


def test_tokens_and_counts(spark):
    assert one(spark, X.tokens(F.col("t")), t="Salom, Dunyo_1! Ёж") == ["salom", "dunyo_1", "ёж"]
    assert one(spark, X.approx_tokens(F.col("t")), t="a, b!") == 4
    assert one(spark, X.word_count(F.col("t")), t="") == 0
    assert one(spark, X.pair_hash(F.col("a"), F.col("b")), a=" Hi  There ", b="X") == one(spark, X.pair_hash(F.col("a"), F.col("b")), a="hi there", b="x ")
    assert one(spark, X.reading_minutes(F.lit(350))) == 2 and one(spark, X.confidence(F.lit(None).cast("double"))) == "low"


def test_titles_prompts_and_paths(spark):
    assert one(spark, X.title(F.col("t"), F.lit("stem"), 5), t="\n  \nabc\nlong line") == "abc"
    assert one(spark, X.title(F.col("t"), F.lit("stem"), 5), t="too long first\nabc") == "stem"
    assert one(spark, X.truncate(F.col("t"), "...", 3), t="abcdef") == "abc..."
    with_input = one(spark, X.training_prompt(F.lit(" do "), F.lit(" in "), F.lit(" out "), "</s>"))
    assert "### Input:\nin\n" in with_input and with_input.endswith("out</s>")
    assert "### Input" not in one(spark, X.training_prompt(F.lit("do"), F.lit(None).cast("string"), F.lit("out"), ""))
    block = one(spark, X.source_block(F.lit(2), F.lit("body"), F.lit("Law"), F.lit(None).cast("string"), F.lit(""), F.lit(7)))
    assert block == "--- Manba 2 ---\nQonun: Law\nSahifa: 7\nMatn: body"
    assert spark.range(0).agg(X.sources_text(F.col("id"), F.lit("x")).alias("x")).first().x == X.NO_SOURCE
    assert tuple(one(spark, X.collection(F.col("p"), {"suv": "Suv kodeksi"}), p="kodekslar/suv/a.txt")) == ("kodekslar", "suv", "Suv kodeksi")
    assert tuple(one(spark, X.collection(F.col("p")), p="my_own slug.txt")) == ("other", "my_own slug", "My Own Slug")
    assert one(spark, X.chunk_id(F.lit("d"), F.lit(7))) == "d::00007"


def test_values(spark):
    assert one(spark, V.price_label(F.lit(1234.5), F.lit("USD"))) == "1,234.50 USD"
    assert one(spark, V.spaced_price(F.lit(12500.0))) == "12 500 UZS" and one(spark, V.duration_label(F.lit(195))) == "3h 15m"
    assert one(spark, V.size_label(F.lit(1536))) == "1.5 KB" and one(spark, V.size_label(F.lit(3 * 1024**3))) == "3.0 GB"
    assert one(spark, V.iso_minutes(F.lit("PT3H25M"))) == 205 and one(spark, V.iso_minutes(F.lit("PT40M"))) == 40
    day = F.lit(datetime.date(2026, 7, 1))
    assert one(spark, V.relative_days(F.col("t"), day), t="Ertaga yoki indin, ertagalik") == "Ertaga (2026-07-02) yoki indin (2026-07-03), ertagalik"
    assert one(spark, V.parse_price(F.lit("12.50 so'm"))) == 1250.0 and one(spark, V.parse_price(F.lit("n/a"))) is None
    assert one(spark, V.dosage(F.lit("Vitamin D3 2000 IU №60"))) == "2000 IU" and one(spark, V.pack_size(F.lit("x 30 таб"))) == "30"
    assert set(one(spark, V.query_tokens(F.lit("Vitamin D3")))) == {"vitamin", "d3", "витамин", "д3"}


def test_structure(spark):
    text = "\n".join([
        "Muqaddima", "Birinchi qism", "I BOʻLIM", "UMUMIY QOIDALAR", "1-Kichik boʻlim", "2-Kichik boʻlim", "1-BOB.", "Asosiy", "1-modda. Birinchi",
        "body one", "II bob. Yangi", "II BOʻLIM. Maxsus", "41929-modda. Ikkinchi", " body two ", "", "Ikkinchi qism", "3-modda. Uchinchi",
    ])
    got = structure.articles(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("nth").collect()
    assert [(r.article_number, r.section) for r in got] == [
        ("1", "1-kichik boʻlim. 2-Kichik boʻlim > 1-bob. Asosiy"), ("41929", "II boʻlim. Maxsus > II-bob. Yangi"), ("3", "Ikkinchi qism"),
    ]
    assert got[1].text == "41929-modda. Ikkinchi\nbody two" and text[got[1].start_offset :].startswith("41929")
    noisy = "a\nOldingi tahrirga qarang.\n(izoh qatori)\nLexUZ sharhi\nqator\nb"
    assert one(spark, structure.strip_noise(F.col("t")), t=noisy) == "a\nb"


def test_duplicate_articles_and_pages(spark):
    rows = spark.createDataFrame([("d", 1, "5", "x"), ("d", 2, "5", "x"), ("d", 3, "5", "y")], "doc_id string, nth int, article_number string, text string")
    assert [r.nth for r in structure.distinct_articles(rows).orderBy("nth").collect()] == [1, 3]
    at = spark.createDataFrame([("d", 0), ("d", 5), ("d", 6), ("e", 3)], "doc_id string, offset long")
    pages = spark.createDataFrame([("d", ["abcd", "efg"]), ("e", ["only"])], "doc_id string, pages array<string>")
    assert [r.page_number for r in structure.page_of(at, pages).orderBy("doc_id", "offset").collect()] == [1, 1, 2, None]


def test_chunks(spark):
    text = "First sentence here. " * 30 + "\n\n" + "Second part. " * 20
    parts = chunking.split_text(text, 100, 20)
    assert all(len(p) <= 100 for p in parts) and "".join(parts).count("First") >= 30
    assert all(text[a:].startswith(p[:20]) for a, p in zip(chunking.place_chunks(text, parts), parts, strict=True))
    with pytest.raises(ValueError):
        chunking.split_text("x", 10, 10)
    docs = spark.createDataFrame([(1, text), (2, "1-modda. A\nshort\n2-modda. B\n" + "long words " * 40), (3, None)], "doc_id long, text string")
    got = chunking.chunk_documents(docs, size=120, overlap=20).orderBy("doc_id", "chunk_index").collect()
    two = [r for r in got if r.doc_id == 2]
    assert two[0].text == "1-modda. A\nshort" and len(two) > 2 and {r.article_number for r in two[1:]} == {"2"}
    assert [r.chunk_index for r in two] == list(range(len(two))) and not [r for r in got if r.doc_id == 3]


def test_change_classification(spark):
    known = spark.createDataFrame([("1", "a", "h1"), ("2", "b", "h2"), ("3", "c", "h3")], "id string, file_path string, file_hash string")
    now = [("a", "h1"), ("b", "h9"), ("c", "h2"), ("d", "h3"), ("e", "h5"), ("f", "h5"), ("g", "h2")]
    got = {r.path: (r.outcome, r.document_id) for r in sync.classify_changes(spark.createDataFrame(now, "path string, file_hash string"), known).collect()}
    assert got["a"] == ("skipped_unchanged", "1") and got["b"] == ("updated", "2")
    assert got["c"] == ("updated", "3")  # b gave h2 free before
    assert got["d"][0] == "new"  # c gave h3 free before
    assert got["e"][0] == "new" and got["f"][0] == "skipped_duplicate" and got["g"][0] == "skipped_duplicate"


def test_tables(spark):
    table = spark.createDataFrame([("1", "old", 5, 5), ("2", "old", 5, 5)], "id string, status string, created_at int, updated_at int")
    got = {r.id: tuple(r) for r in sync.upsert(table, spark.createDataFrame([("2", "new"), ("3", "new")], "id string, status string"), F.lit(9)).collect()}
    assert got == {"1": ("1", "old", 5, 5), "2": ("2", "new", 5, 9), "3": ("3", "new", 9, 9)}
    vectors = spark.createDataFrame([("c1", [1.0, 2.0]), ("gone", [1.0, 1.0])], "chunk_id string, embedding array<float>")
    chunks = spark.createDataFrame([("c1", "d"), ("c2", "d")], "id string, document_id string")
    r = sync.integrity(vectors, chunks, 2).first()
    assert (r.orphans, r.missing, r.bad_dimension, r.ok) == (1, 1, 0, False)
    good, bad = sync.replace_vectors(vectors, spark.createDataFrame([("c1", [9.0, 9.0]), ("c3", [1.0])], "chunk_id string, embedding array<float>"), 2)
    assert {x.chunk_id: x.embedding for x in good.collect()} == {"c1": [9.0, 9.0], "gone": [1.0, 1.0]} and bad.count() == 1
    assert sync.wipe(table).count() == 0 and sync.lacking_vectors(chunks, vectors).first().id == "c2"


def test_lexical_search(spark):
    chunks = spark.createDataFrame([("a", "mehnat shartnomasi bekor qilish"), ("b", "soliq tolovlari"), ("c", "mehnat mehnat haqi"), ("d", "oila"), ("e", None)], "chunk_id string, text string")
    index = retrieval.build_lexical(chunks)
    asked = spark.createDataFrame([(1, "Mehnat"), (2, ""), (3, "yoq")], "query_id int, query string")
    assert [r.chunk_id for r in retrieval.search_lexical(index, asked, 5).orderBy("rank").collect()] == ["c", "a"]


def test_dense_search_and_fusion(spark):
    v = spark.createDataFrame([(f"c{i}", [float(i), 1.0]) for i in range(10)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    assert [r.chunk_id for r in retrieval.search_dense(v, q, 3).orderBy("rank").collect()] == ["c9", "c8", "c7"]
    hits = lambda rows: spark.createDataFrame(rows, "query_id string, chunk_id string, score double")
    dense, sparse = hits([("q", "c1", 3.0), ("q", "c2", 1.0)]), hits([("q", "c2", 7.0), ("q", "c3", 7.0)])
    got = {r.chunk_id: r.combined_score for r in retrieval.fuse(dense, sparse).collect()}
    assert got == {"c1": 0.5, "c2": 0.5, "c3": 0.5}
    assert {r.chunk_id: r.combined_score for r in retrieval.fuse(dense, hits([]), 1.0, 0.0).collect()} == {"c1": 1.0, "c2": 0.0}
    with pytest.raises(ValueError):
        retrieval.fuse(dense, sparse, 0.9, 0.9)


def test_compression_skips_and_goes_on(spark):
    rows = [("q", "a", "w1 w2 w3 w4", 0.9), ("q", "b", "w1 w2 w3 w4", 0.8), ("q", "c", "x" * 40, 0.7), ("q", "d", "y z", 0.6), ("r", "e", "long " * 9, 0.5)]
    got = {r.chunk_id: r.status for r in retrieval.compress(spark.createDataFrame(rows, "query_id string, chunk_id string, text string, reranker_score double"), budget=20).collect()}
    assert got == {"a": "kept", "b": "duplicate", "c": "budget", "d": "kept", "e": "kept"}


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (1, 3, "b")], "query_id int, rank int, key string")
    golden = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id int, key string")
    got = {r.query_id: r for r in retrieval.evaluate(hits, golden, 5).collect()}
    assert got[1].precision == pytest.approx(2 / 3) and got[1].recall == 1.0 and got[1].reciprocal_rank == 0.5 and got[1].hit_rank == 2
    assert got[1].ndcg == pytest.approx((1 / 1.5849625007 + 0.5) / (1 + 1 / 1.5849625007)) and got[2].ndcg == 0 and got[2].hit_rank is None
    assert retrieval.evaluation_summary(retrieval.evaluate(hits, golden.where("false"))).first().precision == 0.0


def test_offers(spark):
    rows = [(1, "p", "s1", "B", "10", 100.0, True), (2, "p", "s2", "b", "2,5", 50.0, True), (3, "p", "s3", None, "x", 0.0, True), (4, "p", "s4", "C", "30", None, False), (5, "p", "s5", "C", "100", 90.0, False)]
    o = spark.createDataFrame(rows, "offer_id int, product string, store string, brand string, package_size string, price double, in_stock boolean")
    assert [r.offer_id for r in offers.filter_offers(o, max_price=100).collect()] == [2, 5, 1]
    assert [r.offer_id for r in offers.filter_offers(o).collect()][-1] == 4
    r = offers.compare_offers(o, "product").first()
    assert (r.offers, r.cheapest_id, r.dearest_id) == (3, 2, 1)
    r = offers.badges(o, "product").first()
    assert (r.cheapest_id, r.best_value_id) == (2, 1)
    assert offers.market_summary(o, "product").first().offers == 4
    f = [("N1", "Uz", "HY", 1, datetime.datetime(2026, 1, 1, 22), 100, 0, 300.0), ("N2", "Turk", "TK", 1, datetime.datetime(2026, 1, 1, 13), 90, 1, None), ("N3", "Turk", "TK", 1, datetime.datetime(2026, 1, 1, 3), 200, 0, 200.0)]
    flights = spark.createDataFrame(f, "flight_number string, airline string, airline_code string, route int, departure_time timestamp, duration_minutes int, stops int, price double")
    assert [r.flight_number for r in offers.sort_flights(offers.filter_flights(flights, window="night")).collect()] == ["N3", "N1"]
    assert offers.filter_flights(flights, window="noon").count() == 3 and offers.filter_flights(flights, airline="tk").count() == 2
    pick = lambda c: offers.recommend(flights, "route", c).first().recommended
    assert (pick("eng arzon"), pick("eng tez"), pick("direct"), pick("?")) == ("N3", "N2", "N3", "N3")
    near = offers.airports_near(spark.createDataFrame([(1, 41.3, 69.2)], "point_id int, lat double, lon double"), spark.createDataFrame([("TAS", 41.26, 69.28), ("SKD", 39.7, 66.98)], "iata string, lat double, lon double"))
    assert [r.iata for r in near.collect()] == ["TAS"]


def test_tabular(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, "b"), (4, 4.0, None), (5, 4.0, "a")], "id long, x double, c string")
    assert tabular.imputations(df.drop("id")) == {"x": 3.0, "c": "a"}
    enc = tabular.fit_encoding(df.select("id", "c"))
    assert [tuple(r) for r in enc.apply(spark.createDataFrame([(9, "zz")], "id long, c string")).collect()] == [(9, 0, 0)]
    wide = tabular.fit_encoding(df.select("id", "c"), wide=1)
    assert [r.c for r in wide.apply(spark.createDataFrame([(9, "zz"), (8, "b")], "id long, c string")).orderBy("id").collect()] == [1, -1]
    filled = tabular.knn_impute(spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 100.0, 100.0), (4, 1.5, None)], "id long, a double, b double"), "id", ["a", "b"], k=2)
    assert filled.where("id = 4").first().b == 1.5
    scored = spark.createDataFrame([(1, 1.0, 0.9), (1, 0.0, 0.5), (0, 0.0, 0.5), (0, 0.0, 0.1)], "label int, prediction double, score double")
    r = tabular.classification_metrics(scored).first()
    assert (r.accuracy, r.precision, r.recall) == (0.75, 1.0, 0.5) and r.auc == 0.875
    assert [r.x for r in tabular.scale(df.select(F.lit(2.0).alias("x")), {"x": (2.0, 2.0)}).collect()] == [0.0] * 5
    train, test = tabular.split_rows(spark.range(1000).withColumnRenamed("id", "k"), "k")
    assert train.count() + test.count() == 1000 and 700 < train.count() < 900 and train.join(test, "k").count() == 0


def test_knn_impute_looks_among_all_rows(spark, monkeypatch):
    monkeypatch.setattr(tabular, "HOLE_ROWS", 40, raising=False)
    monkeypatch.setattr(tabular, "DONOR_ROWS", 700, raising=False)
    rng = random.Random(5)
    hole = lambda p, v: None if rng.random() < p else v
    rows = [(i, hole(0.03, float(rng.randrange(300))), hole(0.03, float(rng.randrange(300))), hole(0.03, float(rng.randrange(3)))) for i in range(3000)] + [(3000, None, None, None)]
    got = {r.id: r for r in tabular.knn_impute(spark.createDataFrame(rows, "id long, a double, b double, c double"), "id", ["a", "b", "c"]).collect()}
    assert len(got) == len(rows)
    for key, *x in rows:
        want = list(x)
        for c in (c for c in range(3) if x[c] is None):
            far = []
            for other, *y in rows:
                both = [i for i in range(3) if x[i] is not None and y[i] is not None]
                if both and y[c] is not None:
                    far.append((math.sqrt(sum((x[i] - y[i]) ** 2 for i in both) * 3 / len(both)), other, y[c]))
            near = sorted(far)[:5]
            want[c] = sum(v for *_, v in near) / len(near) if near else None
        assert [got[key].a, got[key].b, got[key].c] == want


def test_classifiers_and_saving(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7), int(i % 10 > 5)) for i in range(200)], "id long, a double, b double, y int")
    rows = tabular.assemble(df, ["a", "b"], "y")
    for kind in ("logistic", "tree", "bayes", "svm_balanced"):
        model = tabular.fit_model(kind, rows)
        assert tabular.classification_metrics(tabular.predictions(model, rows, "id")).first().auc > 0.9
    assert tabular.importances(tabular.fit_model("forest", rows), ["a", "b"])[0] == "a"
    tabular.save_model(model, f"{tmp_path}/model")
    parts = tabular.attributions(df, {"a": 2.0, "b": 0.0}, {"a": 4.5, "b": 3.0}, "id")
    assert tabular.global_attribution(parts).first().feature == "a" and tabular.local_attribution(parts, "id", 9).first().contribution == 9.0


def test_instruction_rows(spark):
    talk = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "gpt", "a2"), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "a")]
    got = instructions.conversation_pairs(spark.createDataFrame(talk, "conv_id int, turn int, role string, text string")).orderBy("pair").collect()
    assert [(r.instruction, r.input, r.output) for r in got] == [("q1", "", "a1"), ("q2", "User: q1\nAssistant: a1", "a2")]
    tree = [("1", None, "prompter", "p"), ("2", "1", "assistant", "a"), ("3", "9", "assistant", "orphan"), ("4", "2", "assistant", "b")]
    assert [r.message_id for r in instructions.tree_pairs(spark.createDataFrame(tree, "message_id string, parent_id string, role string, text string")).collect()] == ["2"]
    rows = [(1, "Do it", "", "fine answer"), (2, "do  it ", "", "another"), (3, " ", "", "x"), (4, "q", "", None), (5, "q", "", "no"), (6, "q", "", "good one"), (7, "w " * 9, "", "long")]
    labelled = instructions.clean_rows(spark.createDataFrame(rows, "k int, instruction string, input string, output string"), "k", max_words=8)
    assert {r.k: r.label for r in labelled.collect()} == {1: "kept", 2: "duplicate", 3: "invalid", 4: "invalid", 5: "length", 6: "kept", 7: "length"}
    train, val = instructions.split_train(spark.range(5), "id", 0.1)
    assert (train.count(), val.count()) == (4, 1)
    assert one(spark, instructions.scrub(F.col("t")), t="mail a.b@c.org id 4785380592391139 tel +998 90 123-45-67") == "mail <email> id <id> tel <phone>"


def test_audit(spark):
    log = [
        (1, 0, "user", None, "narx?", None), (1, 1, "tool", "flights", "Narx mavjud emas", None), (1, 2, "assistant", None, "bu 250 usd turadi", None),
        (2, 0, "user", None, "?", None), (2, 1, "tool", "flights", "narx mavjud emas", None), (2, 2, "assistant", None, "narx yoq", None), (2, 3, "assistant", None, "99 usd", ["call"]),
        (3, 0, "user", None, "viza?", None), (3, 1, "tool", "web_search", "see (https://a.uz/x). and https://b.uz", None), (3, 2, "assistant", None, "javob", None), (3, 3, "user", None, "yana", None), (3, 4, "assistant", None, "5 usd", None),
    ]
    df = spark.createDataFrame(log, "conv_id int, turn int, role string, tool_name string, text string, tool_calls array<string>")
    assert [(r.conv_id, r.turn) for r in audit.guard_prices(df).where("overridden").collect()] == [(1, 2)]
    fixed = {(r.conv_id, r.turn): r.audited for r in audit.append_sources(df).collect()}
    assert fixed[3, 2] == "javob\n\n**Manbalar:**\n- https://a.uz/x\n- https://b.uz" and fixed[3, 4] == "5 usd"
    results = [(1, 1, "search_products_tool", json.dumps([{"name": "A", "price": 12500, "store": "s"}])), (1, 2, "search_products_tool", json.dumps([{"name": "A", "price": 12500, "store": "s"}])), (2, 1, "find_cheapest_tool", "[]"), (3, 1, "weather", "{}"), (4, 1, "compare_products_tool", json.dumps({"comparison_table": [{"name": "B", "in_stock": False}]})), (5, 1, "search_products_tool", "{oops")]
    answers = spark.createDataFrame([(i, "free") for i in range(1, 6)], "round_id int, answer string")
    got = {r.round_id: r.answer for r in audit.grounded_answers(spark.createDataFrame(results, "round_id int, seq int, tool string, result string"), answers, "nothing").collect()}
    assert got[1] == "Topilgan mahsulotlar:\n1. A — 12 500 UZS, s" and got[2] == "nothing" and got[3] == "free" and got[5] == "nothing"
    assert got[4].startswith("Narxlar taqqoslash jadvali:\n1. B — narxi noma'lum UZS") and got[4].endswith("(sotuvda yo'q)")


def test_files(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "a").mkdir(parents=True)
    (root / "a" / "utf.txt").write_bytes("﻿salom".encode())
    (root / "a" / "cyr.TXT").write_bytes("привет".encode("windows-1251"))
    (root / "page.html").write_text("<html><style>x</style><body><p>Hello</p><script>bad()</script>world</body></html>")
    (root / "empty.txt").write_text(" \n ")
    (root / "scan.pdf").write_bytes(b"%PDF")
    (root / "skip.bin").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.load_files(files.scan_corpus(spark, str(root))).collect()}
    assert set(got) == {"utf.txt", "cyr.TXT", "page.html", "empty.txt", "scan.pdf"}
    assert got["utf.txt"].text == "salom" and got["cyr.TXT"].text == "привет" and got["cyr.TXT"].encoding == "windows-1251"
    assert got["page.html"].text == "Hello\nworld" and got["empty.txt"].error_message == "empty document" and got["scan.pdf"].status == "failed"


def test_csv_and_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("q", "", "a"), ("й", None, "b")], "instruction string, input string, output string")
    files.write_jsonl(df, f"{tmp_path}/j")
    assert files.read_jsonl(spark, f"{tmp_path}/j").where("_corrupt is null").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"instruction": "x", "output": "y"}\n\n{broken\n{"instruction": "x"}\n')
    assert files.read_jsonl(spark, f"{tmp_path}/bad.jsonl").where("_corrupt is not null").count() == 1
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", strict=True).collect()
    assert sorted(r.valid for r in files.validate_upload(spark, f"{tmp_path}/bad.jsonl").collect()) == [False, False, True]
    (tmp_path / "arr.json").write_text('[{"instruction": "x", "output": "y"}, {"output": "z"}]')
    assert sorted(r.valid for r in files.validate_upload(spark, f"{tmp_path}/arr.json").collect()) == [False, True]
    files.write_csv(df.select("instruction", "output"), f"{tmp_path}/c")
    assert files.read_csv(spark, f"{tmp_path}/c", "instruction string, output string").count() == 2
    assert files.align(df, files.DOCUMENTS).columns[:3] == ["id", "file_name", "file_path"]


def test_payloads(spark):
    offer = {"data": [{"itineraries": [{"duration": "PT5H30M", "segments": [{"departure": {"iataCode": "TAS", "at": "2026-07-01T08:00:00"}, "arrival": {"iataCode": "DXB", "at": "2026-07-01T11:00:00"}, "carrierCode": "HY", "number": "333"}, {"departure": {"iataCode": "DXB", "at": "2026-07-01T12:00:00"}, "arrival": {"iataCode": "IST", "at": "2026-07-01T15:30:00"}, "carrierCode": "FZ", "number": "1"}]}], "price": {"total": "250.40", "currency": "USD"}}], "dictionaries": {"carriers": {"HY": "Uzbekistan Airways"}}}
    r = payloads.flight_offers(spark.createDataFrame([(json.dumps(offer),)], "payload string")).first()
    assert (r.airline, r.origin, r.destination, r.stops, r.duration_minutes, r.price, r.cabin_class) == ("Uzbekistan Airways", "TAS", "IST", 1, 330, 250.4, "ECONOMY")
    legs = {"data": [{"flight_status": "active", "departure": {"iata": "TAS", "scheduled": "2026-07-01T08:00:00+00:00"}, "arrival": {"iata": "IST", "scheduled": "2026-07-01T07:00:00+00:00"}, "airline": {"name": "HY"}, "flight": {"iata": "HY1"}}, {"departure": {"iata": "TAS", "scheduled": None}, "arrival": {"scheduled": "x"}}]}
    got = payloads.schedule_legs(spark.createDataFrame([(json.dumps(legs),)], "payload string"))
    assert [(r.flight_number, r.duration_minutes, r.price) for r in got.collect()] == [("HY1", 0, None)]
    assert offers.flight_status(got, "hy1").count() == 1
    geo = {"features": [{"properties": {"name": "", "county": "C", "datasource": {"raw": {"iata": "tas"}}}, "geometry": {"coordinates": [69.2, 41.2]}}]}
    r = payloads.places(spark.createDataFrame([(json.dumps(geo),)], "payload string")).first()
    assert (r.iata, r.name, r.city, r.lat, r.lon) == ("TAS", "TAS", "C", 41.2, 69.2)
    assert payloads.search_results(spark.createDataFrame([(json.dumps({"organic": [{"title": "t"}] * 9}),)], "payload string"), n=3).count() == 3


def test_shop_pages(spark):
    oxymed = '<div class="product-item"><span class="product-item__name">Vitamin C 500 mg №20</span><div class="product-item__price">12 500<s>1</s></div><i class="product-item__avail">В наличии</i></div><a class="product-item__link" href="/p1">x</a>'
    euro = '<div class="product-item"><a href="/e1"><p>Brand</p></a><h3 itemprop="name">Omega 3</h3><meta itemprop="price" content="99000"></div>'
    pharma = '<div class="catalog_item_wrapp item"><div class="item-title"><a href="/c1"><span>Zinc 10 tab</span></a></div><b class="cml_man">B</b><div class="js_price_wrapper"><span class="values_wrapper">7 000 sum</span></div><div class="item-stock"><span class="value">yoq</span></div></div>'
    pages = spark.createDataFrame([("oxymed", "https://oxymed.uz/", oxymed), ("europharm", "https://e.uz/", euro), ("pharmaclick", "https://p.uz/", pharma)], "store string, url string, html string")
    got = {r.store: r for r in payloads.listing_offers(pages).collect()}
    assert (got["oxymed"].price, got["oxymed"].dosage, got["oxymed"].package_size, got["oxymed"].in_stock) == (12500.0, "500 mg", "20", True)
    assert (got["europharm"].brand, got["europharm"].url, got["europharm"].in_stock) == ("Brand", "https://e.uz/e1", True)
    assert (got["pharmaclick"].price, got["pharmaclick"].package_size, got["pharmaclick"].in_stock) == (7000.0, "10", False)
    detail = '<h1>N</h1><div class="product-prop__item"><span class="product-prop__name">Производитель</span><span class="product-prop__value">M</span></div><div class="product-instruct__item"><span class="product-instruct__name">Описание</span><span class="product-instruct__desc">D</span></div>'
    got = payloads.product_details(spark.createDataFrame([("https://oxymed.uz/1", detail), ("https://x.uz", '<meta name="description" content="m"><h1>H</h1>')], "url string, html string")).orderBy("url").collect()
    assert (got[0].name, got[0].brand, got[0].description) == ("N", "M", "D") and (got[1].name, got[1].description, got[1].brand) == ("H", "m", None)


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    for i, rows in enumerate([[("a", "h1"), ("b", "h2")], [("a", "h1"), ("b", "h3"), ("c", "h1")]]):
        spark.createDataFrame(rows, "path string, file_hash string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("path string, file_hash string").parquet(str(source))
        jobs.sync_stream(stream, f"{tmp_path}/table", f"{tmp_path}/cp").awaitTermination()
    got = {(r.file_path, r.file_hash, r.batch_id) for r in spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/table").collect()}
    assert got == {("a", "h1", 0), ("b", "h2", 0), ("b", "h3", 1)}
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    spark.createDataFrame([("q", 2, at(1)), ("q", 0, at(2)), ("r", 1, at(3))], "query string, result_count int, searched_at timestamp").write.parquet(f"{tmp_path}/s")
    events = spark.readStream.schema("query string, result_count int, searched_at timestamp").parquet(f"{tmp_path}/s")
    q = jobs.trending_stream(events).writeStream.outputMode("complete").format("memory").queryName("trend").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.query: r.searches for r in spark.table("trend").collect()} == {"q": 1, "r": 1}
    spark.createDataFrame([("s", "u", 1.0, at(1)), ("s", "u", 2.0, at(9))], "store string, url string, price double, fetched_at timestamp").write.parquet(f"{tmp_path}/o")
    rows = spark.readStream.schema("store string, url string, price double, fetched_at timestamp").parquet(f"{tmp_path}/o")
    jobs.offers_stream(rows, f"{tmp_path}/offers", f"{tmp_path}/cp2").awaitTermination()
    assert [r.price for r in jobs.read_offers(spark, f"{tmp_path}/offers").collect()] == [2.0]
    later = datetime.datetime(2026, 1, 1, 1, 0, 0)
    spark.createDataFrame([("s", "v", 3.0, later)], "store string, url string, price double, fetched_at timestamp").write.mode("append").parquet(f"{tmp_path}/o")
    jobs.offers_stream(rows, f"{tmp_path}/offers", f"{tmp_path}/cp2").awaitTermination()
    assert [r.price for r in jobs.read_offers(spark, f"{tmp_path}/offers").collect()] == [3.0]
    assert not (tmp_path / "offers" / "part=0").exists()


def test_lexical_search_deals_hot_terms(spark):
    """A term of most chunks is dealt over parts; the result is that of the plain formula."""
    texts = {i: "common " + " ".join(f"w{(i * k) % 7}" for k in range(1, 4)) + (" rare" if i == 5 else "") for i in range(40)}
    texts[40] = "other words here"
    index = retrieval.build_lexical(spark.createDataFrame(list(texts.items()), "chunk_id int, text string"))
    asked = spark.createDataFrame([(1, "common w3 rare"), (2, "w1 w1 w5")], "query_id int, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.search_lexical(index, asked, 50, negative_idf="raw").collect()}
    docs = {i: t.split() for i, t in texts.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    want = {}
    for query, words in ((1, "common w3 rare"), (2, "w1 w1 w5")):
        for i, d in docs.items():
            score = 0.0
            for w in words.split():
                df, tf = sum(w in x for x in docs.values()), d.count(w)
                score += (math.log(len(docs) - df + 0.5) - math.log(df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean))
            if round(score, 9) > 0:
                want[query, i] = score
    assert got == pytest.approx(want, abs=1e-8)


def test_dense_search_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 20)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    v = spark.createDataFrame([(i, [float(i % 30), float(i % 7)]) for i in range(100)], "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(8)], "query_id int, embedding array<float>")
    got = {}
    for r in retrieval.search_dense(v, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    for i in range(8):
        assert got[i] == sorted(range(100), key=lambda c: (-(c % 30 + i * (c % 7)), c))[:5]
    assert retrieval.search_dense(v, q.where("false")).count() == 0 and retrieval.search_dense(v.where("false"), q).count() == 0


def test_hashed_vectors_and_prompts(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, None), (3, "...")], "chunk_id int, text string")
    got = {r.chunk_id: r.embedding for r in retrieval.hashed_vectors(rows, dimension=8).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1.0, abs=1e-6) and got[2] == got[3] == [0.0] * 8
    asked = spark.createDataFrame([(1, "why"), (2, "how")], "query_id int, query string")
    hits = spark.createDataFrame([(1, 1, "x", "kept"), (1, 2, "y", "duplicate"), (1, 3, "z", "kept"), (2, 1, "y", "budget")], "query_id int, rank int, text string, status string")
    made = {r.query_id: r for r in retrieval.prompts(asked, hits, F.concat(F.col("number").cast("string"), F.lit(":"), "text"), "{context}|{question}", "be brief", "nothing").collect()}
    assert [tuple(m) for m in made[1].messages] == [("system", "be brief"), ("user", "1:x\n\n2:z|why")] and made[1].answer is None
    assert made[2].messages is None and made[2].answer == "nothing" and made[2].answer_found is False


def test_chunks_carry_name_and_page(spark):
    pages = ["Law on rest\n1-modda. First\nbody", "2-modda. Second\nmore"]
    docs = spark.createDataFrame([(1, pages, "a/law.txt"), (2, ["plain text"], "two.v2.html"), (3, ["x" * 200, "tail"], "long.txt")], "doc_id int, pages array<string>, file string")
    got = {(r.doc_id, r.chunk_index): r for r in chunking.chunk_documents(docs, pages_col="pages", name_col="file").collect()}
    assert [(got[1, i].law_name, got[1, i].article_number, got[1, i].page_number) for i in (0, 1)] == [("Law on rest", "1", 1), ("Law on rest", "2", 2)]
    assert got[2, 0].law_name == "plain text" and got[2, 0].page_number is None
    assert got[3, 0].law_name == "long" and got[3, 0].page_number == 1


def test_lookups_and_healing(spark):
    at = lambda d: datetime.datetime(2026, 1, d)
    docs = spark.createDataFrame([("1", "h1", "p1", "indexed", at(1)), ("2", "h2", "p2", "failed", at(2)), ("3", "h1", "p3", "indexed", at(3))], "id string, file_hash string, file_path string, status string, created_at timestamp")
    assert {r.id for r in sync.find_documents(docs, file_hash="h1").collect()} == {"1", "3"} and sync.find_documents(docs, file_hash="h1", file_path="p3").first().id == "3"
    assert [r.id for r in sync.list_documents(docs).collect()] == ["3", "2", "1"] and [r.id for r in sync.list_documents(docs, "indexed").collect()] == ["3", "1"]
    chunks = spark.createDataFrame([("b", "1", 1, "two"), ("a", "1", 0, "one"), ("c", "2", 0, "x")], "id string, document_id string, chunk_index int, text string")
    assert [r.id for r in sync.chunks_of(chunks, docs.where("id = '1'")).collect()] == ["a", "b"]
    vectors = spark.createDataFrame([("a", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    healed = sync.heal_vectors(chunks, vectors, lambda rows, i, t: retrieval.hashed_vectors(rows, i, t, 2))
    assert {r.chunk_id for r in healed.collect()} == {"a", "b", "c"} and sync.lacking_vectors(chunks, healed).count() == 0


def test_sort_orders_and_strict_rates(spark):
    o = spark.createDataFrame([(1, "b", "Z", None, "USD"), (2, "A", "y", 2.0, "USD"), (3, None, "x", 1.0, "XXX")], "offer_id int, name string, store string, price double, currency string")
    order = lambda by: [r.offer_id for r in offers.sort_offers(o, by).collect()]
    assert (order("price"), order("name"), order("store")) == ([3, 2, 1], [3, 2, 1], [3, 2, 1])
    rates = spark.createDataFrame([("USD", 2.0)], "currency string, rate double")
    with pytest.raises(Exception, match="no rate from XXX"):
        offers.convert(o, rates, "UZS").collect()
    assert {r.offer_id: r.converted for r in offers.convert(o, rates, "UZS", strict=False).collect()} == {1: None, 2: 4.0, 3: None}
    assert {r.offer_id: r.converted for r in offers.convert(o.where("offer_id < 3"), rates, "UZS").collect()} == {1: None, 2: 4.0}


def test_upload_report(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instruction": "x", "output": "y"}\n\n[1]\n{broken\n')
    (tmp_path / "b.json").write_text('[{"instruction": "x", "output": "y"},\n {"output": "z"}]')
    assert tuple(files.upload_report(files.validate_upload(spark, str(tmp_path))).first()) == (5, 2, 3)


def test_splits_by_hash(spark):
    rows = spark.range(1000).withColumn("s", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise((F.col("id") % 2).cast("string")))
    train, val = (({r.id for r in part.collect()}) for part in instructions.split_train(rows, "id", 0.1))
    assert len(val) == 100 and not train & val and len(train | val) == 1000
    picked = [{r.id for r in instructions.first_by_hash(rows.repartition(n), "id", 300).collect()} for n in (1, 7)]
    assert picked[0] == picked[1] and len(picked[0]) == 300 and val <= picked[0]
    assert instructions.first_by_hash(rows, "id", 0).count() == 0 and instructions.first_by_hash(rows, "id", 5000).count() == 1000
    parts = instructions.stratified_split(rows, "s", "id").groupBy("s").agg(F.count_if(F.col("part") == "val").alias("val"), F.count(F.lit(1)).alias("n"))
    assert {r.s: (r.val, r.n) for r in parts.collect()} == {None: (10, 100), "0": (40, 400), "1": (50, 500)}
    mixed = instructions.mix_slices({"a": (rows.where("id < 500"), 0.7), "b": (rows.where("id >= 500"), 0.3)}, 100, "id").groupBy("slice").count()
    assert {r["slice"]: r["count"] for r in mixed.collect()} == {"a": 70, "b": 30}
    first, second = tabular.split_rows(rows, "id")
    assert first.count() + second.count() == 1000 and first.join(second, "id").count() == 0 and 750 < first.count() < 850


def test_near_copies(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    v = np.concatenate([base, base[:20] + 0.02 * rng.standard_normal((20, 16)), base[:1].repeat(30, 0), np.zeros((1, 16))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "k int, embedding array<double>")
    n = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    near = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if n[i] @ n[j] >= 0.95}
    for block in (1024, 8):
        got = {(r.key, r.other) for r in instructions.near_copies(df, "k", block=block).collect()}
        linked, parent = got, {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for a, b in linked:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        assert got <= near and all(root(a) == root(b) for a, b in near)
    kept = {r.k for r in instructions.drop_near_copies(df.select("k"), df, "k").collect()}
    assert kept == set(range(60)) | {110, 500}
    assert instructions.near_copies(df.where("false"), "k").count() == 0


def test_leaks_of_long_texts(spark):
    words = [f"w{i}" for i in range(30_000)]
    train = spark.createDataFrame([(1, " ".join(words)), (2, "short"), (3, None)], "k int, text string")
    held = spark.createDataFrame([(9, " ".join(words[20_000:20_010])), (8, " ".join(words[:7])), (7, "w1 w3 " * 9)], "e int, text string")
    assert [tuple(r) for r in instructions.leaked(train, held, "k", "e").collect()] == [(1, 9, 3)]


def test_auc_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(tabular, "SCORE_RANGES", 4)
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 1), round(rng.random(), 2)) for _ in range(400)]
    r = tabular.classification_metrics(spark.createDataFrame(rows, "label int, prediction int, score double")).first()
    pos, neg = [s for y, _, s in rows if y], [s for y, _, s in rows if not y]
    assert r.auc == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)))
    assert r.accuracy == pytest.approx(sum(y == p for y, p, _ in rows) / 400)
    one_kind = spark.createDataFrame([(1, 1, 0.5)], "label int, prediction int, score double")
    assert tabular.classification_metrics(one_kind).first().auc is None
