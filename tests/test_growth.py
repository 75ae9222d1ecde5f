"""What is shuffled, held and written grows with the input and not faster."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking, languages, pruned, retrieval
from siltstone.session import slices


def shuffled(spark, work) -> int:
    """Records that stages of `work` shuffle."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages() -> dict[int, int]:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    known = stages()
    work()
    return sum(n for stage, n in stages().items() if stage not in known)


@pytest.mark.parametrize("search", ["full", "pruned"])
def test_lexical_search_shuffles_no_scores_of_all_pairs(spark, search):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    texts = spark.createDataFrame([(i, " ".join(rng.choices(words, k=80))) for i in range(600)], "chunk_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices(words, k=6))) for i in range(50)], "query_id long, query string")
    hits = []

    def work():
        index = retrieval.build_lexical(texts)
        found = retrieval.search_lexical(index, queries, 3) if search == "full" else pruned.search_lexical_pruned(pruned.build_blocks(index), queries, 3)[0]
        hits.extend(found.collect())

    # 600 x 50 pairs, and some 40 000 postings; most of the pairs meet
    assert shuffled(spark, work) < 12_000 and len(hits) == 150


def test_words_are_counted_in_their_row(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "c", "b"]), (2, []), (3, ["x"])], "id long, words array<string>")
    got = {r.id: (r.c.terms, r.c.tfs) for r in rows.select("id", retrieval.counted(F.col("words")).alias("c")).collect()}
    assert got == {1: (["a", "b", "c"], [1, 3, 1]), 2: ([], []), 3: (["x"], [1])}


def test_texts_without_articles_are_chunked_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, "a heading\n" + "many plain words " * 200) for i in range(40)], "doc_id long, text string")
    found = []
    assert shuffled(spark, lambda: found.extend(chunking.chunk_documents(docs).collect())) == 0
    assert len({r.doc_id for r in found}) == 40 and {r.law_name for r in found} == {"a heading"} and {r.chunk_index for r in found} == set(range(6))


def test_articles_and_plain_texts_keep_names_and_pages(spark):
    """A text is an article's on any of its pages; numbers of pages and names go to the chunks of both kinds."""
    article = "12-modda. Soliq\nbody of it"
    docs = spark.createDataFrame([(1, ["Name one", article]), (2, ["Name two", "plain"]), (3, ["Name three\n" + article])], "doc_id long, pages array<string>")
    got = {(r.doc_id, r.chunk_index, r.law_name, r.article_number, r.page_number) for r in chunking.chunk_documents(docs, pages_col="pages").collect()}
    assert got == {(1, 0, "Name one", "12", 2), (2, 0, "Name two", None, 1), (3, 0, "Name three", "12", None)}


def test_a_worker_holds_parts_of_a_batch():
    texts = ["a" * 300, None, "b" * 5000, "", "c" * 700, "d" * 400]
    batch = pa.RecordBatch.from_pydict({"id": list(range(6)), "text": texts})
    parts = list(slices(batch, "text", 1000))
    assert [p["id"].to_pylist() for p in parts] == [[0, 1], [2], [3, 4], [5]]
    assert list(slices(batch.slice(0, 0), "text")) == []
    assert sum(len(languages.gram_buckets(p["text"])[0]) for p in parts) == len(languages.gram_buckets(batch["text"])[0])


def test_keys_of_a_label_are_counted_and_not_listed(spark):
    """The measures of evaluate() over all pairs, without making them."""
    corpus = spark.range(3000).select(F.col("id").alias("key"), F.when(F.col("id") % 5 < 4, F.col("id") % 5).alias("label"))
    asked = spark.range(60).select(F.col("id").alias("query_id"), F.when(F.col("id") % 6 < 5, F.col("id") % 6).alias("label"))
    hits = spark.range(590).select(F.floor(F.col("id") / 10).alias("query_id"), (F.col("id") % 10 + 1).cast("int").alias("rank"), (F.col("id") * 7 % 3000).alias("key"))
    golden = asked.join(corpus, "label").select("query_id", "key")
    want, got = {tuple(r) for r in retrieval.evaluate(hits, golden).collect()}, []
    assert shuffled(spark, lambda: got.extend(retrieval.evaluate_labels(hits, asked, corpus).collect())) < 6000
    assert {tuple(r) for r in got} == want and len(got) == 40
