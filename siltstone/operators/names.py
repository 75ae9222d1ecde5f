"""Substring search in names for tables of queries: postings of character q-grams, the rarest first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.values import query_tokens
from siltstone.operators.retrieval import deal_hot
from siltstone.session import written

#: Characters of the longest gram; shorter words are looked for under grams of their own length.
LONGEST = 3


@dataclass
class NameIndex:
    """names (id, name), spellings (spelling, name, n, first, last) of different lower-cased names, and for these postings (term, spelling, name) of every gram and terms (term, df)."""

    names: DataFrame
    spellings: DataFrame
    postings: DataFrame
    terms: DataFrame


def grams_of(text: Column, size: Column) -> Column:
    """The distinct grams of `size` characters; none in a shorter text."""
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def index_names(names: DataFrame, id_col: str, name_col: str) -> NameIndex:
    """The grams of one to LONGEST characters of all names; null names have none. Ids should be unique.

    Equal names are one spelling, whatever their number, told by its least id.
    """
    rows = written(names.select(F.col(id_col).alias("id"), F.lower(name_col).alias("name")).where(F.col("name").isNotNull()), "names")
    spellings = written(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).withColumn("spelling", F.col("first")), "spellings")
    grams = F.flatten(F.array(*[grams_of(F.col("name"), F.lit(n)) for n in range(1, LONGEST + 1)]))
    postings = written(spellings.select(F.explode(grams).alias("term"), "spelling", "name"), "grams")
    return NameIndex(rows, spellings, postings, written(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "gram-counts"))


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, words): the different words of each query and their hints, in order; none without a word."""
    words = F.array_sort(F.array_distinct(query_tokens(F.col("query"))))
    return queries.select("query_id", words.alias("words")).where(F.size("words") > 0)


def _met(index: NameIndex, asked: DataFrame) -> DataFrame:
    """(words, spelling): spellings that hold any of the words, each once, for each different list of words.

    A word is looked for once for all queries, among the spellings under its rarest gram, and
    compared there as a whole. A word with a gram that no name has is looked for nowhere.
    """
    lists = written(asked.select("words").distinct().select("words", F.explode("words").alias("word")), "words")
    words = lists.select("word").distinct().select("word", F.explode(grams_of(F.col("word"), F.least(F.length("word"), F.lit(LONGEST)))).alias("term"))
    known = words.join(index.terms, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = known.groupBy("word").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.min("df").alias("least")).where(F.col("least") > 0).select("word", "term")
    # a gram of very many names is dealt over parts
    met = deal_hot(written(rarest, "rarest"), index.postings, index.terms, "spelling").where(F.contains("name", F.col("word")))
    return lists.join(met.select("word", "spelling"), "word").select("words", "spelling").distinct()


def search_names(index: NameIndex, queries: DataFrame) -> DataFrame:
    """(query_id, id): names that hold any word of the query (query_id, query) or a hint of one, each once."""
    asked = _asked(queries)
    named = index.names.join(index.spellings.select("name", "spelling"), "name").select("id", "spelling")
    return asked.distinct().join(_met(index, asked), "words").join(named, "spelling").select("query_id", "id").distinct()


def count_names(index: NameIndex, queries: DataFrame) -> DataFrame:
    """(query_id, found, first, last): how many names search_names() finds for each query that finds any, and their least and greatest id.

    Equal names are counted and equal queries answered once, so what is compared are different
    words with different names, whatever the number of rows. Query ids should be unique.
    """
    asked = _asked(queries)
    found = _met(index, asked).join(index.spellings.select("spelling", "n", "first", "last"), "spelling")
    counts = written(found.groupBy("words").agg(F.sum("n").alias("found"), F.min("first").alias("first"), F.max("last").alias("last")), "found")
    return asked.join(counts, "words").select("query_id", "found", "first", "last")
