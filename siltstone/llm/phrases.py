"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are pairs of neighbouring words, edges the triples that lead from one pair to the next,
weighted by how often they occur; a piece of text that ends leaves its last pair, and its last
word, by an edge to nowhere. Only these edges are counted over the corpus. What occurs how
often otherwise follows from them: a pair as often as its node is left, a word as often as
nodes that start with it are left plus the pieces that end with it. Paths of frequent edges
whose inner nodes have no other way in or out are compacted: all their pairs occur as often as
the path, and only its two end nodes are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._cluster import drop_kept, keep, let_go, with_counts
from siltstone.llm._words import cut_words, slices

#: What parts pieces, and words within them; fixed by the contract.
BREAKS, BLANKS = ".,;:!?\x0a\x0b\x0c\x0d", "\x20\x09"
#: Bytes of text whose edges are counted together before they are shuffled.
SLICE = 8 << 20
#: Rows of a sorted partition that are summed at a time, about.
AT_ONCE = 200_000
_ROWS = "key string, lang string, n long"
_SUMS = "kind int, lang string, node string, next string, n long"
#: Parts of a language's phrases that are ranked by themselves before all are.
RANK_BUCKETS = 128
#: Kinds of sums: a word, a pair (its node), a triple (an edge).
WORD, PAIR, TRIPLE = 1, 2, 3


def local_edges(texts: pa.Array, langs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary, language, first, second, third, count) of the edges in some texts, each once.

    Words are numbers in the vocabulary. An edge to nowhere has no third (-1); of a piece's last
    word alone it has no second either.
    """
    codes, vocabulary, bounds, piece = cut_words(texts, BLANKS, BREAKS, lower=True)
    n = len(codes)
    lang = np.repeat(langs, np.diff(bounds))
    # -1 stands behind the last word of each piece
    second, third = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if n > 1:
        second[:-1] = np.where(piece[1:] == piece[:-1], codes[1:], -1)
    if n > 2:
        third[:-2] = np.where(piece[2:] == piece[:-2], codes[2:], -1)
    size = len(vocabulary) + 1
    nodes, node = np.unique((lang * size + codes) * size + second + 1, return_inverse=True)
    edges, count = np.unique(node * size + third + 1, return_counts=True)
    of, third = nodes[edges // size], edges % size - 1
    return vocabulary, of // (size * size), of // size % size, of % size - 1, third, count


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    for part in slices(batch, "text", SLICE):
        coded = part.column("lang").dictionary_encode()
        vocabulary, lang, first, second, third, n = local_edges(part.column("text"), np.asarray(coded.indices).astype(np.int64))
        yield coded.dictionary, vocabulary, lang, first, second, third, n


def _names(vocabulary: pa.Array, first: np.ndarray, second: np.ndarray) -> pa.Array:
    """The nodes as text: two words with a space, or one word."""
    one = vocabulary.take(pa.array(first))
    two = vocabulary.take(pa.array(second, mask=second < 0))
    return pc.coalesce(pc.binary_join_element_wise(one, two, " "), one)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as (key, lang, n): the key is the node, a tab and the next word, or nothing after the tab."""
    for batch in batches:
        for langs, vocabulary, lang, first, second, third, n in _cut(batch):
            for at in range(0, len(n), 100_000):
                a = slice(at, at + 100_000)
                following = pc.fill_null(vocabulary.take(pa.array(third[a], mask=third[a] < 0)), "")
                key = pc.binary_join_element_wise(_names(vocabulary, first[a], second[a]), following, "\t")
                yield pa.RecordBatch.from_arrays([key, langs.take(pa.array(lang[a])), pa.array(n[a].astype(np.int64))], ["key", "lang", "n"])


def _heavy(parts: int):
    """Nodes with more than 1 / (8 * parts) of the different edges of a slice, and all edges' number."""

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, vocabulary, lang, first, second, _, n in _cut(batch):
                new = np.ones(len(n), bool)
                new[1:] = (lang[1:] != lang[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(n)))
                large = size * 8 * parts > len(n)
                at = begin[large]
                node = pa.concat_arrays([_names(vocabulary, first[at], second[at]).cast(pa.string()), pa.nulls(1, pa.string())])
                of = pa.concat_arrays([langs.take(pa.array(lang[at])).cast(pa.string()), pa.nulls(1, pa.string())])
                yield pa.RecordBatch.from_arrays([node, of, pa.array(np.append(size[large], len(n)))], ["node", "lang", "n"])

    return heavy


def hot_nodes(texts: DataFrame, parts: int) -> DataFrame:
    """(node, lang) of fewer than 8 * `parts` nodes, all those with 1 / (4 * parts) of all local edges among them.

    Such a node has 1 / (8 * parts) of the edges in slices with half of its own edges or more.
    """
    counts = keep(texts.mapInArrow(_heavy(parts), "node string, lang string, n long").groupBy("node", "lang").agg(F.sum("n").alias("n")), "heavy")
    total = counts.where(F.col("node").isNull()).agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("node").isNotNull() & (F.col("n") * 8 * parts >= total)).select("node", "lang")


def _sums(least: int, dealt: pa.Array, at_once: int = AT_ONCE):
    """Sums a partition sorted by key and language: edges and nodes that are frequent, and words.

    Nodes whose edges were `dealt` over several partitions, or whose rows were summed in parts
    here, are returned whatever the part; the parts are added up later.
    """

    def flush(table: pa.Table, parted_first: bool, parted_last: bool) -> pa.RecordBatch:
        key, lang = (table[c].combine_chunks() for c in ("key", "lang"))
        new = np.ones(len(key), bool)
        new[1:] = pc.or_(pc.not_equal(key[1:], key[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(new)
        weight = np.add.reduceat(table["n"].to_numpy(), edge)
        lang = lang.take(pa.array(edge)).dictionary_encode()
        parts = pc.split_pattern(key.take(pa.array(edge)), "\t").flatten()
        following = parts.take(pa.array(np.arange(1, len(parts), 2)))
        # from here on nodes and words are numbers in what they were coded by, each with a language
        node = parts.take(pa.array(np.arange(0, len(parts), 2))).dictionary_encode()
        nodes, langs = node.dictionary, lang.dictionary
        of_node, of_lang = (np.asarray(x.indices).astype(np.int64) for x in (node, lang))
        is_pair = pc.find_substring(nodes, " ").to_numpy() >= 0
        triples = np.flatnonzero(is_pair[of_node] & (pc.binary_length(following).to_numpy() > 0) & (weight >= least))

        def added(names: np.ndarray, by: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            both, which = np.unique(names * len(langs) + by, return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, which, n)
            return both // len(langs), both % len(langs), total

        at, by, flow = added(of_node, of_lang, weight)
        parted = pc.is_in(nodes, dealt).to_numpy(zero_copy_only=False)
        parted[0] |= parted_first  # the first node was met first, the last one last
        parted[-1] |= parted_last
        chosen = is_pair[at] & ((flow >= least) | parted[at])
        word = pc.list_element(pc.split_pattern(nodes, " ", max_splits=1), 0).dictionary_encode()
        w_at, w_by, w_flow = added(np.asarray(word.indices).astype(np.int64)[at], by, flow)
        kinds = np.repeat(np.array([TRIPLE, PAIR, WORD], np.int32), [len(triples), int(chosen.sum()), len(w_at)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(kinds),
                langs.take(pa.array(np.concatenate([of_lang[triples], by[chosen], w_by]))),
                pa.concat_arrays([nodes.take(pa.array(np.concatenate([of_node[triples], at[chosen]]))), word.dictionary.take(pa.array(w_at))]),
                pa.concat_arrays([following.take(pa.array(triples)), pa.nulls(len(kinds) - len(triples), pa.string())]),
                pa.array(np.concatenate([weight[triples], flow[chosen], w_flow])),
            ],
            ["kind", "lang", "node", "next", "n"],
        )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, going_on = 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < at_once:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = table["key"][table.num_rows - 1]
            # the last node may go on in the next batch; one that fills all of these goes by edges
            node = last.as_py().split("\t")[0]
            for parted, like_last in ((False, pc.starts_with(table["key"], node + "\t")), (True, pc.equal(table["key"], last))):
                cut = int(np.argmax(like_last.to_numpy()))
                if cut:
                    yield flush(table.slice(0, cut).combine_chunks(), going_on, parted)
                    going_on = parted
                    break
            held, rows = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
            rows = 0 if rows >= at_once else rows
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks(), going_on, False)

    return sums


def graph(docs: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Sums (kind, lang, node, next, n) of the graph: words, pairs with `least` or more, and such triples.

    A triple is its first pair (node) and third word (next). Edges meet once, dealt by node, but
    for nodes with a large share of all edges, whose edges are dealt by third word too.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hot = [(r["node"], r["lang"]) for r in hot_nodes(texts, parts).collect()]  # fewer than 8 * parts
    edges, node = texts.mapInArrow(_edges, _ROWS), F.substring_index("key", "\t", 1)
    dealt = edges.repartition(parts, node, "lang")
    if hot:
        known = spark.createDataFrame(hot, "hot_node string, hot_lang string")
        flagged = edges.withColumn("node", node).join(F.broadcast(known), (F.col("node") == F.col("hot_node")) & (F.col("lang") == F.col("hot_lang")), "left")
        dealt = flagged.repartition(parts, "node", "lang", F.when(F.col("hot_node").isNotNull(), F.col("key"))).select("key", "lang", "n")
    ordered = dealt.sortWithinPartitions("key", "lang")
    found = keep(ordered.mapInArrow(_sums(least, pa.array([n for n, _ in hot], pa.string())), _SUMS), "sums")
    sums = keep(found.groupBy("kind", "lang", "node", "next").agg(F.sum("n").alias("n")).where((F.col("kind") == WORD) | (F.col("n") >= least)), "graph")
    drop_kept(found)
    let_go(spark)
    return sums


def _name(node: Column, following: Column) -> Column:
    return F.concat(node, F.lit(" "), following)


def paths(sums: DataFrame) -> DataFrame:
    """(lang, words, n): the frequent triples of `sums`, joined into one path where a node between has no other way.

    That is a node which is left exactly as often as by its one frequent edge, and entered as
    often by one: pieces that end there, and edges too rare to be listed, would make a difference.
    A path that closes on itself stays in single triples. Distances double each round.
    """
    triples = sums.where(F.col("kind") == TRIPLE)
    second = F.substring_index("node", " ", -1)
    edges = triples.select("lang", F.col("node").alias("tail"), _name(second, F.col("next")).alias("head"), _name(F.col("node"), F.col("next")).alias("edge"), "n")
    flows = sums.where(F.col("kind") == PAIR).select("lang", "node", F.col("n").alias("flow"))
    into = edges.groupBy("lang", F.col("head").alias("node")).agg(F.count(F.lit(1)).alias("ways"), F.max("n").alias("n"), F.max("edge").alias("edge"))
    out_of = edges.groupBy("lang", F.col("tail").alias("node")).agg(F.count(F.lit(1)).alias("ways_out"), F.max("n").alias("n_out"), F.max("edge").alias("after"))
    unary = into.where("ways = 1").join(out_of.where("ways_out = 1"), ["lang", "node"]).join(flows, ["lang", "node"])
    links = keep(unary.where("n = flow AND n_out = flow AND edge <> after").select("lang", "edge", "after"), "links")
    # every linked edge looks `far` edges ahead, until each sees the last of its path
    state = keep(links.select("lang", "edge", F.col("after").alias("seen"), F.lit(1).cast("long").alias("far"), F.lit(False).alias("ended")), "far0")
    open_before = -1
    while True:
        ahead = state.select("lang", F.col("edge").alias("seen"), F.col("seen").alias("then"), F.col("far").alias("more"))
        step = state.where("NOT ended").join(ahead, ["lang", "seen"], "left")
        moved = step.select("lang", "edge", F.coalesce("then", "seen").alias("seen"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("then").isNull().alias("ended"))
        new = keep(moved.unionByName(state.where("ended")), "far")
        drop_kept(state)
        state = new
        still = state.where("NOT ended").count()
        if still in (0, open_before):
            break
        open_before = still
    ended = state.where("ended").select("lang", "edge", "seen", "far")
    placed = edges.join(ended, ["lang", "edge"], "left").select("lang", "edge", "n", F.coalesce("seen", "edge").alias("last"), F.coalesce("far", F.lit(0)).alias("far"))
    members = placed.groupBy("lang", "last").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("place"), F.col("edge")))).alias("edges"))
    # the first edge whole, of each further one its last word
    further = F.transform(F.slice("edges", 2, F.size("edges")), lambda e: F.substring_index(e["edge"], " ", -1))
    return members.select("lang", F.concat(F.split(F.col("edges")[0]["edge"], " "), further).alias("words"), "n")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of up to 38 digits."""
    a, left, right = (c.cast("decimal(14,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def phrases(docs: DataFrame, least: int = 10, percent: int = 50, top: int | None = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Phrases of two and three words by language: lang, rank, phrase, a, l, r, n, score.

    Texts are folded (A-Z), cut into pieces at the characters of BREAKS and into words at
    those of BLANKS. All counts are by language: n of all words, a of the phrase within
    pieces, overlaps included, l and r of its two parts at the cut that scores least,
    floor(1000000 * a * a / (l * r)); of equal cuts the first. A phrase counts `least` times
    or more; it goes if a longer such phrase that holds it has `percent` of its count. Ranks
    are by score, then a, both descending, then phrase in the order of its bytes; `top` of each
    language are returned (None: all). Counts must stay under 10^14.

    A null language is `und`, a null or empty text has no words, repeated rows count each, an
    empty table gives an empty result. Other columns are not read, so names can not clash.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = graph(docs, least, lang_col, text_col)
    words = sums.where(F.col("kind") == WORD).select("lang", F.col("node").alias("word"), "n")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    pairs = sums.where(F.col("kind") == PAIR).select("lang", F.col("node").alias("phrase"), F.col("n").alias("a"))
    found = keep(paths(sums), "paths")
    # triples of a path: inner pairs occur as often as the path, the two end pairs are looked up
    ends = found.select("*", F.concat_ws(" ", F.slice("words", 1, 2)).alias("first"), F.concat_ws(" ", F.slice("words", -2, 2)).alias("last"))
    first = pairs.select("lang", F.col("phrase").alias("first"), F.col("a").alias("n_first"))
    last = pairs.select("lang", F.col("phrase").alias("last"), F.col("a").alias("n_last"))
    known = ends.join(first, ["lang", "first"]).join(last, ["lang", "last"])
    at = known.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 2)).alias("i"))
    inner = F.col("i") < F.size("words") - 2
    three = at.select("lang", F.concat_ws(" ", F.slice("words", F.col("i"), 3)).alias("phrase"), F.col("n").alias("a"), F.when(F.col("i") > 1, F.col("n")).otherwise(F.col("n_first")).alias("l2"), F.when(inner, F.col("n")).otherwise(F.col("n_last")).alias("r1"))
    # pairs inside a path go; those at its ends if an edge has enough of their count
    covered = at.where(inner).select("lang", F.concat_ws(" ", F.slice("words", F.col("i") + 1, 2)).alias("phrase"), F.col("n").alias("most"))
    border = ends.select("lang", F.explode(F.array("first", "last")).alias("phrase"), F.col("n").alias("most"))
    strongest = covered.unionByName(border).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    alone = pairs.join(strongest, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a")))
    none = F.lit(None).cast("long")
    both = three.unionByName(alone.select("lang", "phrase", "a", none.alias("l2"), none.alias("r1")))
    key = lambda word: F.concat(word, F.lit("\t"), F.col("lang"))  # noqa: E731  words hold no tab
    both = keep(both.select("*", key(F.substring_index("phrase", " ", 1)).alias("k1"), key(F.substring_index("phrase", " ", -1)).alias("k2")), "candidates")
    frequent = keep(words.where(F.col("n") >= least).select(key(F.col("word")).alias("k"), "n"), "words")
    one = with_counts(both, frequent.select(F.col("k").alias("k1"), F.col("n").alias("l1")), "k1", "l1", parts)
    two = with_counts(one, frequent.select(F.col("k").alias("k2"), F.col("n").alias("r2")), "k2", "r2", parts)
    s1 = _score(F.col("a"), F.col("l1"), F.coalesce("r1", "r2"))
    s2 = _score(F.col("a"), F.col("l2"), F.col("r2"))
    scored = two.select("*", s1.alias("s1"), s2.alias("s2"))
    later = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    result = scored.select(
        "lang", "phrase", "a",
        F.when(later, F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(later, F.col("r2")).otherwise(F.coalesce("r1", "r2")).alias("r"),
        F.when(later, F.col("s2")).otherwise(F.col("s1")).cast("long").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    if top is not None:
        # of each bucket of a language's phrases the first ones, so that a language is no single task's
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS))
        within = Window.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a"), "phrase")
        result = result.withColumn("part", part).withColumn("nth", F.row_number().over(within)).where(F.col("nth") <= top).drop("part", "nth")
    ranked = result.withColumn("rank", F.row_number().over(order).cast("long"))
    chosen = ranked.where(F.col("rank") <= top) if top is not None else ranked
    return chosen.join(F.broadcast(totals) if top is not None else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(docs: DataFrame) -> DataFrame:
    """The contract's phrases of `documents`."""
    return phrases(docs)
