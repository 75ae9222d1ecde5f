"""Instruction data: conversion, cleaning, splitting, and the passes before training."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions.text import pair_hash, sanitize, strip, tokens, training_prompt, word_count
from siltstone.functions.values import shuffled, shuffled_place
from siltstone.operators.retrieval import deal_hot
from siltstone.session import written

# Role names of both spellings.
ASKING, ANSWERING = ("human", "user"), ("gpt", "assistant")
_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
_PHONE = "\\+?[0-9][0-9 ()-]{7,}[0-9]"
_LONG_ID = "\\b[0-9]{13,19}\\b"


def qa_rows(rows: DataFrame) -> DataFrame:
    """(question, context, answer) as instruction rows."""
    return rows.select(F.col("question").alias("instruction"), F.coalesce("context", F.lit("")).alias("input"), F.col("answer").alias("output"))


def conversation_pairs(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, pair, instruction, input, output) from (key, order, role, text).

    Messages pair up by position, two by two; a pair whose roles are not asking and answering
    is left out and does not shift the rest. input is the history of the pairs before that
    counted.
    """
    w = Window.partitionBy(key).orderBy(order)
    role = F.lower("role")
    rows = messages.withColumns({"pos": F.row_number().over(w) - 1, "role2": F.lead(role).over(w), "text2": F.lead("text").over(w)})
    pairs = rows.where((F.col("pos") % 2 == 0) & role.isin(*ASKING) & F.col("role2").isin(*ANSWERING))
    said = F.concat(F.lit("User: "), "text", F.lit("\nAssistant: "), "text2", F.lit("\n"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    history = F.array_join(F.collect_list(said).over(before), "")
    return pairs.select(key, F.floor(F.col("pos") / 2).cast("long").alias("pair"), F.col("text").alias("instruction"), strip(history).alias("input"), F.col("text2").alias("output"))


def tree_pairs(messages: DataFrame, order: str | None = None) -> DataFrame:
    """(instruction, output) from (message_id, parent_id, role, text): answers with their prompter.

    Of messages with one id the last by `order` counts.
    """
    last = Window.partitionBy("message_id").orderBy(F.col(order).desc() if order else F.lit(0))
    one = messages.withColumn("__n", F.row_number().over(last)).where("__n = 1")
    parent = one.where(F.col("role") == "prompter").select(F.col("message_id").alias("parent_id"), F.col("text").alias("instruction"))
    return one.where(F.col("role") == "assistant").join(parent, "parent_id").select("message_id", "instruction", F.lit("").alias("input"), F.col("text").alias("output"))


def first_n(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.orderBy(key).limit(n)


def not_blank(rows: DataFrame) -> DataFrame:
    return rows.where((strip(F.col("instruction")) != "") & (strip(F.col("output")) != ""))


def clean_rows(rows: DataFrame, order: str, min_chars: int = 3, max_words: int = 512) -> DataFrame:
    """Sanitised rows with a label: invalid, length, duplicate or kept, in that precedence.

    Of rows with one normalised instruction and input the first by `order` is kept; rows with
    another label do not count.
    """
    out = rows.withColumns({c: sanitize(F.coalesce(F.col(c), F.lit(""))) for c in ("instruction", "input", "output")})
    words = word_count(F.col("instruction")) + word_count(F.col("input")) + word_count(F.col("output"))
    label = F.when((F.col("instruction") == "") | (F.col("output") == ""), "invalid").when((F.length("output") < min_chars) | (words > max_words), "length")
    out = out.withColumns({"label": label, "pair_hash": pair_hash(F.col("instruction"), F.col("input"))})
    nth = F.row_number().over(Window.partitionBy("pair_hash", F.col("label").isNull()).orderBy(order))
    return out.withColumn("nth", nth).withColumn("label", F.coalesce("label", F.when(F.col("nth") > 1, "duplicate").otherwise("kept"))).drop("nth")


def clean_report(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("label") == k).alias(k) for k in ("invalid", "length", "duplicate", "kept")])


#: Hexadecimal digits of the hash cells by which rows are counted before they are put in order.
CELL_DIGITS = 4


def first_by_hash(rows: DataFrame, key: str, count: int, seed: int = 42) -> DataFrame:
    """The `count` rows that come first by (hash of the key, key), all if there are fewer.

    Rows are counted by cells of the hash: the cells before the border go whole, and only the
    cell in which the border lies is put in order, so no task sees a share of the table.
    """
    if count <= 0:
        return rows.limit(0)
    cell = shuffled_place(F.col(key), CELL_DIGITS, seed)
    counts = rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))  # at most 16**CELL_DIGITS rows
    upto = F.sum("n").over(Window.orderBy("cell"))
    border = counts.withColumn("upto", upto).where(F.col("upto") >= count).orderBy("cell").first()
    if border is None:
        return rows
    last = rows.where(cell == border["cell"]).orderBy(shuffled(F.col(key), seed), key).limit(count - (border["upto"] - border["n"]))
    return rows.where(cell < border["cell"]).unionByName(last)


def split_train(rows: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows, disjoint and complete; at least one for validation.

    `key` tells rows apart; those that share it go together.
    """
    keys = rows.select(key).distinct()
    m = max(1, int(keys.count() * share))
    chosen = first_by_hash(keys, key, m, seed)
    return rows.join(chosen, key, "left_anti"), rows.join(chosen, key, "left_semi")


def render(rows: DataFrame, end: str = "</s>") -> DataFrame:
    """Only the prompt text of each row."""
    return rows.select(training_prompt(F.col("instruction"), F.col("input"), F.col("output"), end).alias("text"))


def scrub(c: Column) -> Column:
    """E-mail addresses, long ids and phone numbers as placeholders."""
    c = F.regexp_replace(c, _EMAIL, "<email>")
    c = F.regexp_replace(c, _LONG_ID, "<id>")
    return F.regexp_replace(c, _PHONE, "<phone>")


def personal_counts(c: Column) -> dict[str, Column]:
    without = F.regexp_replace(c, _LONG_ID, "")
    return {"emails": F.regexp_count(c, F.lit(_EMAIL)), "ids": F.regexp_count(c, F.lit(_LONG_ID)), "phones": F.regexp_count(without, F.lit(_PHONE))}


def sample_rows(rows: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """A sample by hash: the same rows in every run and partitioning."""
    return rows.where(shuffled_place(F.col(key), 8, seed) % 100 < percent)


def gram_hashes(c: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the word n-grams; none in a text of fewer words."""
    # the outer transform binds the tokens to a name, so that they are found once and not once a gram
    grams = F.transform(F.array(tokens(c)), lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.xxhash64(F.slice(t, i + 1, n)))).otherwise(F.array().cast("array<bigint>")))
    return F.array_distinct(F.get(grams, F.lit(0)))


#: Words of 64 bits of a Bloom filter: 12 bits for each hash it holds, within these limits.
LEAST_WORDS, MOST_WORDS, BITS_EACH, MARKS = 1 << 10, 1 << 21, 12, 4


def _mark(c: Column) -> Column:
    """The bits that a hash sets in its word: MARKS of 64, by six bits of the hash each."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(c, 40 + 6 * i).bitwiseAND(63).cast("int")) for i in range(MARKS)]
    return reduce(Column.bitwiseOR, bits)


def bloom_words(hashes: DataFrame, column: str, n: int) -> tuple[DataFrame, int]:
    """(word, bits) of a Bloom filter of n 64-bit hashes, and how many words it has.

    The filter is an aggregation: at most MOST_WORDS rows of two numbers, whatever n. Beyond
    that it holds back less, and never anything that it was given.
    """
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (max(n, 1) * BITS_EACH // 64).bit_length()))
    return hashes.groupBy(F.col(column).bitwiseAND(words - 1).alias("word")).agg(F.bit_or(_mark(F.col(column))).alias("bits")), words


def maybe_among(rows: DataFrame, column: str, words: DataFrame, n_words: int) -> DataFrame:
    """The rows whose hash may be among those of the filter; the filter goes to every task, its size is bounded."""
    mark = _mark(F.col(column))
    met = rows.join(F.broadcast(words), F.col(column).bitwiseAND(n_words - 1) == F.col("word"))
    return met.where(F.col("bits").bitwiseAND(mark) == mark).drop("word", "bits")


def leaked(train: DataFrame, evaluation: DataFrame, key: str, eval_key: str, n: int = 8) -> DataFrame:
    """(key, eval_key, shared): training texts that share an n-gram with an evaluation text.

    Hashes of the evaluation grams go to all tasks as a Bloom filter; of the training grams
    only those that it lets pass are shuffled. A gram that very many evaluation texts have is
    dealt over parts. Only 64-bit hashes meet; keys should be unique.
    """
    grams = written(evaluation.select(F.col(eval_key).alias("of"), F.explode(gram_hashes(F.col("text"), n)).alias("term")), "grams")
    terms = written(grams.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "gram-counts")
    words, n_words = bloom_words(terms, "term", terms.count())
    left = train.select(F.col(key).alias("query_id"), F.explode(gram_hashes(F.col("text"), n)).alias("term"))
    met = deal_hot(maybe_among(left, "term", words, n_words), grams, terms, "of")
    return met.groupBy(F.col("query_id").alias(key), F.col("of").alias(eval_key)).agg(F.count(F.lit(1)).alias("shared"))


def stratified_split(rows: DataFrame, stratum: str, key: str, seed: int = 42, large: int = 2000) -> DataFrame:
    """`rows` with `part`: of each stratum a tenth is val below `large` rows in all, else a twentieth.

    A row's place in its stratum is that of its hash cell and its place in the cell, so that a
    large stratum is spread over tasks.
    """
    share = 0.1 if rows.count() < large else 0.05
    tagged = rows.select(F.struct("*").alias("row"), F.col(stratum).alias("s"), shuffled_place(F.col(key), CELL_DIGITS, seed).alias("cell"), shuffled(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    cells = tagged.groupBy(F.col("s").alias("s2"), F.col("cell").alias("cell2")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("s2")
    before = F.coalesce(F.sum("n").over(every.orderBy("cell2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumns({"before": before, "size": F.sum("n").over(every)})
    placed = tagged.join(cells, F.col("s").eqNullSafe(F.col("s2")) & (F.col("cell") == F.col("cell2")))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("s", "cell").orderBy("h", "k"))
    return placed.withColumn("part", F.when(nth <= F.ceil(F.col("size") * share), "val").otherwise("train")).select("row.*", "part")


def mix_slices(slices: dict[str, tuple[DataFrame, float]], total: int, key: str, seed: int = 42) -> DataFrame:
    """`total` rows from named slices at their shares, each slice in the order of a hash."""
    parts = [first_by_hash(df, key, int(total * share + 0.5), seed).withColumn("slice", F.lit(name)) for name, (df, share) in slices.items()]
    return reduce(DataFrame.unionByName, parts)


#: Steps of a component of a direction, as many as two bytes hold.
STEPS = 32767


def near_copies(embedded: DataFrame, key: str, cosine: float = 0.95, bands: int = 48, bits: int = 14, block: int = 1024, seed: int = 42) -> DataFrame:
    """(key, other, cosine): rows of (key, embedding) that are near, key < other; keys should be unique.

    Vectors get a sign bit for each of bands * bits random directions; rows that agree in all
    bits of a band are candidates, compared by exact cosine. At a cosine of 0.95 a bit differs
    with probability 0.101, so a pair is missed with (1 - 0.899 ** 14) ** 48, about one in
    200 000. Equal vectors are compared once, by their least key; each other copy comes as a pair
    with that key. A band that many rows share is dealt into blocks of which each pair is a group
    of its own, so a task is bounded and only near pairs leave it. Null and zero vectors are near
    to nothing, and vectors of another length than the most common one (of those, the longer) are left out.

    Bands meet on directions in steps of 1 / STEPS, two bytes a component, with a bound that no
    near pair fails; the pairs that pass get their vectors and are judged by those.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    rows = embedded.select(F.col(key).alias("key"), "embedding", F.xxhash64("embedding").alias("h")).where(norm > 0)
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dimension = common["dim"] if common else 1
    rows = rows.where(F.size("embedding") == dimension)
    classes = rows.groupBy("h").agg(F.min_by("embedding", "key").alias("embedding"), F.min("key").alias("key"))
    kind = rows.schema["key"].dataType.simpleString()
    planes = np.random.default_rng(seed).standard_normal((dimension, bands * bits))
    # a component is off by half a step at most, so a product of two directions by their lengths times that; single precision adds less than the rest
    least = cosine - (1.01 * dimension**0.5 / STEPS + 1e-5 * max(1, dimension // 64))
    weights = 1 << np.arange(bits, dtype=np.int64)

    def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dimension)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = (vectors(batch.column("embedding")) @ planes > 0).reshape(-1, bands, bits)
            found = (signs @ weights) * bands + np.arange(bands)
            ends = pa.array(np.arange(len(found) + 1) * bands, pa.int32())
            with np.errstate(invalid="ignore", over="ignore"):
                v = vectors(batch.column("embedding"))
                near = np.rint(np.nan_to_num(v / np.linalg.norm(v, axis=1, keepdims=True)) * STEPS).astype(np.int16)
            places = pa.array(np.arange(len(near) + 1) * dimension, pa.int32())
            lists = [pa.ListArray.from_arrays(places, pa.array(near.ravel())), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *lists], ["key", "direction", "codes"])

    coded = written(classes.select("key", "embedding").mapInArrow(codes, f"key {kind}, direction array<smallint>, codes array<bigint>"), "directions")
    posted = coded.select("key", "direction", F.explode("codes").alias("code"))
    # of a block's rows and more each, so there are few
    large = posted.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("code", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = posted.join(F.broadcast(large), "code", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # small bands share groups, as many as rows fill; each pair of blocks of a large one is a group
    spread = max(1, -(-coded.count() * bands // (16 * block)))
    b0, b1 = F.least("mine", "with"), F.greatest("mine", "with")
    group = F.when(F.col("blocks") > 1, F.xxhash64("code", b0, b1)).otherwise(F.pmod(F.xxhash64("code"), F.lit(spread)))
    met = met.select(group.alias("group"), (F.col("blocks") > 1).alias("large"), "code", b0.alias("b0"), b1.alias("b1"), "mine", "key", "direction")
    key_type = to_arrow_type(rows.schema["key"].dataType)
    out = pa.schema([("key", key_type), ("other", key_type)])

    def compare(table: pa.Table) -> pa.Table:
        v = vectors(table["direction"]).astype(np.float32) / np.float32(STEPS)
        code, mine, b0, b1 = (table[c].to_numpy() for c in ("code", "mine", "b0", "b1"))
        order = np.lexsort((b1, b0, code))
        borders = np.flatnonzero((np.diff(code[order]) != 0) | (np.diff(b0[order]) != 0) | (np.diff(b1[order]) != 0)) + 1
        found = []
        for at in np.split(order, borders):
            left, right = at[mine[at] == b0[at[0]]], at[mine[at] == b1[at[0]]]
            i, j = np.nonzero(v[left] @ v[right].T >= least)
            apart = left[i] < right[j] if b0[at[0]] == b1[at[0]] else left[i] != right[j]
            found.append((left[i][apart], right[j][apart]))
        i, j = (np.concatenate([f[k] for f in found]) for k in range(2))
        keys = table["key"].combine_chunks()
        a, b = keys.take(pa.array(i)), keys.take(pa.array(j))
        swap = pc.greater(a, b)
        return pa.table([pc.if_else(swap, b, a), pc.if_else(swap, a, b)], schema=out)

    pairs = met.groupBy("group", "large").applyInArrow(compare, f"key {kind}, other {kind}").distinct()
    unit = classes.withColumn("norm", norm).select("key", F.transform("embedding", lambda x: x / F.col("norm")).alias("unit"))
    both = pairs.join(unit, "key").join(unit.select(F.col("key").alias("other"), F.col("unit").alias("second")), "other")
    product = F.aggregate(F.zip_with("unit", "second", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    near = both.select("key", "other", product.alias("cosine")).where((F.col("cosine") >= cosine) & ~F.isnan("cosine"))
    copies = rows.select("h", F.col("key").alias("other")).join(classes.select("h", "key"), "h").where("key < other")
    return near.unionByName(copies.select("key", "other", F.lit(1.0).alias("cosine")))


def drop_near_copies(rows: DataFrame, embedded: DataFrame, key: str, cosine: float = 0.95) -> DataFrame:
    """`rows` less those whose vector in `embedded` (key, embedding) is near that of a smaller key."""
    again = near_copies(embedded, key, cosine).select(F.col("other").alias(key)).distinct()
    return rows.join(again, key, "left_anti")
