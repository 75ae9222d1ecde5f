"""N-gram Jaccard join by parity sketches.

The shingles of a document are XORed into a sketch of K segments, so that every shingle two
documents do not share changes one segment at most: documents that link differ in few segments,
and with K above that number several are equal (pigeonhole). Sizes of linked documents lie in
the same or the next size band, and K is chosen by band. Equal segments are found by a
range-partitioned sort, which cuts hot values across tasks. Each document needs to be looked
for under its rarest segments only: as linked documents share several, those that most others
hold can be left out without losing a link. Candidates are pairs. They are dropped by size and by
the Hamming distance of dense one-bit-a-shingle sketches, which bounds the symmetric difference
from below, before any text moves, and verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm._cluster import drop_kept, keep, let_go, mix64, with_counts
from siltstone.llm._components import components
from siltstone.llm._pieces import forget_words
from siltstone.llm._words import plain, slices, split_words
from siltstone.operators.instructions import bloom_words, maybe_among

#: Segments beyond the pigeonhole's need, so that linked documents share several.
SPARE = 3
#: Documents under one key that are compared in one block.
BLOCK = 512
#: Shingles of the documents that one group of a verification holds, about.
GROUP_SHINGLES = 1 << 18
#: Least bits of a dense sketch.
LEAST_BITS = 64
#: Set hashes that a task remembers so as to post a set once; it forgets them all when full.
REMEMBERED = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle values of each text; A-Z lower-cased, short texts as one."""
    codes, words, offsets = split_words(pc.ascii_lower(plain(texts)))
    values = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)
    h = mix64(values)[codes] if len(codes) else np.zeros(0, np.uint64)
    full = h.copy()
    for j in range(1, width):
        full = mix64(full[: max(len(h) - j, 0)] * _ODD + h[j:])
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            one = h[a : a + 1]
            for j in range(a + 1, b):
                one = mix64(one * _ODD + h[j : j + 1])
            out.append(mix64(one ^ np.uint64(b - a)))  # apart from any full shingle
        else:
            out.append(h[:0])
    return out


class Bands:
    """Size bands for a threshold: linked sets lie in one band or two neighbouring ones."""

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]

    def start(self, band: int) -> int:
        while len(self.starts) <= band:
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        return self.starts[band]

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.start(len(self.starts))
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def segments(self, band: int) -> int:
        """Most shingles that linked sets can differ in, the smaller being of this band; and some to spare."""
        largest = self.start(band + 1) - 1
        most = most_different(largest + largest * 100 // self.percent, self.percent)
        return most + SPARE + most // 16


def most_different(sizes: int, percent: int) -> int:
    """Largest symmetric difference of linked sets whose sizes add up to `sizes`."""
    return sizes * (100 - percent) // (100 + percent)


@lru_cache(maxsize=8)
def _bands(percent: int) -> Bands:
    return Bands(percent)


def segment_keys(values: np.ndarray, band: int, count: int, most: int) -> tuple[np.ndarray, int]:
    """Keys of a sketch's segments, each naming band, segment and XOR of shingles; and how many of
    them any linked set shares at least, given that it differs in `most` shingles at most.

    Empty segments are no keys, so they can not be shared. Where none but they may be shared, they
    are keys too, and the number is 0: this set has to be looked for under all its keys.
    """
    folded = np.zeros(count, np.uint64)
    np.bitwise_xor.at(folded, (mix64(values + np.uint64(band)) % np.uint64(count)).astype(np.int64), values)
    held = np.flatnonzero(folded)
    shared = len(held) - most
    if shared < 1:
        held, shared = np.arange(count), 0
    return mix64(folded[held] ^ mix64((held + 1).astype(np.uint64) * _ODD + np.uint64(band))), shared


def set_hash(values: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two hashes of the whole set: one of `bits` bits that names it, and one of 64 more that tells sets of one name apart."""
    mixed = mix64(values)
    # arrays of one value: they wrap round in silence
    first, second = np.bitwise_xor.reduce(mixed, keepdims=True), mix64(mixed ^ _ODD).sum(dtype=np.uint64, keepdims=True)
    both = mix64(np.concatenate([first ^ second * _ODD ^ np.uint64(len(values)), mix64(mixed + _ODD).sum(dtype=np.uint64, keepdims=True) ^ first]))
    both[0] >>= np.uint64(64 - bits)
    return int(both[:1].view(np.int64)[0]), int(both[1:].view(np.int64)[0])


def dense_sketch(values: np.ndarray) -> bytes:
    """One bit flipped by each shingle, in a power of two of bits near the set's size."""
    bits = max(LEAST_BITS, 1 << (len(values) - 1).bit_length()) if len(values) else LEAST_BITS
    at = (mix64(values ^ _ODD) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").tobytes()


def folded_to(sketch: np.ndarray, size: int) -> np.ndarray:
    """The dense sketch in `size` words of 64 bits: halves laid over each other keep its parities."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def sketches(docs: DataFrame, width: int, percent: int, bits: int = 64) -> DataFrame:
    """Of (id, th, text): (id, th, n, node, more, dense, own, low, own_shared, low_shared).

    n is the set's size, node a hash of the set, which stands for all its copies, and `more` is 64 bits of another; `own` and
    `low` are segment keys in the set's band and, as the larger of two, in the band below. A task
    gives dense sketch and keys with a set's first copy only, so that many copies are no hot keys.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    nothing = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        bands, seen = _bands(percent), set()
        for whole in batches:
            for batch in slices(whole, "text"):
                n, node, more, dense, shared, keys = [], [], [], [], ([], []), ([], [])
                for s in shingle_sets(batch.column("text"), width):
                    size = len(s)
                    h = set_hash(s, bits)
                    n.append(size)
                    node.append(h[0])
                    more.append(h[1])
                    fresh = size > 0 and h not in seen
                    if fresh:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(h)
                        band = bands.of(size)
                        sides = [(band, size + size * 100 // percent), (band - 1, size + bands.start(band) - 1)]
                    dense.append(dense_sketch(s) if fresh else None)
                    for i in (0, 1):
                        if fresh and sides[i][0] >= 0:
                            k, least = segment_keys(s, sides[i][0], bands.segments(sides[i][0]), most_different(sides[i][1], percent))
                        else:
                            k, least = nothing, 0
                        keys[i].append(k)
                        shared[i].append(least)
                listed = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, k)]), pa.int32()), pa.array(np.concatenate(k).view(np.int64))) for k in keys]
                columns = [batch.column("id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(more, pa.int64()), pa.array(dense, pa.binary()), *listed, *(pa.array(x, pa.int32()) for x in shared)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "th", "n", "node", "more", "dense", "own", "low", "own_shared", "low_shared"])

    return docs.mapInArrow(run, f"id {kinds['id']}, th long, n long, node long, more long, dense binary, own array<long>, low array<long>, own_shared int, low_shared int")


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by (key, node): each row whose key several nodes hold, once; and those
    of its first and last key, which may go on in the next partition."""
    first = before = held = None
    many = False  # whether the rows of the key before are out already
    names = ["key", "node", "low"]
    for batch in batches:
        key, node, low = (batch.column(c).to_numpy(zero_copy_only=False) for c in names)
        if not len(key):
            continue
        if first is None:
            first = key[0]
        new = np.append(before != (key[0], node[0]), (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        last_key = None if before is None else before[0]
        before = (key[-1], node[-1])
        key, node, low = key[new], node[new], low[new]
        if held is not None:
            key, node, low = (np.append(np.array([h]), x) for h, x in zip(held, (key, node, low), strict=True))
            last_key, held = None, None
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        back = np.append(many and key[0] == last_key, same)
        out = back | np.append(same, False) | (key == first)
        if not out[-1]:
            held = (key[-1], node[-1], low[-1])
        many = bool(out[-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out]), pa.array(low[out].astype(bool))], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (int(held[0]), int(held[1]), bool(held[2]))], names)


def shared_keys(postings: DataFrame) -> DataFrame:
    """The rows (key, node, low) of the keys that several nodes hold, each once, and few others.

    Rows are sorted by key and node over range partitions, so a hot key goes to as many tasks
    as its rows fill.
    """
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node")
    return keep(dealt.mapInArrow(_shared_rows, "key long, node long, low boolean"), "shared")


def rarest_keys(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, node, low, n, weight): the keys under which a node has to be looked for.

    A node of which any linked set shares at least s keys leaves out its s - 1 most held ones, by
    (holders, key), an order that is the same for all: of the keys that linked sets share, the
    least held is among the rest of both. `weight` is the number of keys the node shares with any.
    """
    holders = shared.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") > 1)
    most_held = Window.partitionBy("node", "low").orderBy(F.desc("holders"), F.desc("key"))
    least = F.when(F.col("low"), F.col("low_shared")).otherwise(F.col("own_shared"))
    rows = shared.join(holders, "key").join(classes.select("node", "n", "own_shared", "low_shared"), "node")
    rows = rows.withColumns({"nth": F.row_number().over(most_held), "weight": F.count(F.lit(1)).over(Window.partitionBy("node", "low"))})
    return rows.where(F.col("nth") >= least).select("key", "node", "low", "n", "weight")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sizes_fit(a: str | Column, b: str | Column, percent: int) -> Column:
    return F.lit(100) * F.least(a, b) >= F.lit(percent) * F.greatest(a, b)


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(hub, other, n) of the pairs (hub, other) within the bounds of sizes and Hamming distance."""
    hubs = classes.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("dense").alias("hub_dense"))
    others = classes.select(F.col("node").alias("other"), "n", "dense")
    uses = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("uses"))
    both = with_counts(pairs, hubs.join(uses, "hub"), "hub", "uses", _parts(pairs)).join(others, "other").where(_sizes_fit("n", "hub_n", percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = np.asarray(batch.column("n")), np.asarray(batch.column("hub_n"))
            limit = (n + m) * (100 - percent) // (100 + percent)
            near = np.zeros(len(n), bool)
            for i, (x, y) in enumerate(zip(batch.column("dense").to_pylist(), batch.column("hub_dense").to_pylist(), strict=True)):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size = min(len(a), len(b))
                near[i] = np.bitwise_count(folded_to(a, size) ^ folded_to(b, size)).sum() <= limit[i]
            yield batch.select(["hub", "other", "n"]).filter(pa.array(near))

    return both.mapInArrow(run, "hub long, other long, n long")


def _pairs_in_block(node: np.ndarray, n: np.ndarray, component: np.ndarray, dense: list[bytes], left: np.ndarray, right: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (hub, others) of rows of different components within the bounds."""
    words = [np.frombuffer(x, np.uint64) for x in dense]
    size = min(map(len, words))
    bits = np.stack([folded_to(w, size) for w in words])
    for i in left:
        j = right if left is not right else right[right > i]
        j = j[(component[j] != component[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
        if len(j):
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)
            j = j[apart <= (n[j] + n[i]) * (100 - percent) // (100 + percent)]
            yield np.minimum(node[j], node[i]), np.maximum(node[j], node[i])


def close_pairs(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, other) of different components under one key within the bounds, each once.

    `rows` is (key, node, n, component). Members of a key with more than BLOCK of them are dealt
    into blocks by a hash of the node, and each pair of its blocks is a group of its own, so a group
    holds 2 * BLOCK dense sketches however many hold a key; other keys share groups.
    """
    mixed = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("c0"), F.max("component").alias("c1")).where(F.col("c0") != F.col("c1"))
    mixed = keep(rows.join(mixed.select("key", "members"), "key"), "mixed")
    total = mixed.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "hub long, other long")
    spread = -(-total // BLOCK)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = mixed.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.join(classes.select("node", "dense"), "node").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "with"), F.greatest("mine", "with")
    group = F.when(F.col("blocks") > 1, F.xxhash64("key", low, high)).otherwise(F.pmod(F.xxhash64("key"), F.lit(spread)))
    grouped = met.select(group.alias("group"), (F.col("blocks") > 1).alias("large"), "key", "node", "n", "component", "dense", "mine", low.alias("b0"), high.alias("b1"))

    def compare(table: pa.Table) -> pa.Table:
        key, node, n, component, mine, b0, b1 = (np.asarray(table[c]) for c in ("key", "node", "n", "component", "mine", "b0", "b1"))
        dense = table["dense"].to_pylist()
        found = [(node[:0], node[:0])]
        order = np.lexsort((b1, b0, key))
        borders = (key[order][1:] != key[order][:-1]) | (b0[order][1:] != b0[order][:-1]) | (b1[order][1:] != b1[order][:-1])
        for at in np.split(order, np.flatnonzero(borders) + 1):
            every = np.arange(len(at))
            left, right = (every, every) if b0[at[0]] == b1[at[0]] else (every[mine[at] == b0[at[0]]], every[mine[at] == b1[at[0]]])
            found += _pairs_in_block(node[at], n[at], component[at], [dense[x] for x in at], left, right, percent)
        a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        return pa.table({"hub": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64())})

    found = keep(grouped.groupBy("group", "large").applyInArrow(compare, "hub long, other long").distinct(), "found")
    drop_kept(mixed)
    return found


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b): the pairs (hub, other, n) whose whole sets link.

    Texts are fetched from `rows` (id, th, text) once for each set that any pair names. The
    others of a hub are dealt into groups of about GROUP_SHINGLES shingles, so that the hub's text
    goes along once a group and a group is bounded however many pairs a hub has.
    """
    pairs = keep(pairs, "pairs")
    load = keep(pairs.groupBy("hub").agg(F.sum("n").alias("load"), F.count(F.lit(1)).alias("uses")), "load")
    total = load.agg(F.sum("load")).first()[0] or 0
    if not total:
        return pairs.sparkSession.createDataFrame([], "a long, b long")
    spread = -(-total // GROUP_SHINGLES)
    chunks = F.ceil(F.col("load") / GROUP_SHINGLES).cast("int")
    dealt = with_counts(pairs, load, "hub", "uses", _parts(pairs)).withColumn("chunk", F.pmod(F.xxhash64("other"), chunks))
    group = F.pmod(F.xxhash64("hub", "chunk"), F.lit(spread))
    dealt = keep(dealt.select(group.alias("group"), "hub", "chunk", "other"), "dealt")
    members = dealt.select("group", "hub", F.col("other").alias("node")).union(dealt.select("group", "hub", F.col("hub").alias("node")).distinct())
    wanted = members.select("node").distinct().join(classes, "node").select("node", F.xxhash64("first.id").alias("i"), F.col("first.th").alias("t"))
    wanted = keep(wanted.withColumn("h", F.xxhash64("i", "t")), "wanted")
    # of the texts only those that a Bloom filter of the wanted ones lets pass are shuffled
    words, n_words = bloom_words(wanted, "h", wanted.count())
    maybe = maybe_among(rows.select(F.xxhash64("id").alias("i"), F.col("th").alias("t"), "text").withColumn("h", F.xxhash64("i", "t")), "h", words, n_words)
    found = maybe.drop("h").join(wanted.drop("h"), ["i", "t"])
    # repeated rows meet in the join's partitions; one of them is enough
    nth = F.row_number().over(Window.partitionBy("i", "t").orderBy(F.lit(0)))
    texts = keep(found.withColumn("nth", nth).where(F.col("nth") == 1).select("node", "text"), "texts")

    def check(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table["text"].combine_chunks(), width)
        node, hub = np.asarray(table["node"]), np.asarray(table["hub"])
        at = {int(node[i]): i for i in np.flatnonzero(node == hub)}
        links = []
        for i in np.flatnonzero(node != hub):
            a, b = sets[at[int(hub[i])]], sets[i]
            shared = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                links.append((int(hub[i]), int(node[i])))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    links = keep(members.join(texts, "node").groupBy("group").applyInArrow(check, "a long, b long"), "links")
    for done in (pairs, load, dealt, wanted, texts):
        drop_kept(done)
    return links


def _told_apart(sketched: DataFrame) -> DataFrame:
    """`sketched` with a node of its own for each set: where several sets share a node, all but one get others."""
    shared = sketched.where(F.col("n") > 0).groupBy("node").agg(F.min("more").alias("stays"), F.max("more").alias("last")).where(F.col("stays") != F.col("last")).select("node", "stays")
    renamed = F.when(F.col("stays").isNotNull() & (F.col("more") != F.col("stays")), F.xxhash64("node", "more")).otherwise(F.col("node"))
    return sketched.join(shared, "node", "left").withColumn("node", renamed).select(*sketched.columns)


def _solve(rows: DataFrame, width: int, percent: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Of (id, th, text): (id, th, n, node) of each row, and (node, first, component) of each set.

    `first` is (no id, id, th) of the set's first row, `component` the least node it is linked to.
    """
    spark = rows.sparkSession
    sketched = keep(sketches(rows, width, percent, bits), "sketches")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")

    def sets() -> DataFrame:
        full = sketched.where(F.col("n") > 0).groupBy("node").agg(F.min(place).alias("first"), F.max("n").alias("n"), F.max("dense").alias("dense"), F.max("own_shared").alias("own_shared"), F.max("low_shared").alias("low_shared"), (F.min("more") != F.max("more")).alias("several"))
        return keep(full, "classes")

    classes = sets()
    if not classes.where("several").isEmpty():
        # sets of one node, told apart by 128 bits
        before, sketched = (sketched, classes), keep(_told_apart(sketched), "sketches")
        classes = sets()
        for done in before:
            drop_kept(done)
    base = keep(sketched.select("id", "th", "n", "node"), "sets")
    sides = [sketched.select(F.explode(side).alias("key"), "node", F.lit(side == "low").alias("low")) for side in ("own", "low")]
    shared = shared_keys(sides[0].union(sides[1]))
    posted = keep(rarest_keys(shared, classes), "posted")
    for done in (sketched, shared):
        drop_kept(done)
    let_go(spark)
    # first the pairs with the member of each key that shares most: it is the likeliest origin
    heads = keep(posted.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("head"), F.count(F.lit(1)).alias("uses")), "heads")
    stars = with_counts(posted, heads, "key", "uses", _parts(posted)).where((F.col("node") != F.col("head.node")) & _sizes_fit("n", "head.n", percent))
    stars = keep(stars.select(F.col("head.node").alias("hub"), F.col("node").alias("other")).distinct(), "stars")
    links = verified(_close(stars, classes, percent), classes, rows, width, percent)
    let_go(spark)
    # then all other pairs of a key that the first links leave in different components
    first_linked = components(links)
    joined = posted.join(first_linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = close_pairs(joined.select("key", "node", "n", "component").distinct(), classes, percent)
    done = stars.select(F.least("hub", "other").alias("hub"), F.greatest("hub", "other").alias("other"))
    more = more.join(done, ["hub", "other"], "left_anti").join(classes.select(F.col("node").alias("other"), "n"), "other").select("hub", "other", "n")
    others = verified(more, classes, rows, width, percent)
    let_go(spark)
    linked = first_linked if others.isEmpty() else components(links.union(others))
    for done in (posted, heads, stars):
        drop_kept(done)
    return base, classes.select("node", "first").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id.

    Rows link when 100 * |A and B| >= percent * |A or B| over their sets of distinct `width`-word
    shingles (fewer words: the whole sequence is the one shingle). component_id is the least id
    reachable over links, the row's own included. Null and blank texts have an empty set and
    link with nothing, so component_id is the row's own id. Repeated rows and copies are one
    class, compared once, by a hash of the set of 128 bits; ids may repeat. A null id is no least id: a component has the least of
    its other ids, or null. An empty table gives an empty result. Other columns are not read.
    """
    base, classes = _solve(_rows(docs, id_col, text_col), width, percent)
    least = classes.groupBy("component").agg(F.min("first.id").alias("component_id"))
    known = classes.join(least, "component").select("node", "component_id")
    out = base.join(known, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` less all but one of each component of jaccard_components().

    The row of the least id stays (a null id counts as greatest; of repeated rows one stays).
    Rows with an empty set all stay. All columns pass through, whatever their names.
    """
    base, classes = _solve(_rows(docs, id_col, text_col), width, percent)
    firsts = classes.groupBy("component").agg(F.min("first").alias("first"))
    staying = firsts.select(F.xxhash64("first.id").alias("i"), F.col("first.th").alias("t"), F.lit(True).alias("once"))
    blank = base.where(F.col("n") == 0).select(F.xxhash64("id").alias("i"), F.col("th").alias("t"), F.lit(False).alias("once")).distinct()
    tagged = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(id_col)).alias("i"), F.xxhash64(F.col(text_col)).alias("t"))
    kept = tagged.join(staying.union(blank), ["i", "t"])
    # repeated rows meet in the join's partitions, so the count below moves nothing
    nth = F.row_number().over(Window.partitionBy("i", "t").orderBy(F.lit(0)))
    return kept.withColumn("nth", nth).where(~F.col("once") | (F.col("nth") == 1)).select("row.*")


def op5(docs: DataFrame) -> DataFrame:
    """The contract's join: 3-word shingles, Jaccard of 0.9 or more."""
    return jaccard_components(docs, width=3, percent=90)
