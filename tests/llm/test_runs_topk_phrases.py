"""Periodic runs, exact top-k and phrases against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import periodic, phrases, topk
from siltstone.llm._words import SPACES, cut_words

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string"


def brute_runs(words):
    """Every maximal stretch of 4 periods and 6 words or more, by (start, length, period)."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng, n):
    """A text of plain words, repeats of all kinds of periods, and repeats within repeats."""
    out = []
    while len(out) < n:
        kind = rng.randrange(5)
        if kind == 0:
            out += [f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 30))]
        elif kind == 1:
            out += [f"v{rng.randrange(2)}" for _ in range(rng.randrange(1, 40))]
        else:
            unit = [f"p{rng.randrange(4 if kind == 2 else 99)}" for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100]))]
            if kind == 4:
                unit += unit[: len(unit) // 2] * 4
            out += (unit * rng.randrange(2, 8))[: rng.randrange(1, 8 * len(unit))]
    return out[:n]


def test_runs_of_arrays():
    rng = random.Random(1)
    for _ in range(120):
        texts = [repetitive(rng, rng.randrange(0, 900)) for _ in range(rng.randrange(1, 4))]
        codes, vocabulary, bounds, _ = cut_words(pa.array([" ".join(t) for t in texts]), SPACES)
        found = periodic.find_runs(codes, bounds)
        want = [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t)]
        assert [tuple(r) for r in found.tolist()] == want
        kept, upto = periodic.collapse(codes, bounds, found)
        for i, t in enumerate(texts):
            assert " ".join(vocabulary.take(pa.array(kept[upto[i] : upto[i + 1]])).to_pylist()) == collapsed(t, [r[1:] for r in want if r[0] == i])


def test_long_periods():
    rng = random.Random(2)
    unit = [f"u{rng.randrange(10**6)}" for _ in range(3000)]
    words = ["a", "b", *(unit * 5)[:13000], "c"]
    codes, _, bounds, _ = cut_words(pa.array([" ".join(words)]), SPACES)
    assert periodic.find_runs(codes, bounds).tolist() == [[0, 2, 13000, 3000]]


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(repetitive(rng, rng.randrange(0, 400))), "en") for i in range(150)]
    rows += [(i, " ".join(f"plain{rng.randrange(999)}" for _ in range(300)), None) for i in range(150, 300)]
    rows += [(None, None, None), (None, "x " * 9, "en"), (300, "", "en"), (301, " \t\n\x0b", "en"), (302, "one", "en"), (303, "é " * 7 + "ü", "en"), (303, "é " * 7 + "ü", "en"), (304, "z\x0bz\x0cz\rz\nz\tz", "en")]
    rows += [(305, " ".join(f"L{rng.randrange(10**6)}" for _ in range(4000)) + " tail tail" * 50, "en")]
    return spark.createDataFrame(rows, SCHEMA)


def test_op11(docs):
    odd = docs
    for name in ("id", "runs", "collapsed", "start", "longest"):
        odd = odd.withColumn(name, F.lit(f"own {name}"))
    found = Counter(tuple(r) for r in periodic.op11(odd).collect())
    want = Counter()
    for r in docs.collect():
        words = planted(r.doc_id, WORD.findall(r.text or ""))
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want[(r.doc_id, len(runs), *four, digest(lines), digest(collapsed(words, runs)))] += 1
    assert found == want and sum(1 for r in want if r[1]) > 100
    assert periodic.op11(odd.where("false")).count() == 0


def test_runs_with_other_limits(spark):
    df = spark.createDataFrame([(1, "a b " * 5 + "c " * 8, "en")], SCHEMA)
    assert [tuple(x) for x in periodic.periodic_runs(df, repeats=5, least_words=9).first().runs] == [(0, 10, 2)]
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, repeats=3)


# ---- top-k


def brute_topk(rows, queries, k, factor=256.0):
    import math

    top = np.finfo(np.float64).max
    whole = lambda v: [int(max(-top, min(top, math.floor(x * factor) if abs(x * factor) < math.inf else math.copysign(top, x)))) for x in v]
    data, out = {(i, tuple(v)) for i, v in rows}, set()
    for q, v in {(i, tuple(v)) for i, v in queries}:
        a = whole(v)
        scored = [(-max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(a, whole(w), strict=True)))), i) for i, w in data if i != q]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("scale", [1.0, 900.0, 1e5, 1e9, 1e300])
def test_topk(spark, scale, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.integers(-20, 20, 6) / 20 * scale).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, [0.0] * 6), (2050, rows[3][1])]
    odd = [(3000, None), (3001, [1.0, None, 0, 0, 0, 0]), (3002, [float("nan")] * 6), (3003, [float("inf")] * 6), (3004, [1.0, 2.0]), (None, [1.0] * 6), rows[5]]
    df = frame(spark, rows + odd).withColumn("rb", F.lit("own")).withColumn("score", F.lit("own"))
    for small in (True, False):
        if not small:  # shuffled query blocks, several blocks on both sides
            monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
            monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
            monkeypatch.setattr(topk, "ROW_BLOCK", 100)
        got = {tuple(r) for r in topk.op12(df).collect()}
        assert got == brute_topk(rows, [r for r in rows if r[0] % 50 == 0], 5)


def test_topk_of_few(spark):
    few = frame(spark, [(0, [1.0, 2.0]), (50, [0.5, 0.5]), (3, [0.0, 0.0])])
    assert {tuple(r) for r in topk.op12(few).collect()} == brute_topk([(0, [1.0, 2.0]), (50, [0.5, 0.5]), (3, [0.0, 0.0])], [(0, [1.0, 2.0]), (50, [0.5, 0.5])], 5)
    assert topk.op12(few.where("vec_id = 50")).count() == 0 and topk.op12(few.where("false")).count() == 0
    assert topk.op12(few.where("vec_id = 3")).count() == 0 and topk.op12(frame(spark, [(0, None), (1, [])])).count() == 0


# ---- phrases


def brute_phrases(rows, least, percent, top):
    counts, out = defaultdict(Counter), []
    for text, lang in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        ranked = []
        for g, a in f.items():
            if len(g) == 1 or a < least or any(len(h) == 3 and len(g) == 2 and g in (h[:2], h[1:]) and b >= least and 100 * b >= percent * a for h, b in f.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        ranked.sort()
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(ranked[:top])]
    return sorted(out)


def phrase_rows(seed=9, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "Aa", "aa", "a\x01b", "漢字", "x-y", " "]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary[: rng.choice([4, 12, len(vocabulary)])]) + rng.choice(["", "", "", ".", ",", "!\n", "?"]) for _ in range(rng.randrange(0, 40))]
        rows.append((i, rng.choice([" ", "  ", "\t"]).join(words), [None, "en", "de", "und", ""][i % 5]))
    long = " ".join(f"law{j}" for j in range(30))  # a path, its end and its start met elsewhere too
    rows += [(1000 + i, f"{'pre ' * (i % 2)}{long} {'post' * (i % 3)}", "en") for i in range(25)] + [(1100 + i, "law29 tail law0", "en") for i in range(12)]
    rows += [(1200 + i, "go round " * 8, "fr") for i in range(3)] + [(1210, "same " * 40, "fr")]  # closed paths
    rows += [(1300, None, "en"), (1301, "", None), (1302, "...", "xx"), (1303, "alone", "yy"), rows[3], rows[3], (None, "w1 w2 w3", None)]
    return rows


@pytest.mark.parametrize("least,percent,top", [(10, 50, 2000), (3, 80, 25)])
def test_phrases(spark, least, percent, top):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("node", "next", "n", "kind", "hot", "score"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    got = sorted(tuple(r) for r in phrases.phrases(df, least, percent, top).collect())
    want = brute_phrases([r[1:] for r in rows], least, percent, top)
    assert got == want and len(want) > 30


def test_phrases_at_small_limits(spark, monkeypatch):
    """Sums cut at every few rows, and nearly all nodes dealt by third word too."""
    monkeypatch.setattr(phrases, "SLICE", 500)
    rows = phrase_rows(3, 120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    texts = df.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.substring_index("key", "\t", 1)
    edges = texts.mapInArrow(phrases._edges, phrases._ROWS)
    hot = [r[0] for r in edges.select(node).where(node < "w2").distinct().collect()]
    dealt = edges.repartition(3, node, "lang", F.when(node < "w2", F.col("key"))).sortWithinPartitions("key", "lang")
    for size in (1, 7, 200_000):
        sums = phrases._sums(4, pa.array(hot), size)
        got = dealt.mapInArrow(sums, phrases._SUMS).groupBy("kind", "lang", "node", "next").agg(F.sum("n").alias("n")).where((F.col("kind") == 1) | (F.col("n") >= 4))
        found = {(r.kind, r.lang, r.node if r.next is None else f"{r.node} {r.next}"): r.n for r in got.collect()}
        counts = Counter()
        for _, text, lang in rows:
            for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
                w = re.findall("[^\x20\x09]+", piece)
                counts.update((k, "und" if lang is None else lang, " ".join(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        assert found == {g: n for g, n in counts.items() if g[0] == 1 or n >= 4}


def test_paths(spark):
    rows = [(i, "one two three four five six", "en") for i in range(10)] + [(20 + i, "three four seven", "en") for i in range(10)]
    sums = phrases.graph(spark.createDataFrame(rows, SCHEMA), 10)
    got = {(" ".join(r.words), r.n) for r in phrases.paths(sums).collect()}
    assert got == {("one two three four", 10), ("three four five six", 10), ("three four seven", 10)}


def test_hot_nodes(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["hot pair", f"x{rng.randrange(10**6)}"] * 1 + [f"y{rng.randrange(10**6)}" for _ in range(6)]), "en") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert [(r.node, r.lang) for r in phrases.hot_nodes(df.select("lang", "text"), 4).collect()] == [("hot pair", "en")]


def test_no_phrases(spark):
    df = spark.createDataFrame([(1, "a b c", "en"), (2, None, None)], SCHEMA)
    assert phrases.op13(df).count() == 0 and phrases.op13(df.where("false")).count() == 0
