"""Registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import classifier, language, licenses, mixing, neighbours, packing, periodic, phrases, quality, repeats, secrets, shingles, topk
from siltstone.session import dealt, read_table


def _docs(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_table(spark, sf_dir))


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(read_table(spark, sf_dir, "documents"), "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_ownership": _docs(secrets.op1),
    "op2_best_fit_packing": _docs(packing.op2),
    "op3_fertility_rules": _docs(quality.op3),
    "op4_entropy_balancing": _docs(mixing.op4),
    "op5_parity_sketch_join": _docs(shingles.op5),
    "op6_permutation_index": lambda spark, sf_dir: neighbours.op6(read_table(spark, sf_dir, "embeddings")),
    "op7_byte_network": _docs(language.op7),
    "op8_license_dice": _docs(licenses.op8),
    "op9_suffix_dedup": _docs(repeats.op9),
    "op10_ngram_regression": lambda spark, sf_dir: classifier.op10(_table(spark, sf_dir), read_table(spark, sf_dir, "labels")),
    "op11_periodic_runs": _docs(periodic.op11),
    "op12_histogram_topk": lambda spark, sf_dir: topk.op12(read_table(spark, sf_dir, "embeddings")),
    "op13_phrase_graph": _docs(phrases.op13),
}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

#: Links by counting the shingles that two documents share, and components by all that can be reached.
_OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
l AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
s AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM l),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT l.doc_id, len(sh) AS n_shingles, c.component_id FROM l JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

#: Every window of 100 bytes, as hexadecimal text (cut from parts of 500 bytes and the 99 after
#: them); all but the first of equal ones flag their start.
_OP9 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, 500 * i AS p0, substr(h, 1000 * i + 1, 1198) AS h FROM (SELECT doc_id, h, unnest(range((length(h) + 999) // 1000)) AS i FROM t)),
b AS (SELECT doc_id, p0, h, unnest(range(least(500, length(h) // 2))) AS o FROM k),
f AS (SELECT doc_id, p0 + o AS p, substr(h, 2 * o + 1, 2) AS x, 2 * o + 200 <= length(h) AND row_number() OVER (PARTITION BY 2 * o + 200 <= length(h), md5_number(substr(h, 2 * o + 1, 200)) ORDER BY doc_id, p0 + o) > 1 AS again FROM b),
c AS (SELECT doc_id, p, x, bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
d AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM c),
g AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(x, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM d GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN g USING (doc_id)
"""

#: The base counts of the quality rules: symbols, repeated lines, and words in repeated windows of eight.
_QUALITY = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
g AS (SELECT doc_id, i, string_agg(x, ' ') OVER v AS gram, count(*) OVER v AS n FROM e WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
a AS (SELECT doc_id, i, n = 8 AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS again FROM g),
r AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM a) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
"""

#: The base spans of the secret scan, counted; DuckDB gives matches without their places.
_SECRETS = """
SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex FROM documents
"""

#: crc32 of a text, by its 256 remainders; fixed polynomial.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)),
  lambda s, b: xor(s >> 8, list_reduce(list_prepend((xor(s, b) & 255)::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda t, z: xor(t >> 1, (t & 1) * 3988292384)))))"""

#: Equal words a lag apart, in islands without a gap; of one stretch the least period.
_OP11 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w, {_CRC.format(x="doc_id::VARCHAR")}::BIGINT AS h FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g FROM w), b AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM a), c AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM b),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM c),
e AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM t),
q AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM e l JOIN e r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
d AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM u),
k AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.i) AS kept FROM e LEFT JOIN d ON d.doc_id = e.doc_id AND d.i = e.i WHERE d.i IS NULL GROUP BY e.doc_id),
r AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS best FROM u GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_OP12 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score FROM v q JOIN v r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

#: All grams of one to three words counted by themselves.
_OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS x, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
i AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN (SELECT lang, a, unnest([array_to_string(x[1:2], ' '), array_to_string(x[2:3], ' ')]) AS part FROM c WHERE k = 3) b ON b.lang = c.lang AND b.part = c.phrase AND 100 * b.a >= 50 * c.a WHERE c.k = 2),
z AS (SELECT c.lang, c.k, c.phrase, c.x, c.a, unnest(range(1, c.k)) AS cut FROM c ANTI JOIN i USING (lang, phrase)),
s AS (SELECT z.*, l.a AS l, r.a AS r, (1000000 * z.a * z.a) // (l.a * r.a) AS score FROM z JOIN f l ON l.lang = z.lang AND l.phrase = array_to_string(z.x[1:z.cut], ' ') JOIN f r ON r.lang = z.lang AND r.phrase = array_to_string(z.x[z.cut + 1:z.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM b JOIN n USING (lang) QUALIFY rank <= 2000
"""

#: Sizes, and the level at which shares by weight, each up to three times its source, add up to all.
_MIX = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * n / w::DOUBLE AS ratio, sum(n) OVER () AS total, coalesce(sum(3 * n) OVER before, 0) AS capped, sum(w) OVER after AS open FROM s
  WINDOW before AS (ORDER BY 3 * n / w::DOUBLE, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY 3 * n / w::DOUBLE, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT arg_min((total - capped)::DOUBLE / open, ratio) AS level FROM r WHERE (total - capped)::DOUBLE / open <= ratio),
t AS (SELECT source, n, least(3.0::DOUBLE * n, w * (SELECT level FROM l)) AS target FROM s)
SELECT d.doc_id, d.size, t.n AS source_size, round(t.target, 4) AS target FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
"""

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
QUERIES |= {
    # what of three operators' results SQL can state
    "quality_base_counts": lambda spark, sf_dir: QUERIES["op3_fertility_rules"](spark, sf_dir).select("doc_id", *_BASE),
    "mixing_targets": lambda spark, sf_dir: QUERIES["op4_entropy_balancing"](spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target")),
    "secret_base_counts": lambda spark, sf_dir: QUERIES["op1_secret_ownership"](spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex"),
}

ORACLE_SQL: dict[str, str] = {
    "op5_parity_sketch_join": _OP5,
    "op8_license_dice": licenses.oracle_op8(),
    "op9_suffix_dedup": _OP9,
    "op11_periodic_runs": _OP11,
    "op12_histogram_topk": _OP12,
    "op13_phrase_graph": _OP13,
    "mixing_targets": _MIX,
    "quality_base_counts": _QUALITY,
    "secret_base_counts": _SECRETS,
}
