"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every whole text, their values hashed, and the hashes counted over
the corpus by distinct repositories and distinct owners. A value that many owners hold, or
that is in very many repositories, is a widely copied example; one that a single owner holds in
a few places, and that looks random, is live-looking.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._cluster import keep, n_buckets, with_counts
from siltstone.llm._words import plain, slices

#: Kinds of the base patterns, in their order; fixed values.
BASE_KINDS = ("assign", "access", "hex")
#: Kinds that count only where their value is no example and no placeholder, after the base kinds in order.
OWNED_KINDS = ("key_block", "prefixed", "jwt", "random")

# Fixed patterns of the base kinds. Case-insensitive ones fold ASCII letters alone.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters or more: shorter runs hold no longer match
_HEX = re.compile(r"[0-9a-f]{16,}")
_OWNED = {
    "key_block": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}"),
    "prefixed": re.compile(r"\b(?:gh[pousr]_|sk_live_|rk_live_|xox[abprs]-|glpat-|AIza)[A-Za-z0-9_-]{16,}"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "random": re.compile(r"[A-Za-z0-9+/_-]{24,}"),
}
#: Bits a character below which a value is taken for a placeholder.
MIN_ENTROPY = 2.5
#: Owners, and repositories whoever owns them, from which on a value counts as widely copied.
WIDESPREAD_OWNERS, WIDESPREAD_REPOS = 3, 50

_SPAN = "struct<start:int,end:int,kind_no:int,kind:string,hash:long,entropy:double>"


def entropy(value: str) -> float:
    """Shannon entropy of the characters, in bits each."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def find_spans(text: str) -> list[tuple[int, int, int, str, str]]:
    """(start, end, number of the kind, kind, value) of all candidates, by start then kind.

    Base kinds: leftmost non-overlapping matches of each. Other kinds are candidates only
    where they overlap no base span and no earlier one of theirs. Linear in the text: which
    characters are taken is marked in a byte for each.
    """
    found = [(m.start(), m.end(), 0, "assign", m[2]) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), 1, "access", m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, "hex", m[0]) for m in _HEX.finditer(text)]
    taken = bytearray(len(text))
    for a, b, *_ in found:
        taken[a:b] = b"\1" * (b - a)
    for no, (kind, pattern) in enumerate(_OWNED.items(), len(BASE_KINDS)):
        for m in pattern.finditer(text):
            v = m[0]
            if kind == "random" and not (re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and entropy(v) >= 3.5):
                continue
            a, b = m.span()
            if taken.find(1, a, b) < 0:
                taken[a:b] = b"\1" * (b - a)
                found.append((a, b, no, kind, v))
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind_no", pa.int32()), ("kind", pa.string()), ("hash", pa.int64()), ("entropy", pa.float64())]))
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = []
            for text in plain(batch.column("text")).to_pylist():
                rows.append([
                    {"start": a, "end": b, "kind_no": no, "kind": k, "hash": int.from_bytes(hashlib.blake2b(v.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True), "entropy": entropy(v)}
                    for a, b, no, k, v in find_spans(text)
                ])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("owner"), batch.column("repo"), pa.array(rows, kind)], ["id", "owner", "repo", "spans"])


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners, n_uses) of candidates (hash, owner, repo).

    Counted in three steps, each combined before its shuffle, so that a value which fills
    a third of the corpus is a few rows per task by the time it meets.
    """
    uses = candidates.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("uses"))
    owners = uses.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("uses").alias("uses"))
    return owners.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("uses").alias("n_uses"))


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str | None = None,
    widespread_owners: int = WIDESPREAD_OWNERS,
    widespread_repos: int = WIDESPREAD_REPOS,
    min_entropy: float = MIN_ENTROPY,
) -> DataFrame:
    """One row per input row: `id_col` and `spans`, each span with its counts and verdict.

    Span: start, kind_no, end (code points, end exclusive), kind, hash, entropy, n_repos,
    n_owners, verdict. Verdicts: `example` (held by `widespread_owners` owners or more, or in
    `widespread_repos` repositories or more), `placeholder` (entropy under `min_entropy`), `live` (a single owner), else `shared`.
    Base kinds are always reported, other kinds only as `live` or `shared`.

    `owner_col` names owners, `repo_col` repositories of an owner (default: each row is one).
    Null texts are empty and give no span; a null owner or repository is one of its own;
    repeated rows are scanned each; an empty table gives an empty result. Other columns are
    not read, so their names can not clash.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col or id_col).cast("string").alias("repo"),
        F.col(text_col).alias("text"),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_scan, f"id {id_type}, owner string, repo string, spans array<{_SPAN}>")
    found = keep(found.withColumn("uid", F.monotonically_increasing_id()), "secrets")
    each = found.where(F.size("spans") > 0).select("uid", "id", "owner", "repo", F.explode("spans").alias("span"))
    each = each.select("uid", "id", "owner", "repo", "span.*")
    counts = keep(ownership(each), "owners")
    verdict = (
        F.when((F.col("n_owners") >= widespread_owners) | (F.col("n_repos") >= widespread_repos), "example")
        .when(F.col("entropy") < min_entropy, "placeholder")
        .when(F.col("n_owners") == 1, "live")
        .otherwise("shared")
    )
    judged = with_counts(each, counts, "hash", "n_uses", n_buckets(docs.sparkSession)).withColumn("verdict", verdict)
    judged = judged.where((F.col("kind_no") < len(BASE_KINDS)) | F.col("verdict").isin("live", "shared"))
    # by start, then kind
    span = F.struct("start", "kind_no", "end", "kind", "hash", "entropy", "n_repos", "n_owners", "verdict")
    # a document's own spans meet here; texts stay where they are
    listed = judged.groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("judged"))
    none = F.array().cast(listed.schema["judged"].dataType)
    return found.select("uid", F.col("id").alias(id_col)).join(listed, "uid", "left").select(id_col, F.coalesce("judged", none).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mask: str = "<secret>") -> DataFrame:
    """The rows of `docs` with every reported span that is no widely copied example masked.

    Needs unique non-null ids to carry spans to texts; a row whose id is null or repeated is
    joined with the spans of its own text by id and text hash. All other columns pass through,
    whatever their names. A null text stays null; repeated rows are all masked alike.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("k"),
        F.col(text_col).alias("t"),
        F.col(owner_col).alias("o"),
        F.col(id_col).cast("string").alias("r"),
    )
    spans = scan_secrets(rows.select("k", "t", "o", "r"), "k", "t", "o", "r")
    hit = spans.select("k", F.filter("spans", lambda s: s["verdict"] != "example").alias("hit")).where(F.size("hit") > 0)
    hit = hit.groupBy("k").agg(F.first("hit").alias("hit"))
    joined = rows.select("row", "k", "t").join(hit, "k", "left")
    # only texts with spans go to Python, and come back
    text = F.coalesce(masked(F.when(F.col("hit").isNotNull(), F.col("t")), F.col("hit"), mask), F.col("t"))
    return joined.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def mask_spans(text: str, spans: Iterable[tuple[int, int]], mask: str) -> str:
    """`text` with the sorted `spans` replaced; overlapping spans get one mask."""
    parts, at = [], 0
    for start, end in spans:
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def masked(text: Column, spans: Column, mask: str) -> Column:
    """mask_spans() of a text and an array of structs; null for a null text."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mask_spans(t, zip(a, b, strict=True), mask) for t, a, b in zip(texts, starts, ends, strict=True)], dtype=object)

    return run(text, F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]))


def spans_text(spans: Column, base_only: bool = False) -> Column:
    """kind:start:end of the spans, comma-joined, in their order."""
    chosen = F.filter(spans, lambda s: s["kind_no"] < len(BASE_KINDS)) if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1(docs: DataFrame) -> DataFrame:
    """The contract's digest of scan_secrets over `documents`."""
    found = scan_secrets(docs)

    def n(field: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")

    return found.select(
        "doc_id",
        *[n("kind", k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(spans_text(F.col("spans"), base_only=True), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        n("verdict", "live").alias("n_live"),
        n("verdict", "example").alias("n_example"),
        *[F.coalesce(F.array_max(F.transform("spans", lambda s: s[c])), F.lit(0)).cast("long").alias(f"most_{c[2:]}") for c in ("n_owners", "n_repos")],  # noqa: B023
    )
