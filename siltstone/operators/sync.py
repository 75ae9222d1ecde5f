"""Incremental corpus sync: change classification, upserts, cascades, checks, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify_changes(files: DataFrame, known: DataFrame) -> DataFrame:
    """`files` (path, file_hash) with document_id and outcome against `known` (id, file_path, file_hash).

    Outcomes: skipped_unchanged (same path and hash), skipped_duplicate (the hash belongs to
    another document), updated (known path, new content, id kept), new. Files count in path
    order: the first one with a hash owns it. A document that itself changes in this batch at
    an earlier path gives its old hash free; one that is changed later still owns it.
    """
    mine = known.select(F.col("id").alias("document_id"), F.col("file_path").alias("path"), F.col("file_hash").alias("old_hash"))
    owner = known.select(F.col("file_path").alias("owner_path"), "file_hash")
    moved = files.select(F.col("path").alias("owner_path"), F.col("file_hash").alias("owner_new"))
    # an owner whose content changes in this batch holds the hash up to its own path only
    leaves = F.col("owner_new").isNotNull() & (F.col("owner_new") != F.col("file_hash"))
    owners = owner.join(moved, "owner_path", "left").groupBy("file_hash").agg(F.bool_or(~leaves).alias("held"), F.max(F.when(leaves, F.col("owner_path"))).alias("held_to"))
    joined = files.join(mine, "path", "left").join(owners, "file_hash", "left")
    unchanged = F.col("old_hash") == F.col("file_hash")
    taken = F.coalesce("held", F.lit(False)) | F.coalesce(F.col("path") <= F.col("held_to"), F.lit(False))
    marked = joined.withColumns({"unchanged": F.coalesce(unchanged, F.lit(False)), "taken": taken})
    first = F.row_number().over(Window.partitionBy("file_hash", F.col("unchanged") | F.col("taken")).orderBy("path"))
    outcome = (
        F.when(F.col("unchanged"), "skipped_unchanged")
        .when(F.col("taken") | (F.col("first") > 1), "skipped_duplicate")
        .when(F.col("document_id").isNotNull(), "updated")
        .otherwise("new")
    )
    return marked.withColumn("first", first).select("path", "file_hash", "document_id", outcome.alias("outcome"))


def upsert(table: DataFrame, rows: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """`table` with `rows` in place of those of equal key; created_at stays, updated_at is `now`."""
    created = table.select(key, F.col("created_at").alias("__created"))
    fresh = rows.drop("created_at", "updated_at").join(created, key, "left").withColumns({"created_at": F.coalesce("__created", now), "updated_at": now}).drop("__created")
    return table.join(rows.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def replace_children(table: DataFrame, rows: DataFrame, changed: DataFrame, key: str = "document_id") -> DataFrame:
    """`table` less all rows of the keys in `changed`, with `rows`."""
    return table.join(changed.select(key).distinct(), key, "left_anti").unionByName(rows)


def delete_documents(ids: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables less the documents in `ids` (id), their chunks and their vectors."""
    gone = ids.select(F.col("id").alias("document_id")).distinct()
    dead = chunks.join(gone, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return (
        documents.join(ids.select("id").distinct(), "id", "left_anti"),
        chunks.join(gone, "document_id", "left_anti"),
        vectors.join(dead, "chunk_id", "left_anti"),
    )


def wipe(table: DataFrame) -> DataFrame:
    """An empty table of the same columns; a rebuild is a sync against it."""
    return table.where(F.lit(False))


def lacking_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks to embed again from their stored text."""
    return chunks.join(vectors.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def heal_vectors(chunks: DataFrame, vectors: DataFrame, encode: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """`vectors` (chunk_id, embedding) and those of the chunks that lack one, embedded from their stored text.

    `encode` turns (rows, id column, text column) into (id, embedding).
    """
    made = encode(lacking_vectors(chunks, vectors).select(F.col("id").alias("chunk_id"), "text"), "chunk_id", "text")
    return vectors.select("chunk_id", "embedding").unionByName(made.select("chunk_id", "embedding"))


def find_documents(documents: DataFrame, id: str | None = None, file_hash: str | None = None, file_path: str | None = None) -> DataFrame:
    """The documents with the given id, content hash or path; all given values count."""
    for column, value in (("id", id), ("file_hash", file_hash), ("file_path", file_path)):
        if value is not None:
            documents = documents.where(F.col(column) == value)
    return documents


def list_documents(documents: DataFrame, status: str | None = None) -> DataFrame:
    """Documents, or those of one status, the newest first; ties by id."""
    chosen = documents if status is None else documents.where(F.col("status") == status)
    return chosen.orderBy(F.col("created_at").desc(), "id")


def chunks_of(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of the documents in `ids` (id), in the documents' order."""
    wanted = ids.select(F.col("id").alias("document_id")).distinct()
    return chunks.join(wanted, "document_id", "left_semi").orderBy("document_id", "chunk_index")


def sync_summary(outcomes: DataFrame) -> DataFrame:
    """One row: files in all and by outcome."""
    kinds = ("new", "updated", "skipped_unchanged", "skipped_duplicate", "failed")
    return outcomes.agg(F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])


def hydrate(hits: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Hits with the columns of their rows; ids that no longer exist drop out."""
    return hits.join(rows, key)


def replace_vectors(table: DataFrame, rows: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """`table` with `rows` (chunk_id, embedding) in place of equal ids; and rows of another dimension."""
    fits = F.coalesce(F.size("embedding") == dimension, F.lit(False))
    good = rows.where(fits)
    return table.join(good.select("chunk_id"), "chunk_id", "left_anti").unionByName(good), rows.where(~fits)


def integrity(vectors: DataFrame, chunks: DataFrame, dimension: int) -> DataFrame:
    """One row of counts and checks over the vector and chunk tables."""
    pairs = vectors.select("chunk_id", "embedding").join(chunks.select(F.col("id").alias("chunk")), F.col("chunk_id") == F.col("chunk"), "full_outer")
    return pairs.agg(
        F.count("chunk_id").alias("n_vectors"),
        F.count("chunk").alias("n_chunks"),
        F.count_if(F.col("chunk").isNull()).alias("orphans"),
        F.count_if(F.col("chunk_id").isNull()).alias("missing"),
        F.count_if(F.size("embedding") != dimension).alias("bad_dimension"),
    ).withColumn("ok", (F.col("orphans") == 0) & (F.col("missing") == 0) & (F.col("bad_dimension") == 0))


def statistics(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks and the mean characters of a chunk (one decimal, 0 if none)."""
    return documents.agg(F.count(F.lit(1)).alias("documents")).join(
        # two frames of one row each
        F.broadcast(chunks.agg(F.count(F.lit(1)).alias("chunks"), F.round(F.coalesce(F.avg("char_count"), F.lit(0.0)), 1).alias("mean_chars"))), how="cross",
    )


def chunks_by_collection(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("collection_title", "law_name", F.lit("Unknown")).alias("collection")).agg(F.count(F.lit(1)).alias("chunks"))


def collections(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and chunks of each collection; documents without one are left out."""
    docs = documents.where(F.col("collection_id").isNotNull()).groupBy("collection_id").agg(
        F.min("collection_category").alias("category"), F.min("collection_title").alias("title"), F.count(F.lit(1)).alias("documents"))
    parts = chunks.groupBy("collection_id").agg(F.count(F.lit(1)).alias("chunks"))
    return docs.join(parts, "collection_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def profile(df: DataFrame) -> DataFrame:
    """(column, type, nulls) of every column, in one pass."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"`{c}`").alias("nulls")) for c, t in df.dtypes])
    return row.select(F.inline(entries))
