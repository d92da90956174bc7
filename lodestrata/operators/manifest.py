"""The manifest of indexed files and the differences between it and a scan, all as joins.

Manifest rows: project_id, file_path, file_hash, mod_time, indexed_at, chunk_ids ARRAY<STRING>, chunk_hashes MAP<STRING,STRING>.
Files: project_id, file_path, file_hash. Chunks: project_id, file_path, chunk_id, content_hash, position.
Keys compare null-safely: a null project or path is a value of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["project_id", "file_path"]


def latest(manifest: DataFrame) -> DataFrame:
    """The newest state of each file; of equal times the one with the larger hash. Nulls in time come last."""
    order = F.struct(F.coalesce("indexed_at", F.lit("1970-01-01").cast("timestamp")).alias("t"), F.coalesce("file_hash", F.lit("")).alias("h"), F.coalesce(F.array_join("chunk_ids", ","), F.lit("")).alias("c"), F.col("chunk_hashes").isNotNull().alias("m"), F.coalesce("mod_time", F.lit("1970-01-01").cast("timestamp")).alias("f"))
    rest = [c for c in manifest.columns if c not in KEY]
    newest = manifest.groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return newest.select(*KEY, "r.*")


def latest_hashes(manifest: DataFrame) -> DataFrame:
    """Key and file_hash of the newest state of each file; chunk columns, which may be large, are not read.

    Equal times are decided by the larger hash before anything else, so this agrees with `latest`.
    """
    order = F.struct(F.coalesce("indexed_at", F.lit("1970-01-01").cast("timestamp")).alias("t"), F.coalesce("file_hash", F.lit("")).alias("h"), F.col("file_hash").isNotNull().alias("n"))
    newest = manifest.groupBy(*KEY).agg(F.max(order).alias("r"))
    return newest.select(*KEY, F.when(F.col("r.n"), F.col("r.h")).alias("file_hash"))


def _join(left: DataFrame, right: DataFrame, how: str, *more: str) -> DataFrame:
    """A semi or anti join on the file key and more columns, nulls equal; the right side is renamed, since both sides may come from one table."""
    on = [*KEY, *more]
    other = right.select(*(F.col(c).alias(f"__{c}") for c in on))
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(other, condition, how)


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or have another hash than the manifest."""
    old = latest_hashes(manifest)
    return _join(files, old, "left_anti", "file_hash")


def skipped_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose hash is that of the manifest."""
    old = latest_hashes(manifest)
    return _join(files, old, "left_semi", "file_hash")


def deleted_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of the manifest that the scan no longer has."""
    return _join(manifest.select(*KEY).distinct(), files, "left_anti").select(*KEY)


def chunk_entries(manifest: DataFrame) -> DataFrame:
    """One row for each chunk of the latest state: project_id, file_path, chunk_id, chunk_hash.

    Entries without chunk_hashes fall back to their chunk_ids with a null hash, so that no chunk is orphaned.
    """
    ids = F.coalesce("chunk_ids", F.array().cast("array<string>"))
    keys = F.coalesce(F.map_keys("chunk_hashes"), F.array().cast("array<string>"))
    rows = latest(manifest).select(*KEY, "chunk_hashes", F.explode(F.array_distinct(F.concat(ids, keys))).alias("chunk_id"))
    return rows.select(*KEY, "chunk_id", F.try_element_at("chunk_hashes", F.col("chunk_id")).alias("chunk_hash"))


def purged_chunks(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunk ids of deleted files."""
    entries, gone = chunk_entries(manifest), deleted_files(files, manifest)
    return _join(entries, gone, "left_semi").select(*KEY, "chunk_id").distinct()


def changed_chunks(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks that are new, or have a known id with another hash. A chunk that only moved is unchanged."""
    old = chunk_entries(manifest).withColumnRenamed("chunk_hash", "content_hash")
    return _join(chunks, old, "left_anti", "chunk_id", "content_hash")


def stale_chunks(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunk ids of the manifest that a file among `chunks` no longer has."""
    old = chunk_entries(manifest)
    seen = chunks.select(*KEY).distinct()
    old = _join(old, seen, "left_semi")
    return _join(old, chunks, "left_anti", "chunk_id").select(*KEY, "chunk_id").distinct()


def upsert(chunks: DataFrame, files: DataFrame, manifest: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """The manifest with the processed files replaced: ids in order of position, each once; hashes by id.

    Commit the result only after the vector store has committed, so that a failed write is tried again.
    """
    now = F.current_timestamp() if now is None else now
    per_id = chunks.groupBy(*KEY, "chunk_id").agg(F.min("position").alias("position"), F.max("content_hash").alias("content_hash"))
    packed = F.array_sort(F.collect_list(F.struct("position", "chunk_id", "content_hash")))  # bounded by the chunks of one file
    entries = per_id.groupBy(*KEY).agg(packed.alias("c"))
    entries = entries.select(*KEY, F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"), F.map_from_entries(F.transform("c", lambda x: F.struct(x["chunk_id"], x["content_hash"]))).alias("chunk_hashes"))
    new = files.select(*KEY, "file_hash").dropDuplicates(KEY).join(entries, KEY, "left").select(*KEY, "file_hash", now.alias("mod_time"), now.alias("indexed_at"), "chunk_ids", "chunk_hashes")
    if manifest is None:
        return new
    old = latest(manifest)
    return _join(old, new, "left_anti").unionByName(new)


def file_states(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """project_id and how many files were scanned, indexed (new or changed), skipped and deleted, by one join on the file key."""
    old = latest_hashes(manifest).select(*(F.col(c).alias(f"__{c}") for c in (*KEY, "file_hash")), F.lit(True).alias("__known"))
    same = F.lit(True)
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = files.select(*KEY, "file_hash", F.lit(True).alias("__seen")).join(old, same, "full")
    seen, equal = F.col("__seen").isNotNull(), F.col("__known").isNotNull() & F.col("file_hash").eqNullSafe(F.col("__file_hash"))
    return both.groupBy(F.when(seen, F.col("project_id")).otherwise(F.col("__project_id")).alias("project_id")).agg(
        F.count(F.when(seen, 1)).alias("files_scanned"), F.count(F.when(seen & ~equal, 1)).alias("files_indexed"), F.count(F.when(seen & equal, 1)).alias("files_skipped"), F.count(F.when(~seen, 1)).alias("files_deleted")
    )


def chunk_states(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """project_id and how many chunks are new or changed and how many stale, by one join on the chunk key and one on the file key."""
    entries = _join(chunk_entries(manifest), chunks.select(*KEY).distinct(), "left_semi")
    old = entries.distinct().select(*(F.col(c).alias(f"__{c}") for c in (*KEY, "chunk_id", "chunk_hash")), F.lit(True).alias("__known"))
    same = F.lit(True)
    for c in (*KEY, "chunk_id"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    both = chunks.select(*KEY, "chunk_id", "content_hash", F.lit(True).alias("__seen")).join(old, same, "full")
    seen, equal = F.col("__seen").isNotNull(), F.col("__known").isNotNull() & F.col("content_hash").eqNullSafe(F.col("__chunk_hash"))
    return both.groupBy(F.when(seen, F.col("project_id")).otherwise(F.col("__project_id")).alias("project_id")).agg(F.count(F.when(seen & ~equal, 1)).alias("chunks_created"), F.count(F.when(~seen, 1)).alias("chunks_deleted"))


def stats(manifest: DataFrame) -> DataFrame:
    """file_count, chunk_count over the latest states."""
    size = F.when(F.col("chunk_ids").isNull(), 0).otherwise(F.size("chunk_ids"))
    return latest(manifest).agg(F.count("*").alias("file_count"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("chunk_count"))
