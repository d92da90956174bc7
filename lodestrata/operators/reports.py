"""Oversized chunks, counters of runs, progress and project lists, as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.ids import OVERSIZED_TOKENS, report_tokens


def oversized_chunks(chunks: DataFrame) -> DataFrame:
    """project_id, file_path, symbol, token_count, max_allowed, content_size_bytes of chunks above the report's limit."""
    rows = chunks.withColumn("token_count", report_tokens("content")).where(F.col("token_count") > OVERSIZED_TOKENS)
    return rows.select("project_id", "file_path", "symbol", "token_count", F.lit(OVERSIZED_TOKENS).alias("max_allowed"), F.octet_length("content").alias("content_size_bytes"))


def oversized_report(oversized: DataFrame) -> DataFrame:
    """One row for each project with oversized chunks: counts and sizes. The chunks themselves stay rows, since a
    project may have any number of them; `write_oversized` writes both as JSON."""
    return oversized.groupBy("project_id").agg(
        F.count("*").alias("total_count"), F.max("max_allowed").alias("max_tokens_allowed"), F.max("token_count").alias("largest_tokens"), F.sum("content_size_bytes").cast("bigint").alias("total_bytes")
    )


def write_oversized(oversized: DataFrame, path: str) -> None:
    """Reports as JSON lines, a folder for each project; replaces what was there."""
    oversized_report(oversized).withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(f"{path}/summary")
    oversized.write.mode("overwrite").partitionBy("project_id").json(f"{path}/chunks")


def run_counters(scanned: DataFrame, indexed: DataFrame, skipped: DataFrame, deleted: DataFrame, created: DataFrame, stale: DataFrame, oversized: DataFrame) -> DataFrame:
    """The result of a run by project: files_scanned, _indexed, _skipped, _deleted, chunks_created, chunks_deleted, oversized."""
    names = ("files_scanned", "files_indexed", "files_skipped", "files_deleted", "chunks_created", "chunks_deleted", "oversized")
    parts = None
    for name, df in zip(names, (scanned, indexed, skipped, deleted, created, stale, oversized)):
        one = df.groupBy("project_id").agg(F.count("*").alias("n")).select("project_id", F.lit(name).alias("what"), "n")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("project_id").agg(*(F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0)).cast("bigint").alias(name) for name in names))


def summary(parts: list[DataFrame]) -> DataFrame:
    """One row for each project of frames with project_id and counters of their own; what a project lacks is zero."""
    names = ("files_scanned", "files_indexed", "files_skipped", "files_deleted", "chunks_created", "chunks_deleted", "oversized")
    rows = [p.select("project_id", *((F.col(n) if n in p.columns else F.lit(0)).cast("bigint").alias(n) for n in names)) for p in parts]
    return reduce(DataFrame.unionByName, rows).groupBy("project_id").agg(*(F.sum(n).cast("bigint").alias(n) for n in names))


def totals(counters: DataFrame) -> DataFrame:
    """Counters by project and, with a null project and `is_total` 1, over all."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in counters.columns if c != "project_id"]
    return counters.rollup("project_id").agg(F.grouping("project_id").cast("int").alias("is_total"), F.count("*").alias("projects"), *sums)


def progress(durations: DataFrame, remaining: int) -> DataFrame:
    """processed, average and estimated remaining seconds, percent done, of per-file `seconds`."""
    return durations.agg(F.count("*").alias("processed"), F.round(F.avg("seconds"), 6).alias("avg_seconds")).withColumns(
        {
            "eta_seconds": F.round(F.coalesce("avg_seconds", F.lit(0.0)) * remaining, 6),
            "percent": F.round(F.col("processed") * 100.0 / F.greatest(F.col("processed") + remaining, F.lit(1)), 4),
        }
    )


def list_projects(points: DataFrame) -> DataFrame:
    """project_id, chunk_count: distinct points of each project."""
    return points.where(F.col("project_id").isNotNull()).groupBy("project_id").agg(F.countDistinct("point_id").alias("chunk_count"))
