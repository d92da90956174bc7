"""A streaming trigger for the index job.

Spark's file stream notices new paths, not edits or deletions, so the stream only says that something arrived, and
each micro-batch runs the batch difference for the files it brought.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.sources.files import describe


def incoming(spark: SparkSession, folder: str, files_per_trigger: int = 10_000) -> DataFrame:
    """A stream of file rows (project_id, file_path, text) that are dropped as Parquet into a folder."""
    return spark.readStream.schema("project_id string, file_path string, text string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def newest_per_file(batch: DataFrame) -> DataFrame:
    """A micro-batch may bring a file twice; the larger hash counts, so that a replay decides alike."""
    rows = describe(batch)
    rest = [c for c in rows.columns if c not in ("project_id", "file_path")]
    return rows.groupBy("project_id", "file_path").agg(F.max_by(F.struct(*rest), "file_hash").alias("r")).select("project_id", "file_path", "r.*")


def start(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run `run(files, batch_id)` for each micro-batch; batches are idempotent because chunk ids are."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: run(newest_per_file(batch), n))
    return (writer.trigger(availableNow=True) if once else writer).start()
