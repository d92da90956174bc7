"""Session helpers shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

OPEN_COST = 4 << 20  # spark.sql.files.openCostInBytes: the least size of a split


def local_session(cores: str | int = "*", app: str = "lodestrata") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LODESTRATA_DRIVER_MEMORY", "6g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, unfiltered; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` over at least as many partitions as there are cores, for stages that cost far more than moving their input.

    No job is run to find out. A scan is cut into fewer splits than cores only below cores x openCostInBytes, so inputs
    whose files together are smaller than that are exchanged, and larger ones are left as they are; what adaptive
    execution coalesces keeps a partition for each core by itself. With keys the rows are always placed by them, in a
    number of partitions that isn't coalesced afterwards.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if keys:
        return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
    return df.repartition(cores) if input_bytes(df) < cores * OPEN_COST else df


def input_bytes(df: DataFrame) -> int:
    """Estimated size of the tables under a plan, from the optimizer's statistics; nothing is executed."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each context, so that it need not be installed on executors."""
    context = spark.sparkContext
    if getattr(context, "_lodestrata_shipped", False):
        return
    package = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="lodestrata-package-")) / "lodestrata_package.zip"  # read by the driver's file server only
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path("lodestrata") / f.relative_to(package))
    context.addPyFile(str(bundle))
    context._lodestrata_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; choose a temporary one only in a local session without any."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="lodestrata-checkpoint-")
    spark.sparkContext.setCheckpointDir(shared)
