"""The vector store and the manifest beside it: versions of Parquet partitions, and keyed changes as joins.

Rows lie in partitions of a project and a bucket of their key. A change writes only the partitions it touches, into a
version folder of its own; a small index says which version of each partition counts, and is published by replacing one
pointer file in a single rename. Readers see the old state or the new one, and no path that is being read is overwritten.
There may be any number of readers, and one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.search import Filter, one_per_point
from lodestrata.session import ensure_checkpoint_dir

BUCKETS = 4  # partitions of a project unless a collection is made with more; a large one has thousands
PARTITION = ["project_id", "bucket"]


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """`existing` with the points of `new` put in by point_id; of repeated ids within `new` the last written counts."""
    fresh = one_per_point(new)
    return existing.join(fresh.select("point_id"), "point_id", "left_anti").unionByName(fresh)


def delete_ids(existing: DataFrame, ids: DataFrame) -> DataFrame:
    """`existing` without the points of `ids` (column point_id); unknown ids have no effect."""
    return existing.join(ids.select("point_id").distinct(), "point_id", "left_anti")


def delete_by_filter(existing: DataFrame, where: Filter) -> DataFrame:
    """`existing` without a project. Only the project counts; without one nothing is deleted but an error raised."""
    if not where.project_id:
        raise ValueError("a filter without project_id would delete everything")
    return existing.where(~F.col("project_id").eqNullSafe(F.lit(where.project_id)))


def same_partition(left: str = "", right: str = "__") -> F.Column:
    return F.col(f"{left}project_id").eqNullSafe(F.col(f"{right}project_id")) & (F.col(f"{left}bucket") == F.col(f"{right}bucket"))


@dataclass(frozen=True)
class Versions:
    """Rows at a path, in versions of the partitions (project_id, bucket of `key`); their number is fixed when it is made."""

    spark: SparkSession
    path: str
    key: str
    buckets: int = BUCKETS

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def pointer(self) -> dict | None:
        at = self._path("CURRENT")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, body: dict) -> None:
        """Replace the pointer in one rename, so that there is one at any time."""
        jvm = self.spark._jvm
        new, now = self._path(f"CURRENT.{uuid.uuid4().hex}"), self._path("CURRENT")
        conf = self.spark._jsc.hadoopConfiguration()
        out = new.getFileSystem(conf).create(new, True)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(now.toUri(), conf).rename(new, now, options)

    def bucketed(self, rows: DataFrame) -> DataFrame:
        made = self.pointer()
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(made["buckets"] if made else self.buckets)).cast("int"))

    def index(self) -> DataFrame:
        """version, project_id, bucket of the partitions that count."""
        return self.spark.read.schema("version string, project_id string, bucket int").parquet(f"{self.path}/index/{self.pointer()['index']}")

    def read(self, only: DataFrame | None = None) -> DataFrame:
        """The rows that count, with `bucket`; with `only`, those of its partitions. Others are pruned, not read."""
        live = self.index()
        if only is not None:
            other = only.select(*(F.col(c).alias(f"__{c}") for c in PARTITION))
            live = live.join(other, same_partition(), "left_semi")
        live = live.select(*(F.col(c).alias(f"__{c}") for c in ("version", *PARTITION)))
        rows = self.spark.read.schema(self.pointer()["schema"] + ", version string, project_id string, bucket int").parquet(f"{self.path}/rows")
        return rows.join(live, (F.col("version") == F.col("__version")) & same_partition(), "left_semi").drop("version")

    def write(self, rows: DataFrame, touched: DataFrame | None, **more) -> None:
        """Put `rows` in place of all partitions, or of those of `touched`, which hold every partition of `rows`."""
        version, before = uuid.uuid4().hex, self.pointer()
        rows = rows.select(*(c for c in rows.columns if c not in PARTITION), *PARTITION)
        schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n not in PARTITION)
        if before and touched is not None and before["schema"] != schema:
            raise ValueError(f"the collection has the columns {before['schema']}, not {schema}")
        rows.repartition(*PARTITION).write.partitionBy(*PARTITION).parquet(f"{self.path}/rows/version={version}")
        if touched is None:  # what was written, by its folders
            touched, before = self.spark.read.schema(schema + ", project_id string, bucket int").parquet(f"{self.path}/rows/version={version}").select(*PARTITION).distinct(), None
        index = touched.select(F.lit(version).alias("version"), *PARTITION)
        if before:
            other = touched.select(*(F.col(c).alias(f"__{c}") for c in PARTITION))
            index = index.unionByName(self.index().join(other, same_partition(), "left_anti"))
        index.coalesce(1).write.parquet(f"{self.path}/index/{version}")  # a row for each project and bucket
        self.publish({"index": version, "schema": schema, "buckets": (self.pointer() or {}).get("buckets", self.buckets), **more})

    def vacuum(self) -> list[str]:
        """Delete versions that the current index doesn't name; call it when no reader is left on an older state."""
        live = {r.version for r in self.index().select("version").distinct().collect()}  # one for each change since the last rewrite
        fs = self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = []
        for folder, keep in ((f"{self.path}/rows", {f"version={v}" for v in live}), (f"{self.path}/index", {self.pointer()["index"]})):
            for status in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(folder)):
                name = status.getPath().getName()
                if name not in keep and not name.startswith("_"):
                    fs.delete(status.getPath(), True)
                    gone.append(name)
        return gone

    def change(self, gone: DataFrame | None, new: DataFrame | None, new_keys: DataFrame | None = None, drop: list[str] | None = None, **more) -> None:
        """Delete keys, drop projects and put rows in by key, in one version.

        `gone` and `new_keys` have project_id and the key; `new_keys` are those of `new`, told beforehand where making
        the rows is expensive, so that they are made once. A key lies in one project.
        """
        if self.pointer() is None:
            if new is None:
                raise FileNotFoundError(f"nothing at {self.path}")
            return self.write(self.bucketed(new), None, **more)
        schema = {n: t for n, t in self.read().dtypes}
        if new is not None and (other := {n: t for n, t in new.dtypes if schema.get(n) != t}):
            raise ValueError(f"the collection has other columns than {other}")
        keys = [x.select("project_id", self.key) for x in (gone, new_keys if new_keys is not None else new) if x is not None]
        out = reduce(DataFrame.unionByName, keys) if keys else self.spark.createDataFrame([], f"project_id string, {self.key} string")
        touched = self.bucketed(out).select(*PARTITION)
        if drop:
            touched = touched.unionByName(self.index().where(F.col("project_id").isin(drop)).select(*PARTITION))
        touched = touched.distinct().checkpoint()  # at most a row for each bucket of a project
        kept = self.read(touched).join(out.select(F.col("project_id").alias("__project_id"), F.col(self.key).alias("__key")), F.col("project_id").eqNullSafe(F.col("__project_id")) & (F.col(self.key) == F.col("__key")), "left_anti")
        if drop:
            kept = kept.where(~F.coalesce(F.col("project_id").isin(drop), F.lit(False)))
        rows = kept if new is None else kept.unionByName(self.bucketed(new).select(*kept.columns))
        self.write(rows, touched, **more)


@dataclass(frozen=True)
class Store:
    """A collection at a path, of vectors of one dimension."""

    spark: SparkSession
    path: str
    dimensions: int
    buckets: int = BUCKETS

    @property
    def versions(self) -> Versions:
        return Versions(self.spark, self.path, "point_id", self.buckets)

    def exists(self) -> bool:
        return self.versions.pointer() is not None

    def _meta(self) -> dict:
        meta = self.versions.pointer()
        if meta is None:
            raise FileNotFoundError(f"no collection at {self.path}")
        if meta["dimensions"] != self.dimensions:
            raise ValueError(f"the collection has {meta['dimensions']} dimensions, not {self.dimensions}")
        return meta

    def ensure(self, columns: str) -> None:
        """Make an empty collection with these columns (DDL, project_id among them) unless there is one of this dimension."""
        if not self.exists():
            self.commit(self.spark.createDataFrame([], columns))
        self._meta()

    def read(self) -> DataFrame:
        self._meta()
        return self.versions.read().drop("bucket")

    def checked(self, points: DataFrame) -> DataFrame:
        return points.withColumn("vector", F.when(F.size("vector") == self.dimensions, F.col("vector")).otherwise(F.raise_error(F.lit("a vector has another dimension than the collection")).cast("array<float>")))

    def commit(self, points: DataFrame) -> None:
        """Put `points` in place of everything. Vectors of another dimension fail the write."""
        self.versions.write(self.versions.bucketed(self.checked(points)), None, dimensions=self.dimensions)

    def change(self, gone: DataFrame | None = None, new: DataFrame | None = None, new_keys: DataFrame | None = None, drop: list[str] | None = None) -> None:
        """Delete the ids of `gone` (project_id, point_id) and projects, put `new` in; only partitions that are touched are written.

        The points of `new` have ids of their own (see `one_per_point`).
        """
        if self.exists():
            self._meta()
        ensure_checkpoint_dir(self.spark)
        self.versions.change(gone, None if new is None else self.checked(new), new_keys, drop, dimensions=self.dimensions)


def open_store(kind: str, spark: SparkSession, path: str, dimensions: int, **more) -> Store:
    """A store by the name in the configuration."""
    if kind not in STORES:
        raise NotImplementedError(f"vector store {kind!r} is not implemented")
    return STORES[kind](spark, path, dimensions, **more)


STORES: dict[str, Callable[..., Store]] = {"parquet": Store}
