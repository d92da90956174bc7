"""Index jobs: scan, difference, chunk, embed, store, manifest. One project or all in the same plan."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.ids import MAX_TOKENS, MIN_TOKENS, override, point_id
from lodestrata.operators import chunks as c
from lodestrata.operators import manifest as m
from lodestrata.operators import reports
from lodestrata.operators.code_chunks import code_chunks
from lodestrata.operators.embed import Provider, embed
from lodestrata.operators.store import BUCKETS, Store, Versions
from lodestrata.session import ensure_checkpoint_dir

MANIFEST = "file_path string, file_hash string, mod_time timestamp, indexed_at timestamp, chunk_ids array<string>, chunk_hashes map<string,string>, project_id string"


def chunk_files(files: DataFrame, merge: bool = False, min_tokens: c.Limit = MIN_TOKENS, max_tokens: c.Limit = MAX_TOKENS, limits: DataFrame | None = None) -> DataFrame:
    """Each file by the chunker of its extension; the branches that Catalyst can express never leave the JVM.

    `limits` (project_id, min_tokens, max_tokens) sets limits of projects in place of the common ones; null and zero
    mean "not set".
    """
    by = files.withColumn("strategy", c.strategy())
    if limits is not None:
        own = limits.groupBy("project_id").agg(F.max("min_tokens").alias("min_tokens"), F.max("max_tokens").alias("max_tokens"))
        own = own.select(F.col("project_id").alias("__project"), *(override(n, d).alias(f"__{n}") for n, d in (("min_tokens", min_tokens), ("max_tokens", max_tokens))))
        by = by.join(own, F.col("project_id") == F.col("__project"), "left").drop("__project")
        min_tokens, max_tokens = (F.coalesce(F.col(f"__{n}"), F.lit(d)) for n, d in (("min_tokens", min_tokens), ("max_tokens", max_tokens)))
    out = c.fixed(by.where("strategy = 'fixed'"), max_tokens)
    marked = by.where("strategy = 'markdown'")
    out = out.unionByName(c.markdown_merged(marked, min_tokens) if merge else c.markdown_sections(marked))
    for kind in ("typescript", "php", "go"):
        out = out.unionByName(code_chunks(by.where(F.col("strategy") == kind), kind, merge, min_tokens, max_tokens))
    return out


def as_points(embedded: DataFrame) -> DataFrame:
    return embedded.withColumns({"point_id": point_id("chunk_id"), "indexed_at": F.current_timestamp()}).drop("token_count")


@dataclass(frozen=True)
class Run:
    """What a run found out; all lazy."""

    changed: DataFrame
    skipped: DataFrame
    deleted: DataFrame
    chunks: DataFrame
    new_chunks: DataFrame
    stale: DataFrame
    oversized: DataFrame

    def counters(self, scanned: DataFrame) -> DataFrame:
        return reports.run_counters(scanned, self.changed, self.skipped, self.deleted, self.new_chunks, self.stale, self.oversized)


def plan(files: DataFrame, manifest: DataFrame, merge: bool = False, limits: DataFrame | None = None) -> Run:
    """The difference of a scan against the manifest; only changed files are chunked, only new chunks come out to embed."""
    changed = m.changed_files(files, manifest)
    chunks = chunk_files(changed, merge, limits=limits)
    return Run(changed, m.skipped_files(files, manifest), m.deleted_files(files, manifest), chunks, m.changed_chunks(chunks, manifest), m.stale_chunks(chunks, manifest), reports.oversized_chunks(chunks))


class Manifest:
    """The manifest of a collection, in versions beside it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.versions = Versions(spark, path, "file_path", buckets)

    def read(self) -> DataFrame:
        if self.versions.pointer() is None:
            return self.versions.spark.createDataFrame([], MANIFEST)
        return self.versions.read().drop("bucket")


def index(files: DataFrame, manifest: Manifest, store: Store, provider: Provider, merge: bool = False, full: bool = False, limits: DataFrame | None = None, report: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Bring the store and then the manifest up to the scan of some projects; return their counters.

    Deletes and new points are one change of the store, and each new chunk is embedded once. The manifest is committed
    after the store, so that a failed write is tried again. With `full`, everything of the scanned projects is dropped
    and indexed anew. `report` gets the oversized chunks. Contents are read to be hashed and once more to be chunked, and never kept; they are
    exchanged only if the list of changed files is too large to broadcast.
    """
    ensure_checkpoint_dir(files.sparkSession)
    listing = files.select(*m.KEY, "file_hash").checkpoint()
    scanned = [r.project_id for r in listing.select("project_id").distinct().collect()]  # as many as there are projects
    known = manifest.read().where(F.col("project_id").isin(scanned))
    before = known.limit(0) if full else known
    changed = m.changed_files(listing, before)
    sources = files if full else m._join(files, changed, "left_semi", "file_hash")
    chunks = chunk_files(sources, merge, limits=limits).checkpoint()
    new_chunks = m.changed_chunks(chunks, before)
    stale, deleted = m.stale_chunks(chunks, before), m.deleted_files(listing, known)
    gone = stale.unionByName(m.purged_chunks(listing, before)).select("project_id", point_id("chunk_id").alias("point_id"))
    fresh = new_chunks.dropDuplicates(["chunk_id"])
    keys = fresh.select("project_id", point_id("chunk_id").alias("point_id"))
    made = as_points(embed(fresh, provider))
    store.change(gone, made, keys, drop=scanned if full else None)

    entries = m.upsert(chunks.withColumn("position", F.col("start_line")), changed)
    touched = changed.select(*m.KEY).unionByName(deleted)
    manifest.versions.change(touched, entries, drop=scanned if full else None)
    skipped = m.skipped_files(listing, before)
    if report is not None:
        report(reports.oversized_chunks(chunks))
    return reports.run_counters(listing, changed, skipped, deleted, new_chunks, stale.unionByName(m.purged_chunks(listing, before)), reports.oversized_chunks(chunks))


@dataclass
class Result:
    """What became of one project: its counters, or the errors that stopped it. Errors don't stop other projects."""

    project_id: str
    counters: dict[str, int] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)
    seconds: float = 0.0


def index_all(projects: list[str], scan, manifest: Manifest, store: Store, provider: Provider, **options) -> list[Result]:
    """Index projects one after the other; `scan(project_id)` gives the files of one."""
    out = []
    for project in projects:
        started = time.monotonic()
        result = Result(project)
        try:
            counters = index(scan(project), manifest, store, provider, **options)
            row = counters.where(F.col("project_id") == project).first()
            result.counters = {k: v for k, v in row.asDict().items() if k != "project_id"} if row else {}
        except Exception as e:  # noqa: BLE001 - whatever stops a project is its result
            result.errors.append(f"{type(e).__name__}: {e}".split("\n")[0])
        result.seconds = time.monotonic() - started
        out.append(result)
    return out
