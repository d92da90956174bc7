"""The catalogue of registered queries: name -> (spark, folder of tables) -> DataFrame. All run over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import ids
from lodestrata.functions.filters import excluded, included
from lodestrata.functions.paths import detect_language, extract_module, normal_path
from lodestrata.operators import chunks as c
from lodestrata.operators import manifest as m
from lodestrata.operators import reports, search, store
from lodestrata.operators.code_chunks import SCRIPT, code_chunks, declarations
from lodestrata.operators.embed import Hashing, batches, embed
from lodestrata.plans import golden, index, service
from lodestrata.plans.catalogue_sql import SQL
from lodestrata.session import ensure_checkpoint_dir, spread, table
from lodestrata.sources.files import describe
from lodestrata.streaming import trigger

Query = Callable[[SparkSession, str], DataFrame]
PROJECT = "orchid-core"
EARLY, CUTOFF = "2025-07-01 00:00:00", "2025-11-15 00:00:00"
QUERY_ID = 3
CHUNK_OUT = ["project_id", "file_path", "symbol", "symbol_type", "language", "module", "start_line", "end_line", "token_count", "content_hash", "chunk_id"]


# -- inputs
def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files."""
    rows = table(spark, d, "documents").where("text is not null and project_id is not null and file_path is not null")
    rows = rows.select("project_id", normal_path("file_path").alias("file_path"), "text")
    return rows.withColumns({"language": detect_language("file_path"), "module": extract_module("file_path")})


def whole_files(spark: SparkSession, d: str) -> DataFrame:
    """Whole-file payloads of points, one row a file, with the hash of their content."""
    rows = table(spark, d, "points").where("symbol_type = 'file' and content is not null and project_id is not null and file_path is not null")
    rows = rows.select("project_id", normal_path("file_path").alias("file_path"), "content")
    return rows.groupBy("project_id", "file_path").agg(F.max(ids.content_hash("content")).alias("file_hash"))


def code_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "points").where("symbol_type = 'file' and content is not null and project_id is not null and file_path is not null")
    rows = rows.dropDuplicates(["point_id"]).select("project_id", normal_path("file_path").alias("file_path"), F.col("content").alias("text"))
    return rows.withColumns({"language": detect_language("file_path"), "module": extract_module("file_path")})


def current_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "points").where("chunk_id is not null and content_hash is not null and project_id is not null and file_path is not null")
    rows = rows.select("project_id", normal_path("file_path").alias("file_path"), "chunk_id", "content_hash", F.coalesce("start_line", F.lit(0)).alias("line"))
    return rows.groupBy("project_id", "file_path", "chunk_id").agg(F.max("content_hash").alias("content_hash"), F.min("line").alias("position"))


def one_query(spark: SparkSession, d: str, query_id: int = QUERY_ID) -> list[float]:
    return list(table(spark, d, "search_query").where(F.col("query_id") == query_id).first()["vector"])


def manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest")


# -- scan
def scan_files(spark, d):
    return files(spark, d).select("project_id", "file_path", F.octet_length("text").alias("n_bytes"))


def filter_include_ext(spark, d):
    rules = table(spark, d, "project_config").select("project_id", "include_extensions")
    return files(spark, d).join(rules, "project_id").where(included(F.col("file_path"), F.col("include_extensions"))).select("project_id", "file_path")


def filter_exclude_path(spark, d):
    rules = table(spark, d, "project_config").select("project_id", "exclude_paths")
    rows = table(spark, d, "points").where("project_id is not null and file_path is not null").select("project_id", normal_path("file_path").alias("file_path")).distinct()
    return rows.join(rules, "project_id").where(excluded(F.col("file_path"), F.col("exclude_paths"))).select("project_id", "file_path")


def file_language(spark, d):
    return files(spark, d).select("project_id", "file_path", "language")


def file_module(spark, d):
    return files(spark, d).select("project_id", "file_path", "module")


def file_hash(spark, d):
    return files(spark, d).select("project_id", "file_path", ids.content_hash("text").alias("file_hash"))


# -- ids
def chunk_id(spark, d):
    rows = table(spark, d, "points").select("point_id", ids.chunk_id("project_id", normal_path("file_path"), "symbol", "content_hash").alias("made_id"))
    return rows.distinct()


def point_id(spark, d):
    return table(spark, d, "points").where("chunk_id is not null").select("chunk_id", ids.point_id("chunk_id").alias("made_id")).distinct()


def token_estimates(spark, d):
    rows = table(spark, d, "points").where("content is not null")
    return rows.select("point_id", ids.index_tokens("content").alias("index_tokens"), ids.report_tokens("content").alias("report_tokens")).distinct()


def effective_chunking(spark, d):
    return table(spark, d, "project_config").select("project_id", ids.override("min_tokens", ids.MIN_TOKENS).alias("min_tokens"), ids.override("ideal_tokens", ids.IDEAL_TOKENS).alias("ideal_tokens"), ids.override("max_tokens", ids.MAX_TOKENS).alias("max_tokens"))


def topk_clamp(spark, d):
    return table(spark, d, "search_query").select("query_id", ids.clamp_top_k("top_k").alias("k"))


# -- chunks
def chunk_whole_file(spark, d):
    return c.whole_files(files(spark, d)).select(*CHUNK_OUT)


def chunk_fixed(spark, d):
    return c.fixed(files(spark, d)).select(*CHUNK_OUT)


def chunk_dispatch(spark, d):
    return files(spark, d).select("project_id", "file_path", c.strategy().alias("strategy"))


def chunk_files(spark, d):
    return index.chunk_files(files(spark, d)).select(*CHUNK_OUT)


def _markdown(spark, d):
    return files(spark, d).where(c.strategy() == "markdown")


def chunk_markdown_sections(spark, d):
    return c.markdown_sections(_markdown(spark, d)).select(*CHUNK_OUT)


def chunk_markdown_merged(spark, d):
    return c.markdown_merged(_markdown(spark, d)).select(*CHUNK_OUT)


def _code(kind: str, merge: bool) -> Query:
    return lambda spark, d: code_chunks(code_files(spark, d).where(c.strategy() == kind), kind, merge).select(*CHUNK_OUT)


def _golden(kind: str) -> Query:
    def run(spark, d):
        sources = spark.createDataFrame([("golden", path, text) for path, text in golden.SETS[kind][0].items()], "project_id string, file_path string, text string")
        return code_chunks(describe(sources), kind).select(*golden.COLUMNS)

    return run


def chunk_integrity(spark, d):
    """How the chunks of all code files hold together: files, and chunks whose content isn't that of their lines or whose ids aren't made of it."""
    sources = code_files(spark, d).withColumn("strategy", c.strategy()).where(F.col("strategy").isin("typescript", "php", "go"))
    every = reduce(DataFrame.unionByName, (code_chunks(sources.where(F.col("strategy") == k), k).withColumn("strategy", F.lit(k)) for k in ("typescript", "php", "go")))
    first = sources.groupBy("strategy", "project_id", "file_path").agg(F.collect_set("text").alias("texts"))  # the few versions of one file
    lines = lambda t: F.array_join(F.slice(F.split(t, "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    both = every.join(first, ["strategy", "project_id", "file_path"])
    bad = lambda good: F.count(F.when(~good, 1))
    sums = both.groupBy("strategy").agg(
        F.countDistinct("project_id", "file_path").alias("files"),
        bad(F.exists("texts", lambda t: lines(t) == F.col("content"))).alias("wrong_content"),
        bad(F.col("content_hash") == ids.content_hash("content")).alias("wrong_hash"),
        bad(F.col("chunk_id").endswith(F.concat(F.lit(":"), F.substring("content_hash", 1, 8)))).alias("wrong_id"),
    )
    return sums


def symbol_dedupe_priority(spark, d):
    """The kind that a line's declaration counts as, of all that match it, as the chunker decides it."""
    rows = code_files(spark, d).where(c.strategy() == "typescript").select("project_id", "file_path", "text")

    def run(batches):
        for b in batches:
            found = [(p, f, *x) for p, f, t in zip(*(col.to_pylist() for col in b.columns)) for x in declarations(t, SCRIPT)]
            columns = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(col, pa.int32() if i == 2 else pa.string()) for i, col in enumerate(columns)], names=["project_id", "file_path", "line_no", "symbol_type", "symbol"])

    return spread(rows).mapInArrow(run, "project_id string, file_path string, line_no int, symbol_type string, symbol string")


# -- differences and manifest
def diff_changed_files(spark, d):
    """Against the manifest as it was at CUTOFF."""
    before = manifest(spark, d).where(F.col("indexed_at") < F.lit(CUTOFF).cast("timestamp"))
    return m.changed_files(whole_files(spark, d), before).select("project_id", "file_path", "file_hash")


def diff_skipped_files(spark, d):
    return m.skipped_files(whole_files(spark, d), manifest(spark, d)).select("project_id", "file_path", "file_hash")


def _scanned(spark, d):
    return table(spark, d, "points").where("project_id is not null and file_path is not null").select("project_id", normal_path("file_path").alias("file_path")).distinct()


def diff_deleted_files(spark, d):
    return m.deleted_files(_scanned(spark, d), manifest(spark, d))


def purge_deleted_chunks(spark, d):
    return m.purged_chunks(_scanned(spark, d), manifest(spark, d))


def diff_changed_chunks(spark, d):
    return m.changed_chunks(current_chunks(spark, d), manifest(spark, d)).select("project_id", "file_path", "chunk_id", "content_hash")


def diff_stale_chunks(spark, d):
    return m.stale_chunks(current_chunks(spark, d), manifest(spark, d))


def manifest_upsert(spark, d):
    new = m.upsert(current_chunks(spark, d), whole_files(spark, d), manifest(spark, d))
    rows = new.select("project_id", "file_path", "file_hash", "chunk_hashes", F.posexplode_outer("chunk_ids").alias("position", "chunk_id"))
    return rows.select("project_id", "file_path", "file_hash", "position", "chunk_id", F.try_element_at("chunk_hashes", F.col("chunk_id")).alias("chunk_hash"))


def manifest_explode(spark, d):
    return m.chunk_entries(manifest(spark, d))


def manifest_stats(spark, d):
    return m.stats(manifest(spark, d))


def manifest_roundtrip(spark, d):
    """Through JSON and back, as manifests are exchanged."""
    own = manifest(spark, d)
    text = own.select(F.to_json(F.struct(*own.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("j"))
    back = text.select(F.from_json("j", own.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("r")).select("r.*")
    return m.chunk_entries(back)


# -- index jobs: two states of the documents, as files that were there before CUTOFF and since EARLY
def _state(spark, d, since: str | None = None, before: str | None = None) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null and project_id is not null and file_path is not null")
    at = F.col("indexed_at")
    if before:
        rows = rows.where(at < F.lit(before).cast("timestamp"))
    if since:
        rows = rows.where(F.coalesce(at >= F.lit(since).cast("timestamp"), F.lit(True)))
    return trigger.newest_per_file(rows.select("project_id", normal_path("file_path").alias("file_path"), "text"))


def _job(spark, d, full: bool) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    store_, manifest_ = store.Store(spark, f"{folder}/store", 48), index.Manifest(spark, f"{folder}/manifest")
    limits = table(spark, d, "project_config").select("project_id", "min_tokens", "max_tokens")
    index.index(_state(spark, d, before=CUTOFF), manifest_, store_, Hashing(), limits=limits)
    counters = index.index(_state(spark, d, since=EARLY), manifest_, store_, Hashing(), full=full, limits=limits)
    # every chunk of the manifest is in the store and no other
    told = m.chunk_entries(manifest_.read()).select(ids.point_id("chunk_id").alias("point_id"), F.lit(1).alias("told"))
    both = told.distinct().join(store_.read().select("point_id", F.lit(1).alias("kept")), "point_id", "full")
    apart = both.agg(F.count(F.when(F.col("told").isNull() | F.col("kept").isNull(), 1)).alias("apart"))
    return counters.select("project_id", "files_scanned", "files_indexed", "files_skipped", "files_deleted").crossJoin(F.broadcast(apart))  # one row


def index_incremental(spark, d):
    return _job(spark, d, False)


def index_full(spark, d):
    return _job(spark, d, True)


# -- store
STORE_OUT = ["point_id", "start_line", "content_hash"]


def _existing(spark, d):
    return search.one_per_point(table(spark, d, "points").where(F.col("indexed_at") < F.lit(CUTOFF).cast("timestamp")))


def vector_upsert(spark, d):
    new = table(spark, d, "points").where(~(F.coalesce(F.col("indexed_at") < F.lit(CUTOFF).cast("timestamp"), F.lit(False))))
    return store.upsert(_existing(spark, d), new).select(*STORE_OUT)


def vector_delete_ids(spark, d):
    gone = table(spark, d, "points").where("symbol_type = 'heading'").select("point_id")
    return store.delete_ids(_existing(spark, d), gone).select(*STORE_OUT)


def vector_delete_project(spark, d):
    return store.delete_by_filter(_existing(spark, d), search.Filter(PROJECT)).select(*STORE_OUT)


def full_reindex(spark, d):
    """One project dropped and put in anew from its whole files."""
    kept = store.delete_by_filter(_existing(spark, d), search.Filter(PROJECT))
    anew = search.one_per_point(table(spark, d, "points").where((F.col("project_id") == PROJECT) & (F.col("symbol_type") == "file")))
    return store.upsert(kept, anew).select(*STORE_OUT)


# -- search
def _rounded(df: DataFrame) -> DataFrame:
    return df.select("point_id", "project_id", "symbol", F.round("score", 6).alias("score"))


def vector_topk(spark, d):
    return _rounded(search.top_k(table(spark, d, "points"), one_query(spark, d), 10))


def vector_topk_filtered(spark, d):
    return _rounded(search.top_k(table(spark, d, "points"), one_query(spark, d), 10, search.Filter(PROJECT, symbol_type="function")))


def vector_topk_threshold(spark, d):
    return _rounded(search.top_k(table(spark, d, "points"), one_query(spark, d), 20, search.Filter(PROJECT), 0.3))


def vector_topk_batch(spark, d):
    found = search.batch_top_k(table(spark, d, "points"), table(spark, d, "search_query"))
    return found.select("query_id", "rank", "point_id", F.round("score", 6).alias("score"))


# -- embedding
def _distinct_chunks(spark, d):
    return table(spark, d, "points").where("chunk_id is not null and project_id is not null").select("chunk_id", "project_id").dropDuplicates(["chunk_id"])


def embed_batches(spark, d):
    rows = table(spark, d, "points").where("chunk_id is not null and project_id is not null").groupBy("chunk_id").agg(F.max("project_id").alias("project_id"))
    return batches(rows)


def embed_vectors(spark, d):
    return embed(c.fixed(files(spark, d)), Hashing()).select("chunk_id", "content_hash", "vector")


# -- reports
def _unique_points(spark, d):
    return search.one_per_point(table(spark, d, "points").where("content is not null").select("point_id", "project_id", "file_path", "symbol", "content", "indexed_at", "start_line"))


def oversized_chunks(spark, d):
    return reports.oversized_chunks(_unique_points(spark, d))


def oversized_report(spark, d):
    return reports.oversized_report(oversized_chunks(spark, d))


def index_project_summary(spark, d):
    over = oversized_chunks(spark, d).where("project_id is not null").groupBy("project_id").agg(F.count("*").alias("oversized"))
    # what is deleted is judged by all files that points know, what is indexed or skipped by whole files
    gone = m.deleted_files(_scanned(spark, d), manifest(spark, d)).groupBy("project_id").agg(F.count("*").alias("files_deleted"))
    seen = m.file_states(whole_files(spark, d), manifest(spark, d)).drop("files_deleted").where("files_scanned > 0")
    return reports.summary([seen, gone, m.chunk_states(current_chunks(spark, d), manifest(spark, d)), over]).where(" + ".join(("files_scanned", "files_deleted", "chunks_created", "chunks_deleted", "oversized")) + " > 0")


def index_all_summary(spark, d):
    return reports.totals(index_project_summary(spark, d))


def progress_stats(spark, d):
    return reports.progress(files(spark, d).select((F.octet_length("text") / 1000).alias("seconds")), 100)


def list_projects(spark, d):
    return reports.list_projects(table(spark, d, "points"))


# -- service
def _with_payload(spark, d):
    points = table(spark, d, "points")
    return service.project_results(search.with_payload(search.batch_top_k(points, table(spark, d, "search_query")), points))


def retrieve_projection(spark, d):
    return _with_payload(spark, d).withColumn("score", F.round("score", 6))


def render_results_markdown(spark, d):
    rows = _with_payload(spark, d).withColumn("score", F.round("score", 6))
    return rows.select("query_id", "rank", service.markdown_row().alias("markdown"))


def retrieve_end_to_end(spark, d):
    """Documents cut, embedded locally and searched for one question within the largest project."""
    embedded = index.as_points(embed(index.chunk_files(files(spark, d)), Hashing()))
    return service.retrieve(embedded, service.Request(PROJECT, "Which service compares the webhook with the ledger and reports rows?"), Hashing())


QUERIES = [
    scan_files, filter_include_ext, filter_exclude_path, file_hash, chunk_id, point_id, token_estimates, effective_chunking, topk_clamp,
    chunk_whole_file, chunk_fixed, chunk_dispatch, chunk_files, chunk_markdown_sections, chunk_markdown_merged, symbol_dedupe_priority, chunk_integrity,
    diff_changed_files, diff_skipped_files, diff_deleted_files, purge_deleted_chunks, diff_changed_chunks, diff_stale_chunks,
    manifest_upsert, manifest_explode, manifest_stats, manifest_roundtrip, vector_upsert, vector_delete_ids, vector_delete_project, full_reindex, index_incremental, index_full,
    vector_topk, vector_topk_filtered, vector_topk_threshold, vector_topk_batch, embed_batches, embed_vectors,
    oversized_chunks, oversized_report, index_project_summary, index_all_summary, progress_stats, list_projects,
    retrieve_projection, render_results_markdown, retrieve_end_to_end,
]


def queries() -> dict[str, Query]:
    named = {f.__name__: f for f in QUERIES}
    named |= {"detect_language": file_language, "extract_module": file_module}
    for kind, name in (("typescript", "chunk_typescript"), ("php", "chunk_php"), ("go", "chunk_go")):
        named[name] = _code(kind, False)
        named[f"chunk_golden_{kind}"] = _golden(kind)
        named["chunk_ts_merged" if kind == "typescript" else f"{name}_merged"] = _code(kind, True)
    return named


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
