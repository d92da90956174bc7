"""Retrieval as a library: requests, results, health, errors and rendering. A web front would be a thin layer over it."""

from __future__ import annotations

import json
import secrets
import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata import __version__
from lodestrata.operators.embed import Provider
from lodestrata.operators.search import Filter, top_k


class ServiceError(Exception):
    """An error with the code and the request id that a client sees."""

    status, code = 500, "INTERNAL_ERROR"

    def __init__(self, message: str):
        super().__init__(message)
        self.request_id = secrets.token_hex(8)

    def body(self) -> dict[str, str]:
        return {"error": str(self), "code": self.code, "request_id": self.request_id}


class InvalidRequest(ServiceError):
    status, code = 400, "INVALID_REQUEST"


class MissingField(ServiceError):
    status, code = 400, "MISSING_REQUIRED_FIELD"


class EmbeddingFailed(ServiceError):
    status, code = 500, "EMBEDDING_FAILED"


class SearchFailed(ServiceError):
    status, code = 500, "SEARCH_FAILED"


@dataclass(frozen=True)
class Request:
    project_id: str
    query: str
    top_k: int = 0
    filters: dict[str, str] = field(default_factory=dict)
    score_threshold: float | None = None  # an addition, off by default

    @staticmethod
    def from_json(text: str) -> Request:
        try:
            raw = json.loads(text)
            filters = raw.get("filters") or {}
            return Request(raw.get("project_id") or "", raw.get("query") or "", int(raw.get("top_k") or 0), {k: filters[k] for k in ("module", "language", "symbol_type") if filters.get(k)})
        except (ValueError, AttributeError, TypeError) as e:
            raise InvalidRequest("Invalid JSON body") from e


def clamp(k: int) -> int:
    return 5 if k <= 0 else min(k, 20)


def retrieve(points: DataFrame, request: Request, provider: Provider, run: bool = False, seconds: float = 30.0, unique: bool = False) -> DataFrame:
    """Results of one request, best first; an unknown project gives none.

    With `run` the search is executed here, within `seconds`, and what stops it is a SearchFailed; otherwise it is lazy.
    `unique` says that points have ids of their own, as those of a store.
    """
    if not request.project_id or not request.query:
        raise MissingField("project_id and query are required")
    try:
        vector = provider.embed_batch([request.query])[0]
    except Exception as e:
        raise EmbeddingFailed(f"Failed to embed query: {e}") from e
    found = project_results(top_k(points, vector, clamp(request.top_k), Filter(request.project_id, **request.filters), request.score_threshold, unique))
    if not run:
        return found
    spark = points.sparkSession
    tag = f"retrieve-{secrets.token_hex(8)}"
    timer = threading.Timer(seconds, spark.interruptTag, [tag])
    spark.addTag(tag)
    timer.start()
    try:
        rows = found.collect()  # at most 20
        return spark.createDataFrame(rows, found.schema)
    except Exception as e:
        raise SearchFailed(f"Search failed: {e}".split("\n")[0]) from e
    finally:
        timer.cancel()
        spark.removeTag(tag)


def project_results(found: DataFrame) -> DataFrame:
    """The columns a client gets; empty optional values and zero lines become null, which JSON leaves out."""
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    lines = [F.nullif(F.col(c), F.lit(0)).alias(c) for c in ("start_line", "end_line")]
    kept = [c for c in ("query_id", "rank") if c in found.columns]
    return found.select(*kept, "point_id", F.col("file_path").alias("source"), "content", blank("symbol"), blank("symbol_type"), "project_id", blank("module"), blank("language"), *lines, "score")


def response(results: DataFrame, milliseconds: int) -> str:
    """The JSON body of a response; `results` has at most 20 rows and is always a list."""
    rows = [json.loads(r[0]) for r in results.drop("point_id").select(F.to_json(F.struct("*"))).collect()]
    return json.dumps({"results": rows, "query_time_ms": milliseconds})


def markdown_row() -> F.Column:
    """A result as Markdown: heading with place, bold symbol with type and score in percent, fenced content. Missing values are shown as clients print them."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("undefined"))
    percent = F.concat(F.round(F.col("score").cast("double") * 100, 1).cast("decimal(10,1)").cast("string"), F.lit("%"))
    return F.concat(
        F.lit("### "), word("source"), F.lit(":"), word("start_line"), F.lit("-"), word("end_line"),
        F.lit("\n**"), word("symbol"), F.lit("** ("), word("symbol_type"), F.lit(") | Score: "), percent,
        F.lit("\n```"), word("language"), F.lit("\n"), word("content"), F.lit("\n```\n\n"),
    )


def render_markdown(results: DataFrame, query: str, milliseconds: int = 0, project_id: str | None = None) -> str:
    """The text a tool call answers with; `results` has at most 20 rows. Its head ends in a backslash and an n, as clients expect it."""
    rows = [r[0] for r in results.orderBy(F.desc("score"), "point_id").select(markdown_row()).collect()]
    if not rows:
        return f'No results found for query: "{query}"' + (f" in project {project_id}" if project_id else "")
    return f'## Search Results for: "{query}"\\nFound: {len(rows)} results ({milliseconds}ms)\\n\\n' + "".join(rows)


def render_error(error: ServiceError) -> str:
    return f"Error: {error} (code: {error.code})"


def health(points: DataFrame, provider: Provider) -> tuple[int, dict]:
    """(status, body): 200 if the provider and the store answer, otherwise 503."""
    parts = {}
    for name, test in (("embedder", provider.healthy), ("vectordb", lambda: points.limit(1).count() >= 0)):
        try:
            parts[name] = "healthy" if test() else "unhealthy"
        except Exception as e:
            parts[name] = f"unhealthy: {e}"
    good = all(v == "healthy" for v in parts.values())
    return (200 if good else 503), {"status": "healthy" if good else "degraded", "components": parts, "version": __version__}


def root() -> dict:
    return {"name": "lodestrata", "version": __version__, "endpoints": ["POST /retrieve", "GET /health", "GET /projects"]}


TOOL_SCHEMA = {
    "name": "search_codebase",
    "description": "Search a project's indexed code and documents by meaning.",
    "parameters": {
        "type": "object",
        "required": ["project_id", "query"],
        "properties": {
            "project_id": {"type": "string"},
            "query": {"type": "string"},
            "top_k": {"type": "integer", "minimum": 1, "maximum": 20, "default": 5},
            "filters": {"type": "object", "properties": {k: {"type": "string"} for k in ("module", "language", "symbol_type")}},
        },
    },
}
