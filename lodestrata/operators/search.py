"""Exact cosine search with conjunctive filters: one query as a top-k plan, many queries as products of matrices.

A vector that is null, of another length than the query, zero or not finite never answers. Scores are computed in
DOUBLE; ties are ordered by point_id. Empty or null filter values set no condition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.ids import clamp_top_k
from lodestrata.session import spread

MAX_QUERIES = 10_000  # queries of one batch are broadcast; larger sets are split by the caller
PAYLOAD = ["project_id", "file_path", "symbol", "symbol_type", "language", "module", "start_line", "end_line", "content"]


@dataclass(frozen=True)
class Filter:
    project_id: str | None = None
    module: str | None = None
    language: str | None = None
    symbol_type: str | None = None

    def column(self) -> Column:
        out = F.lit(True)
        for f in fields(self):
            if value := getattr(self, f.name):
                out = out & (F.col(f.name) == value)
        return out

    def empty(self) -> bool:
        return not any(getattr(self, f.name) for f in fields(self))


def squared(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def one_per_point(points: DataFrame) -> DataFrame:
    """Rows that repeat a point_id are one point: the latest counts, of equal times the one with the smallest start."""
    order = F.struct("indexed_at", (-F.coalesce("start_line", F.lit(0))).alias("s"), F.coalesce("file_path", F.lit("")).alias("p"))
    rest = [c for c in points.columns if c != "point_id"]
    return points.groupBy("point_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("point_id", "r.*")


def with_norm(points: DataFrame, dimensions: int) -> DataFrame:
    """Points that can answer, with the norm of their vector."""
    rows = points.where(F.size("vector") == dimensions).withColumn("norm", F.sqrt(squared(F.col("vector"))))
    return rows.where("norm > 0 and norm < double('infinity')")


def top_k(points: DataFrame, vector: list[float], k: int, where: Filter = Filter(), score_threshold: float | None = None, unique: bool = False) -> DataFrame:
    """point_id, score DOUBLE, payload of the k most similar points, best first.

    Two phases: ids and scores first, payload only for the winners, so contents are not read for the rest. A threshold
    of zero or null sets no limit. With `unique` ids are known to be unique, as in a store, and nothing is exchanged but
    the best of each task.
    """
    norm = sum(x * x for x in vector) ** 0.5
    if not vector or not 0 < norm < float("inf"):
        return points.select("point_id", F.lit(0.0).alias("score"), *PAYLOAD).limit(0)
    q = F.array(*(F.lit(float(x) / norm) for x in vector))
    rows = with_norm(points.where(where.column()).select("point_id", "vector"), len(vector))
    scored = rows.select("point_id", (dot(F.col("vector"), q) / F.col("norm")).alias("score"))
    if score_threshold:
        scored = scored.where(F.col("score") >= score_threshold)
    best = (scored if unique else scored.dropDuplicates(["point_id"])).orderBy(F.desc("score"), "point_id").limit(k)
    payload = points.where(where.column()).select("point_id", *PAYLOAD, "indexed_at")
    winners = payload.join(F.broadcast(best), "point_id")  # k rows at most
    return one_per_point(winners).select("point_id", "score", *PAYLOAD).orderBy(F.desc("score"), "point_id")


class Queries:
    """A stated set of queries and their filters, as matrices; at most MAX_QUERIES rows."""

    def __init__(self, rows: list, dimensions: int):
        good = [r for r in rows if r.q is not None and len(r.q) == dimensions]
        self.vectors = np.array([r.q for r in good], np.float64).reshape(-1, dimensions)
        norms = np.sqrt(ordered_dot(self.vectors, self.vectors))
        usable = np.flatnonzero((norms > 0) & (norms < np.inf))
        self.vectors, self.norms, self.rows = self.vectors[usable], norms[usable], [good[i] for i in usable]
        self.by_project: dict[str | None, list[int]] = {}
        for i, r in enumerate(self.rows):
            self.by_project.setdefault(r.project_id or None, []).append(i)

    def best(self, ids: np.ndarray, x: np.ndarray, labels: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, rows, scores) of the best of a batch: products of blocks choose, sums in a fixed order score."""
        norm = np.sqrt(ordered_dot(x, x))
        usable = np.flatnonzero((norm > 0) & (norm < np.inf))
        of = labels["project_id"]
        for project, members in self.by_project.items():
            mine = usable if project is None else usable[of[usable] == project]
            if not len(mine):
                continue
            rough = (x[mine] @ self.vectors[members].T) / (norm[mine, None] * self.norms[members])
            for column, q in enumerate(members):
                row = self.rows[q]
                fits = np.ones(len(mine), bool)
                for name in ("module", "language", "symbol_type"):
                    if getattr(row, name):
                        fits &= labels[name][mine] == getattr(row, name)
                scores = np.where(fits, rough[:, column], -np.inf)
                at = np.flatnonzero(fits)
                if len(at) > row.k:
                    least = np.partition(scores[at], len(at) - row.k)[len(at) - row.k]
                    distinct = len(set(ids[mine[at[scores[at] >= least]]]))
                    if distinct < row.k:  # rows repeat an id: count ids, not rows
                        order = at[np.argsort(-scores[at], kind="stable")]
                        _, first = np.unique(ids[mine[order]], return_index=True)
                        least = scores[order[np.sort(first)[min(row.k, len(first)) - 1]]]
                    at = at[scores[at] >= least - 1e-9]
                if len(at):
                    chosen = mine[at]
                    exact = ordered_dot(x[chosen], self.vectors[q][None, :]) / (norm[chosen] * self.norms[q])
                    keep = np.ones(len(chosen), bool) if not row.threshold or np.isnan(row.threshold) else exact >= row.threshold
                    yield q, chosen[keep], exact[keep]


def ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed in the order of dimensions, so that equal vectors have equal scores in any batch."""
    out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[0])
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def batch_top_k(points: DataFrame, queries: DataFrame, dimensions: int = 48) -> DataFrame:
    """query_id, rank INT, point_id, score DOUBLE for each query, within its own filters, threshold and clamped top_k.

    The queries are a stated set of at most MAX_QUERIES rows, sent to all tasks. A batch of points meets only the queries
    of its projects and those of none, as products of matrices, and keeps the best of each; no vector is exchanged, only
    top_k rows for each query and batch.
    """
    q = queries.select("query_id", F.col("vector").alias("q"), clamp_top_k("top_k").alias("k"), F.col("score_threshold").cast("double").alias("threshold"), "project_id", "module", "language", "symbol_type")
    rows = q.limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"at most {MAX_QUERIES} queries at a time")
    asked = Queries(rows, dimensions)
    kind = dict(queries.dtypes)["query_id"]
    names = ["project_id", "module", "language", "symbol_type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            ids = np.array(b.column(0).to_pylist(), object)
            labels = {n: np.array(b.column(i + 2).to_pylist(), object) for i, n in enumerate(names)}
            found = list(asked.best(ids, x, labels)) if len(ids) else []
            numbers = [asked.rows[q].query_id for q, at, _ in found for _ in at]
            places = np.concatenate([at for _, at, _ in found]) if found else np.zeros(0, int)
            scores = np.concatenate([s for _, _, s in found]) if found else np.zeros(0)
            limits = [asked.rows[q].k for q, at, _ in found for _ in at]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32() if kind == "int" else pa.int64()), pa.array(limits, pa.int32()), pa.array(ids[places].tolist(), pa.string()), pa.array(scores)], names=["query_id", "k", "point_id", "score"])

    p = points.where((F.size("vector") == dimensions) & F.col("point_id").isNotNull() & ~F.exists("vector", lambda v: v.isNull())).select("point_id", "vector", *names)
    best = spread(p).mapInArrow(run, f"query_id {kind}, k int, point_id string, score double").dropDuplicates(["query_id", "point_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= 20).where(F.col("rank") <= F.col("k")).select("query_id", "rank", "point_id", "score")


def with_payload(found: DataFrame, points: DataFrame) -> DataFrame:
    """`found` (query_id, rank, point_id, score) with the payload of its points, of rows that repeat an id the latest.

    Contents are read only for the winners, which are at most 20 for each of at most MAX_QUERIES queries.
    """
    rows = points.select("point_id", *PAYLOAD, "indexed_at").join(F.broadcast(found), "point_id")
    order = F.struct("indexed_at", (-F.coalesce("start_line", F.lit(0))).alias("s"), F.coalesce("file_path", F.lit("")).alias("p"))
    kept = rows.groupBy("query_id", "rank", "point_id", "score").agg(F.max_by(F.struct(*PAYLOAD), order).alias("r"))
    return kept.select("query_id", "rank", "point_id", "score", "r.*")
