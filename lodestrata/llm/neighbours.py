"""Problem 2: the k most similar vectors of every vector within its project.

A hierarchical k-means tree is searched best bin first: a priority queue of nodes, ordered by the similarity of their
centres, yields leaves until enough have been visited for a calibrated recall.

The top of the tree is fitted on the driver over a bounded sample, and only for projects above `CELL` distinct
vectors; it cuts them into cells. A smaller project is one cell. Every row is indexed: one exchange brings the
vectors of a cell together (queries that look into several cells are sent to each), and the task of a cell grows the
rest of the tree over its own vectors. Traversal is shared by the queries of one leaf, so scoring is a matrix product.
How many leaves to visit is found in each cell by the walk that is run: a sample of its queries is answered by brute
force, and visits are widened until what their blocks look at holds the target share of the true neighbours. Which cells
a query is sent to is found over the driver's sample: those whose centre is at most a margin less similar than that of
its home, with the smallest margin that keeps the target share; so only queries near a boundary leave their cell.

Vectors that occur more than once are searched once. Copies of one vector are each other's most similar points; ties
are ordered by point_id. A group of copies is never expanded into its pairs: a point looks at most at k of its copies.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 48
CELL = 32_768  # distinct vectors that one task indexes
LEAF = 96
BRANCH = 8
SAMPLE_PER_CELL = 64  # vectors of the driver's sample per cell; the sample has at most this times MAX_CELLS
MAX_CELLS = 4096
RECALL = 0.97
CALIBRATION = 192  # queries of a cell that are answered by brute force too


def usable(points: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """point_id, project_id, vector, h1, h2 of rows that can be searched: `dimensions` finite values, not all zero."""
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = points.select("point_id", "project_id", "vector").where((F.size("vector") == dimensions) & F.col("project_id").isNotNull() & F.col("point_id").isNotNull())
    rows = rows.withColumn("square", square).where("square > 0 and square < double('infinity')").drop("square")
    return rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.hash("vector"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """One row for each vector of a project: its first and last point_id, which differ if it has copies."""
    return rows.groupBy("project_id", "h1", "h2").agg(F.min("point_id").alias("a"), F.max("point_id").alias("z"), F.first("vector").alias("vector"))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Labels of a spherical k-means; fitted on at most 64 rows a centre, then all rows are assigned."""
    fit = x[rng.choice(len(x), 64 * k, replace=False)] if len(x) > 64 * k else x
    centres = fit[rng.choice(len(fit), k, replace=False)].copy()
    for _ in range(rounds):
        label = (fit @ centres.T).argmax(axis=1)
        for c in range(k):
            own = fit[label == c]
            if len(own):
                m = own.sum(axis=0)
                centres[c] = m / (np.linalg.norm(m) or 1.0)
    return (x @ centres.T).argmax(axis=1)


class Tree:
    """A hierarchical k-means tree over the rows of x. Node i has a centre and either children or the rows of a leaf."""

    def __init__(self, x: np.ndarray, leaf: int, seed: int = 7, branch: int = BRANCH):
        rng = np.random.default_rng(seed)
        self.centre: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray | None] = []
        todo = [(np.arange(len(x)), -1)]
        while todo:
            rows, parent = todo.pop()
            me = len(self.centre)
            m = x[rows].mean(axis=0)
            self.centre.append(m / (np.linalg.norm(m) or 1.0))
            self.children.append([])
            self.rows.append(None)
            if parent >= 0:
                self.children[parent].append(me)
            parts = []
            if len(rows) > leaf:
                label = kmeans(x[rows], min(branch, -(-len(rows) // leaf)), rng)
                parts = [rows[label == c] for c in np.unique(label)]
                if len(parts) == 1:  # can't be told apart: halve in order
                    half = len(rows) // 2
                    parts = [rows[:half], rows[half:]]
            if parts:
                todo += [(p, me) for p in parts]
            else:
                self.rows[me] = rows
        self.centres = np.array(self.centre)
        self.leaves = [i for i, r in enumerate(self.rows) if r is not None]

    def best_first(self, scores: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a priority queue; `scores` has the similarity of each node's centre to the query."""
        queue = [(-scores[0], 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.rows[node] is not None:
                yield node
            for c in self.children[node]:
                heapq.heappush(queue, (-scores[c], c))

    def first_leaves(self, scores: np.ndarray, n: int) -> list[int]:
        out = []
        for leaf in self.best_first(scores):
            out.append(leaf)
            if len(out) == n:
                break
        return out


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, unordered."""
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:] if scores.shape[1] > k else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)


def search_cell(points: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, recall: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, leaves visited) of the k points most similar to each query; `own` is a query's own row or -1.

    Rows are -1 where there are fewer points than k.
    """
    n = len(points)
    tree = Tree(points, LEAF, seed)
    small = points.astype(np.float32)
    near = queries.astype(np.float32)
    want = min(k + 1, n)

    node_scores = near @ tree.centres.T.astype(np.float32)
    blocks = query_blocks(tree, node_scores)
    rng = np.random.default_rng(seed)
    probe = np.sort(rng.choice(len(queries), min(CALIBRATION, len(queries)), replace=False))
    visits = len(tree.leaves)
    if visits > 8:
        truth = top(near[probe] @ small.T, want)
        place = np.empty(n, np.int64)
        for leaf in tree.leaves:
            place[tree.rows[leaf]] = leaf
        asked = np.isin(np.arange(len(queries)), probe)
        sample = [(block, place[truth[np.searchsorted(probe, block[asked[block]])]]) for block in blocks if asked[block].any()]
        visits = 4
        while visits < len(tree.leaves) and np.concatenate([np.isin(at, visited(tree, node_scores, block, visits)).ravel() for block, at in sample]).mean() < recall:
            visits = -(-visits * 5 // 4)
        visits = min(visits, len(tree.leaves))

    rows = np.full((len(queries), k), -1, np.int64)
    found = np.full((len(queries), k), -np.inf)
    if visits >= len(tree.leaves):
        groups = [(np.arange(lo, min(lo + 256, len(queries))), np.arange(n)) for lo in range(0, len(queries), 256)]
    else:
        groups = ((block, np.concatenate([tree.rows[x] for x in visited(tree, node_scores, block, visits)])) for block in blocks)
    for block, candidates in groups:
        for lo in range(0, len(block), 256):
            q = block[lo : lo + 256]
            scores = near[q] @ small[candidates].T
            best = candidates[top(scores, want)]
            exact = np.einsum("qd,qkd->qk", queries[q], points[best])  # float32 only chose the candidates
            exact[best == own[q][:, None]] = -np.inf
            order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
            m = order.shape[1]
            rows[q, :m] = np.take_along_axis(best, order, 1)
            found[q, :m] = np.take_along_axis(exact, order, 1)
    rows[~np.isfinite(found)] = -1
    return rows, found, visits


def query_blocks(tree: Tree, node_scores: np.ndarray) -> list[np.ndarray]:
    """Queries by the leaf that is most similar to them; those of a block are answered by one product."""
    leaf_ids = np.array(tree.leaves)
    first = leaf_ids[node_scores[:, leaf_ids].argmax(axis=1)]
    order = np.argsort(first, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(first[order])) + 1)


def visited(tree: Tree, node_scores: np.ndarray, block: np.ndarray, visits: int) -> list[int]:
    """The leaves a block visits: the first ones best first from its mean, and the very first ones of some of its queries."""
    leaves = tree.first_leaves(node_scores[block].mean(axis=0), visits)
    own = {x for q in block[:: max(1, len(block) // 4)][:4] for x in tree.first_leaves(node_scores[q], max(2, visits // 4))}
    return list(dict.fromkeys([*leaves, *own]))


class Cells:
    """The top of the tree for the projects that are cut: centres of cells, and by what margin a query looks beyond its own."""

    def __init__(self, samples: dict[str, np.ndarray], sizes: dict[str, int], cell: int, k: int, recall: float):
        self.centres: dict[str, np.ndarray] = {}
        self.margin: dict[str, float] = {}
        for project, x in samples.items():
            cells = max(2, -(-sizes[project] // cell))
            tree = Tree(x, max(1, len(x) // cells), branch=2)
            at = np.array([tree.centres[i] for i in tree.leaves])
            self.centres[project] = at
            near = x @ at.T
            home = near.argmax(axis=1)
            probe = np.random.default_rng(3).choice(len(x), min(512, len(x)), replace=False)
            needed = []
            for q in np.array_split(probe, max(1, len(probe) // 16)):  # products of 16 rows: 32 MB for the largest sample
                scores = x[q] @ x.T
                scores[np.arange(len(q)), q] = -2
                truth = top(scores, min(k, len(x) - 1))
                needed.append((near[q].max(axis=1)[:, None] - np.take_along_axis(near[q], home[truth], 1)).ravel())
            # neighbours in the sample lie farther than in the whole, so this margin is on the safe side
            self.margin[project] = float(np.quantile(np.concatenate(needed), recall))

    def place(self, project: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home cell of each row, rows and cells of the further visits)."""
        near = x @ self.centres[project].T
        home = near.argmax(axis=1)
        within = near >= near.max(axis=1, keepdims=True) - self.margin[project]
        within[np.arange(len(x)), home] = False
        return home, *np.nonzero(within)


def knn(points: DataFrame, k: int = 10, min_score: float | None = None, recall: float = RECALL, cell: int = CELL, dimensions: int = DIMENSIONS) -> DataFrame:
    """(point_id, neighbour_id, rank INT, score DOUBLE): the k most similar other points of the project of each point.

    Rows that repeat a point_id are one point. Points without a project, and vectors that are null, of another
    length, zero or not finite, neither ask nor answer. Equal scores are ranked by point_id. With `min_score` only
    neighbours of at least that similarity are returned, with their rank among all. A project of one point gives no
    row; an empty table an empty result. Columns beside point_id, project_id and vector are ignored.
    """
    spark = points.sparkSession
    rows = usable(points, dimensions)
    groups = distinct_vectors(rows)
    large = {r.project_id: r.n for r in rows.groupBy("project_id").agg(F.count("*").alias("n")).where(F.col("n") > cell).collect()}
    cells = None
    if large:
        n_cells = sum(-(-n // cell) for n in large.values())
        share = min(1.0, MAX_CELLS / n_cells)
        rate = {p: min(1.0, SAMPLE_PER_CELL * share * -(-n // cell) / n) for p, n in large.items()}
        chosen = F.coalesce(*[F.when(F.col("project_id") == p, F.lit(r)) for p, r in rate.items()])
        picked = rows.where(F.col("project_id").isin(list(large))).where(F.pmod("h1", F.lit(1 << 30)) / F.lit(float(1 << 30)) < chosen).select("project_id", "vector")
        table = picked.toArrow()  # at most SAMPLE_PER_CELL * MAX_CELLS vectors
        by = np.array(table.column(0).to_pylist())
        x = unit(table.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)) if len(table) else np.zeros((0, dimensions))
        samples = {p: np.unique(x[by == p], axis=0) for p in large if (by == p).sum() > 1}
        cells = Cells(samples, large, max(cell, int(cell / share)), k, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Send each vector to its home cell, and as a query to the further cells it visits."""
        for b in batches:
            projects = np.array(b.column(0).to_pylist(), dtype=object)
            cell_of, home, take = [np.zeros(len(projects), np.int32)], [np.ones(len(projects), bool)], [np.arange(len(projects))]
            if cells is not None and len(projects):
                x = unit(b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
                for p in set(projects) & set(cells.centres):
                    at = np.flatnonzero(projects == p)
                    cell_of[0][at], rows_, further = cells.place(p, x[at])
                    cell_of.append(further.astype(np.int32))
                    home.append(np.zeros(len(further), bool))
                    take.append(at[rows_])
            index = pa.array(np.concatenate(take))
            yield pa.RecordBatch.from_arrays([b.column(0).take(index), pa.array(np.concatenate(cell_of)), pa.array(np.concatenate(home)), b.column(1).take(index), b.column(2).take(index), b.column(3).take(index)], names=["project_id", "cell", "home", "a", "multi", "vector"])

    def find(group: pa.Table) -> pa.Table:
        group = group.sort_by("a").combine_chunks()
        x = unit(group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
        home = np.asarray(group.column("home").to_numpy(zero_copy_only=False), bool)
        at = np.flatnonzero(home)
        own = np.full(len(x), -1, np.int64)
        own[at] = np.arange(len(at))
        if not len(at):
            return out.empty_table()
        near, score, _ = search_cell(x[at], x, own, k, recall)
        keep = near >= 0
        if min_score is not None:
            keep &= score >= min_score
        q, r = np.nonzero(keep)
        names, multi = group.column("a"), group.column("multi")
        to = at[near[q, r]]
        return pa.table([names.take(pa.array(q)), names.take(pa.array(to)), pa.array(score[q, r]), multi.take(pa.array(q)), multi.take(pa.array(to))], schema=out)

    out = pa.schema([("a", pa.string()), ("b", pa.string()), ("score", pa.float64()), ("a_multi", pa.bool_()), ("b_multi", pa.bool_())])
    ddl = "a string, b string, score double, a_multi boolean, b_multi boolean"
    placed = groups.select("project_id", "a", (F.col("a") < F.col("z")).alias("multi"), "vector").mapInArrow(place, f"project_id string, cell int, home boolean, a string, multi boolean, vector array<float>")
    edges = placed.groupBy("project_id", "cell").applyInArrow(find, ddl)
    if cells is not None:
        best = Window.partitionBy("a").orderBy(F.desc("score"), "b")
        edges = edges.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")

    # copies: the first k + 1 points of each repeated vector stand for it
    copied = rows.join(groups.where("a < z").select("project_id", "h1", "h2", "a"), ["project_id", "h1", "h2"]).select("a", "point_id").distinct()
    in_order = Window.partitionBy("a").orderBy("point_id")
    heads = copied.withColumn("nth", F.row_number().over(in_order)).where(F.col("nth") <= k + 1)
    same = copied.join(heads.withColumnRenamed("point_id", "neighbour_id"), "a").where("point_id <> neighbour_id").select("point_id", "neighbour_id", F.lit(1.0).alias("score"))
    plain = edges.where("not a_multi and not b_multi").select(F.col("a").alias("point_id"), F.col("b").alias("neighbour_id"), "score")
    mixed = edges.where("a_multi or b_multi").join(copied.withColumnRenamed("point_id", "p"), "a", "left").join(heads.select(F.col("a").alias("b"), F.col("point_id").alias("q")), "b", "left")
    mixed = mixed.select(F.coalesce("p", "a").alias("point_id"), F.coalesce("q", "b").alias("neighbour_id"), "score")
    every = plain.unionByName(mixed).unionByName(same)
    rank = Window.partitionBy("point_id").orderBy(F.desc("score"), "neighbour_id")
    return every.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("point_id", "neighbour_id", "rank", "score")


def similar_pairs(points: DataFrame, k: int = 10, min_score: float = 0.97, **more) -> DataFrame:
    """(point_id_a, point_id_b), a < b: pairs of at least `min_score`, one among the k most similar points of the other."""
    near = knn(points, k, min_score, **more)
    return near.select(F.least("point_id", "neighbour_id").alias("point_id_a"), F.greatest("point_id", "neighbour_id").alias("point_id_b")).distinct()


def measured_recall(points: DataFrame, k: int = 10, queries: int = 256, dimensions: int = DIMENSIONS, **more) -> DataFrame:
    """One row: queries BIGINT, k INT, recall DOUBLE of `knn` against brute force.

    The queries are a bounded number of points, chosen by a hash of their id; each is compared with all usable points
    of its project. A neighbour counts as found if its score is not below the true k-th.
    """
    rows = usable(points, dimensions)
    chosen = rows.select("point_id", "project_id", "vector").dropDuplicates(["point_id"]).orderBy(F.xxhash64("point_id"), "point_id").limit(queries).toArrow()
    ids, of = chosen.column(0).to_pylist(), np.array(chosen.column(1).to_pylist(), dtype=object)
    q = unit(chosen.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)) if ids else np.zeros((0, dimensions))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not ids:
                continue
            x = unit(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
            names = np.array(b.column(0).to_pylist(), dtype=object)
            scores = q @ x.T
            scores[of[:, None] != np.array(b.column(1).to_pylist(), dtype=object)[None, :]] = -2
            at = top(scores, min(k + 2, scores.shape[1]))
            r = np.repeat(np.arange(len(ids)), at.shape[1])
            keep = scores[r, at.ravel()] > -2
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in r[keep]]), pa.array(names[at.ravel()[keep]].tolist()), pa.array(scores[r, at.ravel()][keep])], names=["point_id", "neighbour_id", "score"])

    true = rows.select("point_id", "project_id", "vector").dropDuplicates(["point_id"]).mapInArrow(brute, "point_id string, neighbour_id string, score double").where("point_id <> neighbour_id")
    true = true.withColumn("r", F.row_number().over(Window.partitionBy("point_id").orderBy(F.desc("score"), "neighbour_id"))).where(F.col("r") <= k)
    floor = true.groupBy("point_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    hits = knn(points, k, dimensions=dimensions, **more).join(F.broadcast(floor), "point_id").where(F.col("score") >= F.col("least") - 1e-9).groupBy("point_id").agg(F.count("*").alias("hit"))
    both = floor.join(hits, "point_id", "left")
    return both.agg(F.count("*").alias("queries"), F.lit(k).alias("k"), F.round(F.sum(F.least(F.coalesce("hit", F.lit(0)), F.col("n"))) / F.sum("n"), 4).alias("recall"))
