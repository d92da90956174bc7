import numpy as np

from lodestrata.llm import neighbours as n


def brute(rows, k):
    """(point, neighbour) -> score of the k best of each point in its project, ties by id."""
    good = {}
    for i, p, v in rows:
        if p is not None and i is not None and v is not None and len(v) == 48 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (p, np.float32(v))
    unit = {i: (p, n.unit(v[None])[0]) for i, (p, v) in good.items()}
    out = {}
    for i, (p, v) in unit.items():
        near = sorted(((-float(v @ w), j) for j, (q, w) in unit.items() if q == p and j != i))[:k]
        out |= {(i, j): -s for s, j in near}
    return out


def make(seed=1, size=700):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 48))
    rows = [(f"p{i:04d}", "big" if i % 3 else f"s{i % 7}", (centres[i % 12] + rng.normal(size=48) * 0.6).astype(np.float32).tolist()) for i in range(size)]
    rows += [(f"near{i}", "big", (np.float32(rows[i * 3 + 1][2]) + rng.normal(size=48) * 0.02).astype(np.float32).tolist()) for i in range(min(40, size // 4))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "point_id string, project_id string, vector array<float>, score double")


def test_equals_brute_force_with_dirty_rows(spark):
    rows = make() + [("x1", "big", None), ("x2", "big", [0.0] * 48), ("x3", "big", [1.0] * 24), ("x4", "big", [float("nan")] * 48), ("x5", None, [1.0] * 48), ("x6", "alone", [1.0] * 48), ("p0001", "big", None)]
    rows += [r for r in rows[:50]]  # repeated rows
    copy = [3.0] + [0.5] * 47
    rows += [(f"copy{i:02d}", "big", copy) for i in range(30)]
    got = {(r.point_id, r.neighbour_id): r.score for r in n.knn(frame(spark, rows), 10, recall=1.0).collect()}
    want = brute(rows, 10)
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-9 for x in got)
    pairs = {(r.point_id_a, r.point_id_b) for r in n.similar_pairs(frame(spark, rows)).collect()}
    assert pairs == {tuple(sorted(x)) for x, s in want.items() if s >= 0.97}


def test_cells_keep_recall(spark):
    rows = make(2, 4000)
    df = frame(spark, rows)
    (r,) = n.measured_recall(df, queries=200, cell=600).collect()
    assert r.queries == 200 and r.recall >= 0.9
    pairs = {(r.point_id_a, r.point_id_b) for r in n.similar_pairs(df, cell=600).collect()}
    want = {tuple(sorted(x)) for x, s in brute(rows, 10).items() if s >= 0.97}
    assert len(pairs & want) >= 0.97 * len(want) and pairs <= want


def test_leaves_are_widened_to_the_recall():
    rng = np.random.default_rng(5)
    x = n.unit(rng.normal(size=(6000, 48)))
    rows, _, visits = n.search_cell(x, x, np.arange(len(x)), 10, 0.95)
    probe = rng.choice(len(x), 200, replace=False)
    scores = x[probe] @ x.T
    scores[np.arange(200), probe] = -2
    truth = np.argsort(-scores, axis=1)[:, :10]
    hit = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(rows[probe], truth)])
    assert hit >= 0.9 and visits > 4


def test_empty(spark):
    none = frame(spark, make(3, 10)).limit(0)
    assert n.knn(none).count() == 0 and n.similar_pairs(none).count() == 0
