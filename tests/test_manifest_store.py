import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import manifest as m
from lodestrata.operators import reports, search, store
from lodestrata.operators.embed import Hashing, batches, embed, provider

T = dt.datetime(2025, 1, 1)
MANIFEST = "project_id string, file_path string, file_hash string, mod_time timestamp, indexed_at timestamp, chunk_ids array<string>, chunk_hashes map<string,string>"
POINT = "point_id string, chunk_id string, vector array<float>, project_id string, file_path string, symbol string, symbol_type string, language string, module string, start_line int, end_line int, content string, content_hash string, indexed_at timestamp"


def entry(path, h, ids, hashes, when=T, project="p"):
    return (project, path, h, when, when, ids, hashes)


@pytest.fixture(scope="module")
def state(spark):
    rows = [entry("a", "h0", ["x"], None, T - dt.timedelta(1)), entry("a", "h1", ["a1", "a2"], {"a1": "1", "a2": "2"}), entry("gone", "g", ["g1"], {"g1": "9"}), entry("old", "o", ["o1"], None), entry(None, "n", None, None)]
    return spark.createDataFrame(rows, MANIFEST)


def files(spark, *rows):
    return spark.createDataFrame([("p", *r) for r in rows], "project_id string, file_path string, file_hash string")


def chunks(spark, *rows):
    return spark.createDataFrame([("p", *r) for r in rows], "project_id string, file_path string, chunk_id string, content_hash string, position int")


def paths(df):
    return sorted(r.file_path or "" for r in df.collect())


def test_file_differences(spark, state):
    now = files(spark, ("a", "h1"), ("old", "changed"), ("new", "n"))
    assert paths(m.changed_files(now, state)) == ["new", "old"]
    assert paths(m.skipped_files(now, state)) == ["a"]
    assert paths(m.deleted_files(now, state)) == ["", "gone"]
    assert [r.chunk_id for r in m.purged_chunks(now, state).collect()] == ["g1"]


def test_same_state_has_no_difference(spark, state):
    now = m.latest(state).select("project_id", "file_path", "file_hash")
    assert m.changed_files(now, state).count() == 0 and m.deleted_files(now, state).count() == 0


def test_chunk_differences(spark, state):
    now = chunks(spark, ("a", "a1", "1", 1), ("a", "a3", "3", 2), ("old", "o2", "5", 1))
    assert sorted(r.chunk_id for r in m.changed_chunks(now, state).collect()) == ["a3", "o2"]
    # the entry without hashes falls back to its ids; files that weren't chunked keep theirs
    assert sorted(r.chunk_id for r in m.stale_chunks(now, state).collect()) == ["a2", "o1"]


def test_upsert_keeps_order_and_dedupes_ids(spark, state):
    now = chunks(spark, ("a", "z", "1", 1), ("a", "b", "2", 2), ("a", "z", "1", 3))
    out = {r.file_path: r for r in m.upsert(now, files(spark, ("a", "h2")), state).collect()}
    assert out["a"].chunk_ids == ["z", "b"] and out["a"].chunk_hashes == {"z": "1", "b": "2"} and out["a"].file_hash == "h2"
    assert set(out) == {"a", "gone", "old", None}


def test_stats_and_empty(spark, state):
    r = m.stats(state).first()
    assert (r.file_count, r.chunk_count) == (4, 4)
    none = state.limit(0)
    r = m.stats(none).first()
    assert (r.file_count, r.chunk_count) == (0, 0)
    assert m.changed_files(files(spark, ("a", "h")), none).count() == 1


def point(i, vector, project="p", **more):
    base = dict(point_id=i, chunk_id=f"c{i}", vector=vector, project_id=project, file_path="f", symbol="s", symbol_type="file", language="go", module="m", start_line=1, end_line=2, content="t", content_hash="h", indexed_at=T) | more
    return tuple(base[f.split()[0]] for f in POINT.split(", "))


def test_search_ties_filters_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [point("b", [1.0, 0.0]), point("a", [2.0, 0.0]), point("c", [0.0, 1.0], symbol_type="class"), point("d", None), point("e", [0.0, 0.0]), point("f", [nan, 1.0]), point("g", [1.0]), point("h", [inf, 1.0]), point("i", [1.0, 0.1], project="q"), point("a", [2.0, 0.0])]
    df = spark.createDataFrame(rows, POINT)
    top = [(r.point_id, round(r.score, 3)) for r in search.top_k(df, [1.0, 0.0], 2).collect()]
    assert top == [("a", 1.0), ("b", 1.0)]
    assert [r.point_id for r in search.top_k(df, [1.0, 0.0], 5, search.Filter("q")).collect()] == ["i"]
    assert [r.point_id for r in search.top_k(df, [0.0, 1.0], 9, search.Filter(symbol_type="class")).collect()] == ["c"]
    assert search.top_k(df, [1.0, 0.0], 9, search.Filter("p"), 0.5).count() == 2
    assert search.top_k(df, [0.0, 0.0], 9).count() == 0 and search.top_k(df.limit(0), [1.0, 0.0], 9).count() == 0
    queries = spark.createDataFrame([(1, [1.0, 0.0], 1, "p", None, None, "", nan), (2, [1.0, 0.0], -1, None, None, None, None, 0.99), (3, None, 5, None, None, None, None, None)], "query_id int, vector array<float>, top_k int, project_id string, module string, language string, symbol_type string, score_threshold float")
    got = sorted((r.query_id, r["rank"], r.point_id) for r in search.batch_top_k(df, queries, 2).collect())
    assert got == [(1, 1, "a"), (2, 1, "a"), (2, 2, "b"), (2, 3, "i")]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), 2)
    assert not s.exists()
    first = spark.createDataFrame([point("a", [1.0, 0.0]), point("b", [0.0, 1.0], project="q")], POINT)
    s.commit(first)
    newer = spark.createDataFrame([point("a", [0.0, 1.0], content="new", indexed_at=T + dt.timedelta(1)), point("a", [0.5, 1.0], content="older"), point("z", [1.0, 1.0])], POINT)
    s.commit(store.upsert(s.read(), newer.select(*s.read().columns)))
    assert sorted((r.point_id, r.content) for r in s.read().collect()) == [("a", "new"), ("b", "t"), ("z", "t")]
    ids = spark.createDataFrame([("z",), ("unknown",)], "point_id string")
    s.commit(store.delete_ids(s.read(), ids))
    s.commit(store.delete_by_filter(s.read(), search.Filter("q")))
    assert [r.point_id for r in s.read().collect()] == ["a"]
    with pytest.raises(ValueError):
        store.delete_by_filter(s.read(), search.Filter())
    with pytest.raises(Exception):
        s.commit(spark.createDataFrame([point("x", [1.0])], POINT))
    assert [r.point_id for r in s.read().collect()] == ["a"]


def test_embedding(spark):
    df = spark.createDataFrame([(f"c{i}", "p", f"text {i}") for i in range(70)] + [("n", "q", None)], "chunk_id string, project_id string, content string")
    assert sorted(r["count"] for r in batches(df).where("project_id = 'p'").groupBy("batch").count().collect()) == [6, 32, 32]
    rows = embed(df, Hashing(8)).collect()
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-5 for r in rows) and len(rows) == 71
    with pytest.raises(ValueError):
        provider("huggingface")


def test_reports(spark):
    df = spark.createDataFrame([("p", "f", "s", "x" * 5123), ("p", "f", "t", "x" * 5122), ("q", "g", None, "x" * 9000), ("q", "g", None, None)], "project_id string, file_path string, symbol string, content string")
    over = reports.oversized_chunks(df)
    assert sorted((r.project_id, r.token_count) for r in over.collect()) == [("p", 2049), ("q", 3600)]
    assert {r.project_id: r.total_count for r in reports.oversized_report(over).collect()} == {"p": 1, "q": 1}
    none = df.limit(0)
    counters = reports.run_counters(df, df, none, none, df, none, over)
    total = reports.totals(counters).where("is_total = 1").first()
    assert (total.projects, total.files_scanned, total.oversized) == (2, 4, 2)
    p = reports.progress(spark.createDataFrame([(2.0,), (4.0,)], "seconds double"), 2).first()
    assert (p.processed, p.avg_seconds, p.eta_seconds, p.percent) == (2, 3.0, 6.0, 50.0)
    assert reports.progress(spark.createDataFrame([], "seconds double"), 2).first().eta_seconds == 0.0
