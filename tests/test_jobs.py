import json
import uuid
from dataclasses import dataclass

import pytest

from lodestrata.operators.embed import Hashing
from lodestrata.operators.store import Store, open_store
from lodestrata.plans import index, service
from lodestrata.sources import config, files
from lodestrata.streaming import trigger

@dataclass(frozen=True)
class Counting(Hashing):
    """Notes in a folder what it was asked for; fails for one text."""

    folder: str = ""

    def embed_batch(self, texts):
        if "boom" in texts:
            raise ValueError("boom")
        if self.folder:
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("".join(t[:20] + "\n" for t in texts))
        return super().embed_batch(texts)


def tree(root, **contents):
    for name, text in contents.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def scan(spark, root):
    return files.scan(spark, config.Project("shop", str(root), (".go", ".md", ".txt")))


def state(store):
    return sorted((r.file_path, r.symbol, r.content_hash) for r in store.read().collect())


def test_incremental_equals_full(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / ".hidden.txt").write_text("kept")
    (root / "sub").mkdir()
    (root / "sub" / "a.md").write_text("# A\none\n# B\ntwo")
    (root / "m.go").write_text("package m\nfunc F() {\n}\n")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.md").write_text("# no")
    (root / "skip.bin").write_text("no")
    hashing = Counting(8)
    one, manifest = Store(spark, str(tmp_path / "one"), 8), index.Manifest(spark, str(tmp_path / "one-manifest"))
    counters = index.index(scan(spark, root), manifest, one, hashing).first()
    assert (counters.files_scanned, counters.files_indexed, counters.chunks_created) == (3, 3, 4)
    assert [s[:2] for s in state(one)] == [(".hidden.txt", ".hidden.txt"), ("m.go", "F"), ("sub/a.md", "A"), ("sub/a.md", "B")]
    (root / "sub" / "a.md").write_text("# A\none\n# C\nthree")
    (root / "m.go").unlink()
    (root / "new.txt").write_text("new")
    versions = {r.version for r in one.versions.index().collect()}
    counters = index.index(scan(spark, root), manifest, one, hashing).first()
    assert (counters.files_scanned, counters.files_skipped, counters.files_indexed, counters.files_deleted, counters.chunks_created, counters.chunks_deleted) == (3, 1, 2, 1, 2, 2)
    assert len({r.version for r in one.versions.index().collect()} & versions) == 1  # untouched partitions stay where they are
    full = Store(spark, str(tmp_path / "full"), 8)
    index.index(scan(spark, root), index.Manifest(spark, str(tmp_path / "full-manifest")), full, hashing)
    assert state(one) == state(full)
    assert sorted(r.file_path for r in manifest.read().collect()) == [".hidden.txt", "new.txt", "sub/a.md"]
    again = index.index(scan(spark, root), manifest, one, hashing).first()
    assert (again.files_scanned, again.files_skipped, again.files_indexed, again.chunks_created) == (3, 3, 0, 0)


def test_each_chunk_is_embedded_once_and_errors_stay_with_their_project(spark, tmp_path):
    rows = {"a": [("a", f"f{i}.txt", f"text {i}") for i in range(5)], "b": [("b", "x.txt", "boom")], "c": [("c", "y.txt", "word " * 900)]}
    ddl = "project_id string, file_path string, text string"
    seen = tmp_path / "seen"
    seen.mkdir()
    store, manifest = Store(spark, str(tmp_path / "s"), 8), index.Manifest(spark, str(tmp_path / "m"))
    limits = spark.createDataFrame([("c", 0, 100), ("a", None, 0)], "project_id string, min_tokens int, max_tokens int")
    got = index.index_all(["a", "b", "c"], lambda p: files.describe(spark.createDataFrame(rows[p], ddl)), manifest, store, Counting(8, str(seen)), limits=limits)
    assert [(r.project_id, bool(r.errors), r.counters.get("files_indexed")) for r in got] == [("a", False, 1 * 5), ("b", True, None), ("c", False, 1)]
    assert "boom" in got[1].errors[0] or "Python" in got[1].errors[0]
    asked = [line for f in seen.iterdir() for line in f.read_text().splitlines()]
    assert sorted(asked.count(f"text {i}") for i in range(5)) == [1] * 5
    assert all(r.project_id != "b" for r in store.read().collect()) and manifest.read().where("project_id = 'b'").count() == 0
    assert store.read().where("project_id = 'c'").count() == 1  # one line can't be cut
    before = {r.version for r in store.versions.index().collect()}
    index.index(files.describe(spark.createDataFrame(rows["a"][:2], ddl)), manifest, store, Hashing(8), full=True)
    assert sorted(r.file_path for r in store.read().where("project_id = 'a'").collect()) == ["f0.txt", "f1.txt"]
    assert store.versions.vacuum() and store.read().count() == 3 and before
    with pytest.raises(NotImplementedError):
        open_store("qdrant", spark, "x", 8)


def test_retrieve(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("p", "a/x.txt", "text", "a", "red apples"), ("p", "b.txt", "text", "", "green pears"), ("q", "c.txt", "text", "", "red apples")], "project_id string, file_path string, language string, module string, text string")
    points = index.as_points(__import__("lodestrata.operators.embed", fromlist=["embed"]).embed(index.chunk_files(rows), Hashing()))
    found = service.retrieve(points, service.Request.from_json('{"project_id": "p", "query": "red apples", "top_k": 1}'), Hashing())
    (r,) = found.collect()
    assert (r.source, r.module) == ("a/x.txt", "a") and abs(r.score - 1) < 1e-6
    assert json.loads(service.response(found, 4))["results"][0]["source"] == "a/x.txt"
    assert service.render_markdown(found, "q", 7) == '## Search Results for: "q"\\nFound: 1 results (7ms)\\n\\n### a/x.txt:1-1\n**x.txt** (file) | Score: 100.0%\n```text\nred apples\n```\n\n'
    run = service.retrieve(points, service.Request("p", "red apples", 1), Hashing(), run=True)
    assert [x.source for x in run.collect()] == ["a/x.txt"]
    broken = points.withColumn("vector", F.when(F.col("project_id") == "p", F.raise_error(F.lit("gone")).cast("array<float>")).otherwise(F.col("vector")))
    with pytest.raises(service.SearchFailed) as failed:
        service.retrieve(broken, service.Request("p", "red apples"), Hashing(), run=True)
    assert service.render_error(failed.value).endswith("(code: SEARCH_FAILED)")
    assert service.retrieve(points, service.Request("none", "x"), Hashing()).count() == 0
    assert service.render_markdown(found.where(F.lit(False)), "zz", 1, "p") == 'No results found for query: "zz" in project p'
    with pytest.raises(service.MissingField):
        service.retrieve(points, service.Request("", "x"), Hashing())
    with pytest.raises(service.InvalidRequest) as e:
        service.Request.from_json("{")
    assert e.value.body()["code"] == "INVALID_REQUEST" and len(e.value.request_id) == 16
    assert service.health(points, Hashing())[0] == 200
    assert [service.clamp(k) for k in (-1, 0, 7, 21)] == [5, 5, 7, 20]


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("embedding:\n  provider: hashing\n  dimensions: 48\nserver:\n  read_timeout: 1m30s\n  write_timeout: bad\nchunking:\n  max_tokens: 0\n")
    c = config.load_config(path)
    assert (c.provider, c.dimensions, c.read_timeout, c.write_timeout, c.chunking.max_tokens, c.chunking.merge_small_chunks) == ("hashing", 48, 90.0, 30.0, 800, False)
    manager = config.Manager(path)
    path.write_text("server:\n  port: 70000\n")
    with pytest.raises(config.ConfigError):
        manager.reload()
    assert manager.config.provider == "hashing"
    folder = tmp_path / "projects"
    folder.mkdir()
    (folder / "a.yaml").write_text("project_id: my-proj1\nsource_path: x\ninclude_extensions: [.go]\nchunking:\n  max_tokens: 100\n")
    p = config.get_project(folder, "my-proj1")
    assert p.exclude_paths == config.DEFAULT_EXCLUDES and p.chunking(c.chunking).max_tokens == 100 and p.chunking(c.chunking).min_tokens == 200
    (folder / "b.yml").write_text("project_id: My_Proj\nsource_path: x\ninclude_extensions: [.go]\n")
    with pytest.raises(config.ConfigError):
        config.load_projects(folder)


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([("p", "a.txt", "x"), ("p", "a.txt", "y"), ("p", "b.go", "package b")], "project_id string, file_path string, text string").write.parquet(str(folder))
    seen = []
    trigger.start(trigger.incoming(spark, str(folder)), lambda rows, n: seen.extend(rows.select("file_path", "language").collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.file_path, r.language) for r in seen) == [("a.txt", "text"), ("b.go", "go")]
