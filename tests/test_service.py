import json
import threading
import urllib.error
import urllib.request

from lodestrata.operators.embed import OpenAI, Hashing, Ollama, embed
from lodestrata.plans import batch, index
from lodestrata.plans.server import make_server
from lodestrata.sources import config


def ask(url, body=None):
    request = urllib.request.Request(url, json.dumps(body).encode() if isinstance(body, dict) else body)
    try:
        with urllib.request.urlopen(request, timeout=120) as r:
            return r.status, json.loads(r.read()), r.headers
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read()), e.headers


def served(server):
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_address[1]}"


def test_routes(spark):
    rows = spark.createDataFrame([("p", "a/x.txt", "text", "a", "red apples"), ("p", "b.txt", "text", "", "green pears")], "project_id string, file_path string, language string, module string, text string")
    server = make_server(index.as_points(embed(index.chunk_files(rows), Hashing())), Hashing())
    url = served(server)
    status, body, headers = ask(f"{url}/retrieve", {"project_id": "p", "query": "red apples", "top_k": 1})
    assert status == 200 and [r["source"] for r in body["results"]] == ["a/x.txt"] and body["query_time_ms"] >= 0 and len(headers["X-Request-ID"]) == 16
    status, body, headers = ask(f"{url}/retrieve", b"{")
    assert (status, body["code"], body["request_id"]) == (400, "INVALID_REQUEST", headers["X-Request-ID"])
    assert ask(f"{url}/retrieve", {"query": "x"})[1]["code"] == "MISSING_REQUIRED_FIELD"
    assert ask(f"{url}/projects")[1] == {"projects": [{"project_id": "p", "chunk_count": 2}]}
    assert ask(f"{url}/health")[0] == 200 and ask(f"{url}/")[0] == 200 and ask(f"{url}/none")[0] == 404
    server.shutdown()


def test_http_providers():
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Stub(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def reply(self, body):
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self.reply({"models": [{"name": "m:latest"}]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/api/embeddings":
                self.reply({"embedding": [float(len(body["prompt"])), 1.0] if body["prompt"] else []})
            else:
                self.reply({"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"]))) if t]})

    server = HTTPServer(("127.0.0.1", 0), Stub)
    url = served(server)
    ollama = Ollama(url, "m", 2)
    assert ollama.embed_batch(["ab", "c"]) == [[2.0, 1.0], [1.0, 1.0]] and ollama.healthy() and not Ollama(url, "other", 2).healthy()
    try:
        ollama.embed_batch([""])
        raise AssertionError
    except ValueError:
        pass
    assert OpenAI("k", url, "m", 1).embed_batch(["abc", "", "d"]) == [[3.0], [], [1.0]] and OpenAI("k", url, "m", 1).healthy()
    server.shutdown()


def test_batch_runs_every_project_and_reports_errors(spark, tmp_path, capsys):
    (tmp_path / "src" / "a").mkdir(parents=True)
    (tmp_path / "src" / "a" / "big.txt").write_text("word " * 2000)
    projects = tmp_path / "projects"
    projects.mkdir()
    (projects / "a.yaml").write_text("project_id: a\nsource_path: a\ninclude_extensions: [.txt]\nchunking:\n  max_tokens: 4000\n")
    (projects / "b.yaml").write_text("project_id: b\nsource_path: missing\ninclude_extensions: [.txt]\n")
    path = tmp_path / "c.yaml"
    path.write_text(f"embedding:\n  provider: hashing\n  dimensions: 8\nprojects:\n  config_dir: {projects}\n  source_base_path: {tmp_path}/src\nindexing:\n  cache_dir: {tmp_path}/cache\n")
    a, b = batch.run(spark, config.load_config(path))
    assert a.counters["files_indexed"] == 1 and a.counters["oversized"] == 1 and not a.errors and b.errors and not b.counters
    assert spark.read.json(f"{tmp_path}/cache/oversized/a/chunks").count() == 1
    assert batch.eta(2, 6, 3.0) == {"done": 2, "total": 6, "percent": 33.3, "avg_seconds": 1.5, "eta_seconds": 6.0} and batch.eta(0, 0, 1.0)["eta_seconds"] == 0.0
