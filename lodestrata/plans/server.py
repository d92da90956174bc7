"""The retrieval service over HTTP: POST /retrieve, GET /health, /projects and /.

A thin layer: every request has an id, which its answer's X-Request-ID header and error body and the log line carry.
"""

from __future__ import annotations

import json
import logging
import secrets
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from lodestrata.operators.embed import Provider
from lodestrata.operators.reports import list_projects
from lodestrata.plans import service

log = logging.getLogger("lodestrata")
LARGEST = 1 << 20  # bytes of a request


def make_server(points: DataFrame, provider: Provider, port: int = 0, seconds: float = 30.0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server over the points of a store; `serve_forever` runs it, `shutdown` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):  # one line for each request, below
            pass

        def answer(self, make) -> None:
            started, request_id = time.monotonic(), secrets.token_hex(8)
            try:
                status, body = make(started)
            except service.ServiceError as e:
                status, body, request_id = e.status, e.body(), e.request_id
            except Exception:  # noqa: BLE001 - a client sees no internals
                e = service.ServiceError("Internal server error")
                status, body, request_id = e.status, e.body(), e.request_id
                log.exception("request %s failed", request_id)
            data = (body if isinstance(body, str) else json.dumps(body)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("X-Request-ID", request_id)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)
            log.info(json.dumps({"request_id": request_id, "method": self.command, "path": self.path, "status": status, "ms": int(1000 * (time.monotonic() - started))}))

        def do_GET(self) -> None:
            def make(started):
                if self.path == "/":
                    return 200, service.root()
                if self.path == "/health":
                    return service.health(points, provider)
                if self.path == "/projects":
                    rows = list_projects(points).orderBy("project_id").collect()  # as many as there are projects
                    return 200, {"projects": [r.asDict() for r in rows]}
                return 404, {"error": "Not found", "code": "NOT_FOUND"}

            self.answer(make)

        def do_POST(self) -> None:
            def make(started):
                if self.path != "/retrieve":
                    return 404, {"error": "Not found", "code": "NOT_FOUND"}
                size = int(self.headers.get("Content-Length") or 0)
                if size > LARGEST:
                    raise service.InvalidRequest("Request too large")
                request = service.Request.from_json(self.rfile.read(size).decode("utf-8", "replace"))
                found = service.retrieve(points, request, provider, run=True, seconds=seconds, unique=True)
                return 200, service.response(found, int(1000 * (time.monotonic() - started)))

            self.answer(make)

    return ThreadingHTTPServer((host, port), Handler)
