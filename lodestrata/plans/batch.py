"""The batch entry point: `python -m lodestrata.plans.batch --config FILE [--project ID] [--full]`.

Projects are indexed one after the other; what stops one is reported and doesn't stop the others. The exit status is 1 if
any project had errors.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time

from pyspark.sql import SparkSession

from lodestrata.operators.embed import Provider, provider
from lodestrata.operators.reports import write_oversized
from lodestrata.operators.store import open_store
from lodestrata.plans.index import Manifest, Result, index_all
from lodestrata.session import ship
from lodestrata.sources import config, files

log = logging.getLogger("lodestrata")


def provider_of(c: config.Config) -> Provider:
    """The provider that a configuration names, with its own settings where it takes them."""
    wanted = {"model": c.model, "dimensions": c.dimensions, "timeout": c.embed_timeout, "endpoint": c.embed_endpoint, "api_key": c.api_key}
    taken = {"hashing": {"dimensions"}, "ollama": {"model", "dimensions", "timeout", "endpoint"}, "openai": set(wanted)}.get(c.provider, set())
    return provider(c.provider, **{k: v for k, v in wanted.items() if k in taken and v})


def eta(done: int, total: int, seconds: float) -> dict[str, float]:
    """Progress of a run after `done` of `total` items in so many seconds."""
    average = seconds / done if done else 0.0
    return {"done": done, "total": total, "percent": round(100 * done / total, 1) if total else 100.0, "avg_seconds": round(average, 3), "eta_seconds": round(average * (total - done), 3)}


def run(spark: SparkSession, c: config.Config, only: str | None = None, full: bool = False) -> list[Result]:
    ship(spark)
    projects = {only: config.get_project(c.projects_dir, only)} if only else config.load_projects(c.projects_dir)
    base = c.store_path or os.path.join(c.cache_dir, "store")
    store = open_store(c.store, spark, f"{base}/{c.collection}", c.dimensions)
    manifest = Manifest(spark, f"{c.cache_dir}/manifest-{c.collection}")
    own, out, started = provider_of(c), [], time.monotonic()
    for n, (name, project) in enumerate(sorted(projects.items())):
        limits = project.chunking(c.chunking)
        table = spark.createDataFrame([(name, limits.min_tokens, limits.max_tokens)], "project_id string, min_tokens int, max_tokens int")
        (result,) = index_all([name], lambda _: files.scan(spark, project, c.source_base_path), manifest, store, own, merge=c.chunking.merge_small_chunks, full=full, limits=table, report=lambda chunks: write_oversized(chunks, f"{c.cache_dir}/oversized/{name}"))
        out.append(result)
        (log.error if result.errors else log.info)(json.dumps({"project": name, **result.counters, "errors": result.errors, "seconds": round(result.seconds, 3), **eta(n + 1, len(projects), time.monotonic() - started)}))
    return out


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Index projects.")
    p.add_argument("--config", default=os.environ.get("CONFIG_PATH", "configs/config.yaml"))
    p.add_argument("--project")
    p.add_argument("--full", action="store_true")
    a = p.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(message)s", stream=sys.stderr)
    c = config.load_config(a.config)
    spark = SparkSession.builder.appName("lodestrata-index").getOrCreate()
    results = run(spark, c, a.project, a.full)
    print(json.dumps([r.__dict__ for r in results]))
    return 1 if any(r.errors for r in results) else 0


if __name__ == "__main__":
    raise SystemExit(main())
