"""Embedding providers and batch embedding.

Providers share a small protocol and a registry. Besides the two HTTP providers there is a deterministic local one,
feature hashing of words, which needs no model and is the default of tests and examples; it is an addition.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import spread

BATCH_SIZE = 32


class Provider(Protocol):
    dimensions: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...

    def healthy(self) -> bool: ...


@dataclass(frozen=True)
class Hashing:
    """Words hashed to signed dimensions, normalized. The same text always has the same vector."""

    dimensions: int = 48

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimensions)
            for word in re.findall(r"\w+", (text or "").lower()):
                h = xxhash.xxh64_intdigest(word)
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            norm = float(np.linalg.norm(v))
            if norm == 0:
                v[0], norm = 1.0, 1.0
            out.append((v / norm).astype(np.float32).tolist())
        return out

    def healthy(self) -> bool:
        return True


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


@dataclass(frozen=True)
class Ollama:
    """One call for each text; an empty vector is an error."""

    endpoint: str = "http://localhost:11434"
    model: str = "nomic-embed-text"
    dimensions: int = 768
    timeout: float = 30.0

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = _post(f"{self.endpoint}/api/embeddings", {"model": self.model, "prompt": text}, {}, self.timeout).get("embedding")
            if not vector:
                raise ValueError("the model returned an empty vector")
            out.append(vector)
        return out

    def healthy(self) -> bool:
        with urllib.request.urlopen(f"{self.endpoint}/api/tags", timeout=self.timeout) as answer:
            names = [m.get("name", "") for m in json.loads(answer.read()).get("models", [])]
        return self.model in names or f"{self.model}:latest" in names


@dataclass(frozen=True)
class OpenAI:
    """One call for each batch; answers are put in order by their index, missing ones stay empty."""

    api_key: str
    endpoint: str = "https://api.openai.com/v1"
    model: str = "text-embedding-3-small"
    dimensions: int = 1536
    timeout: float = 30.0

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        answer = _post(f"{self.endpoint}/embeddings", {"model": self.model, "input": texts}, {"Authorization": f"Bearer {self.api_key}"}, self.timeout)
        out: list[list[float]] = [[] for _ in texts]
        for item in answer.get("data", []):
            if 0 <= item["index"] < len(out):
                out[item["index"]] = item["embedding"]
        return out

    def healthy(self) -> bool:
        return bool(self.embed_batch(["test"])[0])


PROVIDERS: dict[str, Callable[..., Provider]] = {"hashing": Hashing, "ollama": Ollama, "openai": OpenAI}


def provider(name: str, **settings) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"embedding provider {name!r} is not implemented")
    return PROVIDERS[name](**settings)


def batches(chunks: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """chunk_id, project_id, batch INT: consecutive batches of `size` in order of id, numbered from 0 within each project.

    A project may hold a third of all chunks, so the position is found from counts of hash-free prefixes: chunks are
    ranked within a bucket of their id's digest order, and buckets add the number of chunks before them.
    """
    keyed = chunks.select("chunk_id", "project_id", F.substring(F.sha2("chunk_id", 256), 1, 16).alias("key")).withColumn("bucket", F.substring("key", 1, 3))
    counts = keyed.groupBy("project_id", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("project_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows a project
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("project_id", "bucket").orderBy("key", "chunk_id"))
    placed = keyed.withColumn("nth", inside).join(counts.select(F.col("project_id").alias("p"), F.col("bucket").alias("b"), "before"), F.col("project_id").eqNullSafe(F.col("p")) & (F.col("bucket") == F.col("b")))
    return placed.select("chunk_id", "project_id", F.floor((F.col("before") + F.col("nth") - 1) / size).cast("int").alias("batch"))


def embed(chunks: DataFrame, by: Provider, text: str = "content", size: int = BATCH_SIZE) -> DataFrame:
    """`chunks` with `vector` ARRAY<FLOAT>; texts go to the provider in batches of `size`, one client a task.

    Put the difference against the manifest before this stage: Catalyst doesn't move filters below it.
    """
    kept = [c for c in chunks.columns if c != "vector"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            texts = [t or "" for t in b.column(kept.index(text)).to_pylist()]
            vectors = [v for lo in range(0, len(texts), size) for v in by.embed_batch(texts[lo : lo + size])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*kept, "vector"])

    ddl = ", ".join(f"`{n}` {t}" for n, t in chunks.select(*kept).dtypes) + ", vector array<float>"
    return spread(chunks.select(*kept)).mapInArrow(run, ddl)
