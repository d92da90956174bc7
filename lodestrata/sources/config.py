"""Configuration from YAML files: defaults, checks, project files, reload. Small driver-side data."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from lodestrata.functions.ids import IDEAL_TOKENS, MAX_TOKENS, MIN_TOKENS

# What holds where a file says nothing. Zero counts as unset.
DEFAULT_EXCLUDES = (".git/", "vendor/", "node_modules/")
CODE_STRATEGIES = ("function", "file", "fixed", "")
MARKDOWN_STRATEGIES = ("heading", "paragraph", "fixed", "")
EMBEDDERS, STORES = ("ollama", "openai", "huggingface", "hashing"), ("qdrant", "milvus", "weaviate", "parquet")


class ConfigError(ValueError):
    pass


def seconds(text: str | None, default: float) -> float:
    """A duration such as `1m30s` or `250ms`; the default where it can't be read."""
    units = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001, "us": 1e-6, "ns": 1e-9}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|us|ns|h|m|s)", text or "")
    if not parts or "".join(n + u for n, u in parts) != text:
        return default
    return sum(float(n) * units[u] for n, u in parts)


@dataclass(frozen=True)
class Chunking:
    min_tokens: int = MIN_TOKENS
    ideal_tokens: int = IDEAL_TOKENS
    max_tokens: int = MAX_TOKENS
    merge_small_chunks: bool = False


@dataclass(frozen=True)
class Config:
    provider: str = "ollama"
    model: str = "nomic-embed-text"
    dimensions: int = 768
    batch_size: int = 32
    embed_timeout: float = 30.0
    embed_endpoint: str = ""
    api_key: str = ""
    store_path: str = ""
    source_base_path: str = ""
    cache_dir: str = "cache"
    store: str = "parquet"
    collection: str = "code_chunks"
    projects_dir: str = "configs/projects"
    chunking: Chunking = field(default_factory=Chunking)
    port: int = 8080
    read_timeout: float = 30.0
    write_timeout: float = 30.0
    shutdown_timeout: float = 10.0
    log_level: str = "info"
    log_format: str = "json"

    def check(self) -> Config:
        if self.provider not in EMBEDDERS:
            raise ConfigError(f"unknown embedding provider {self.provider!r}")
        if self.store not in STORES:
            raise ConfigError(f"unknown vector store {self.store!r}")
        if self.dimensions <= 0:
            raise ConfigError("dimensions must be positive")
        if self.chunking.min_tokens >= self.chunking.max_tokens:
            raise ConfigError("min_tokens must be below max_tokens")
        if not 1 <= self.port <= 65535:
            raise ConfigError("port must be within 1-65535")
        return self


@dataclass(frozen=True)
class Project:
    project_id: str
    source_path: str
    include_extensions: tuple[str, ...]
    exclude_paths: tuple[str, ...] = DEFAULT_EXCLUDES
    display_name: str = ""
    code_strategy: str = ""
    markdown_strategy: str = ""
    min_tokens: int = 0
    ideal_tokens: int = 0
    max_tokens: int = 0
    team: str = ""
    tags: tuple[str, ...] = ()

    def check(self) -> Project:
        if not re.fullmatch(r"[a-z0-9-]+", self.project_id):
            raise ConfigError(f"project_id {self.project_id!r} must be lower case letters, digits and hyphens")
        if not self.source_path:
            raise ConfigError("source_path is required")
        if not self.include_extensions:
            raise ConfigError("at least one extension must be included")
        if self.code_strategy not in CODE_STRATEGIES or self.markdown_strategy not in MARKDOWN_STRATEGIES:
            raise ConfigError("unknown chunking strategy")
        return self

    def full_path(self, base: str) -> str:
        return os.path.join(base, self.source_path)

    def chunking(self, common: Chunking) -> Chunking:
        """The common limits with the project's positive ones in their place; their order isn't checked again."""
        own = {k: v for k in ("min_tokens", "ideal_tokens", "max_tokens") if (v := getattr(self, k)) > 0}
        return replace(common, **own)


def _yaml(path: str | Path) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load_config(path: str | Path) -> Config:
    raw, d = _yaml(path), Config()
    at = lambda *keys: _dig(raw, keys)
    chunking = Chunking(at("chunking", "min_tokens") or MIN_TOKENS, at("chunking", "ideal_tokens") or IDEAL_TOKENS, at("chunking", "max_tokens") or MAX_TOKENS, bool(at("chunking", "merge_small_chunks")))
    return Config(
        provider=os.environ.get("EMBEDDING_PROVIDER") or at("embedding", "provider") or d.provider,
        model=at("embedding", "model") or d.model,
        dimensions=at("embedding", "dimensions") or d.dimensions,
        batch_size=at("embedding", "batch_size") or d.batch_size,
        embed_timeout=seconds(at("embedding", "timeout"), d.embed_timeout),
        embed_endpoint=os.environ.get("EMBEDDING_ENDPOINT") or at("embedding", "endpoint") or d.embed_endpoint,
        api_key=os.environ.get("OPENAI_API_KEY") or at("embedding", "api_key") or d.api_key,
        store_path=at("vectordb", "path") or at("vectordb", "endpoint") or d.store_path,
        source_base_path=os.environ.get("SOURCE_BASE_PATH") or at("projects", "source_base_path") or d.source_base_path,
        cache_dir=at("indexing", "cache_dir") or d.cache_dir,
        store=at("vectordb", "provider") or d.store,
        collection=at("vectordb", "collection") or d.collection,
        projects_dir=at("projects", "config_dir") or d.projects_dir,
        chunking=chunking,
        port=at("server", "port") or d.port,
        read_timeout=seconds(at("server", "read_timeout"), d.read_timeout),
        write_timeout=seconds(at("server", "write_timeout"), d.write_timeout),
        shutdown_timeout=seconds(at("server", "shutdown_timeout"), d.shutdown_timeout),
        log_level=at("logging", "level") or d.log_level,
        log_format=at("logging", "format") or d.log_format,
    ).check()


def _dig(raw: dict, keys: tuple[str, ...]):
    for k in keys:
        raw = raw.get(k) if isinstance(raw, dict) else None
    return raw


def load_project(path: str | Path) -> Project:
    raw = _yaml(path)
    at = lambda *keys: _dig(raw, keys)
    return Project(
        project_id=at("project_id") or "",
        source_path=at("source_path") or "",
        include_extensions=tuple(at("include_extensions") or ()),
        exclude_paths=tuple(at("exclude_paths") or DEFAULT_EXCLUDES),
        display_name=at("display_name") or "",
        code_strategy=at("chunking", "code", "strategy") or "",
        markdown_strategy=at("chunking", "markdown", "strategy") or "",
        min_tokens=at("chunking", "min_tokens") or 0,
        ideal_tokens=at("chunking", "ideal_tokens") or 0,
        max_tokens=at("chunking", "max_tokens") or 0,
        team=at("metadata", "team") or "",
        tags=tuple(at("metadata", "tags") or ()),
    ).check()


def load_projects(folder: str | Path) -> dict[str, Project]:
    """All `.yaml` and `.yml` files of a folder, not of its sub-folders; one bad file fails all."""
    found = [load_project(p) for p in sorted(Path(folder).iterdir()) if p.suffix in (".yaml", ".yml")]
    return {p.project_id: p for p in found}


def get_project(folder: str | Path, project_id: str) -> Project:
    for suffix in (".yaml", ".yml"):
        if (p := Path(folder) / f"{project_id}{suffix}").exists():
            return load_project(p)
    found = load_projects(folder)
    if project_id not in found:
        raise ConfigError(f"project {project_id!r} not found")
    return found[project_id]


class Manager:
    """Holds the configuration; `reload` swaps it if the new one is good, and tells listeners."""

    def __init__(self, path: str | Path):
        self.path, self.listeners = path, []
        self.config = load_config(path)

    def reload(self) -> Config:
        new = load_config(self.path)
        self.config = new
        for tell in self.listeners:
            tell(new)
        return new
