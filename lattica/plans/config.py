"""One immutable configuration: defaults, then a file, then the environment, then arguments; checked when made."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace

from pyspark.sql import SparkSession

PREFIX = "LATTICA_"


@dataclass(frozen=True)
class SearchConfig:
    default_limit: int = 10
    max_limit: int = 1000
    min_score: float | None = None
    cache_entries: int = 1000
    cache_ttl: float = 300.0


@dataclass(frozen=True)
class IndexConfig:
    type: str = "flat"
    metric: str = "cosine"
    m: int = 16
    ef_construction: int = 200
    ef: int = 50
    clusters: int = 100
    probes: int = 10


@dataclass(frozen=True)
class ProcessingConfig:
    strategy: str = "sentence"
    chunk_size: int = 1024
    overlap: int = 128
    min_size: int = 100
    max_size: int = 2048
    language: str = "en"


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    shuffle_partitions: int | None = None
    search: SearchConfig = field(default_factory=SearchConfig)
    index: IndexConfig = field(default_factory=IndexConfig)
    processing: ProcessingConfig = field(default_factory=ProcessingConfig)

    def __post_init__(self):
        problems = check(self)
        if problems:
            raise ValueError("; ".join(problems))

    def apply(self, spark: SparkSession) -> SparkSession:
        if self.shuffle_partitions:
            spark.conf.set("spark.sql.shuffle.partitions", self.shuffle_partitions)
        return spark

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


def check(c: Config) -> list[str]:
    """What is wrong with a configuration."""
    out = []
    if not c.data_dir:
        out.append("data_dir is empty")
    if c.shuffle_partitions is not None and c.shuffle_partitions < 1:
        out.append("shuffle_partitions must be positive")
    if not 0 < c.search.default_limit <= c.search.max_limit:
        out.append("default_limit must lie between 1 and max_limit")
    if c.search.cache_entries < 1 or c.search.cache_ttl <= 0:
        out.append("the cache needs entries and a time to live")
    if c.index.type not in ("flat", "hnsw", "ivf"):
        out.append(f"unknown index type {c.index.type!r}")
    if min(c.index.m, c.index.ef_construction, c.index.ef, c.index.clusters, c.index.probes) < 1:
        out.append("index parameters must be positive")
    p = c.processing
    if p.chunk_size < 1 or not 0 <= p.overlap < p.chunk_size or p.min_size < 0 or p.max_size < p.chunk_size:
        out.append("chunk sizes must satisfy 0 <= overlap < chunk_size <= max_size")
    return out


def _merge(base, changes: Mapping):
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    unknown = set(changes) - set(known)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return {k: replace(known[k], **_merge(known[k], v)) if is_dataclass(known[k]) else v for k, v in changes.items()}


def _from_env(base, prefix: str, env: Mapping[str, str]) -> dict:
    out = {}
    for f in fields(base):
        value, name = getattr(base, f.name), prefix + f.name.upper()
        if is_dataclass(value):
            if inner := _from_env(value, name + "_", env):
                out[f.name] = inner
        elif name in env:
            try:
                out[f.name] = json.loads(env[name])
            except ValueError:
                out[f.name] = env[name]
    return out


def load(path: str | None = None, env: Mapping[str, str] | None = None, **arguments) -> Config:
    """Defaults < JSON file < environment (``LATTICA_SEARCH_DEFAULT_LIMIT=20``) < arguments (nested dicts)."""
    c = Config()
    layers = []
    if path:
        with open(path, encoding="utf-8") as f:
            layers.append(json.load(f))
    layers += [_from_env(c, PREFIX, os.environ if env is None else env), arguments]
    for layer in layers:
        c = replace(c, **_merge(c, layer))
    return c


class Watcher:
    """Reloads on demand; a configuration that a validator rejects is not taken over, and listeners hear of those that are."""

    def __init__(self, path: str | None = None, **arguments):
        self.path, self.arguments = path, arguments
        self.validators: list[Callable[[Config], None]] = []
        self.listeners: list[Callable[[Config, Config], None]] = []
        self.config = load(path, **arguments)

    def reload(self) -> Config:
        new = load(self.path, **self.arguments)
        for validate in self.validators:
            validate(new)
        old, self.config = self.config, new
        if old != new:
            for hear in self.listeners:
                hear(old, new)
        return new
