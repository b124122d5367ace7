"""Stand-alone indexes: flat, sharded HNSW graphs and inverted lists.  Scores are distances: smaller is nearer.

An HNSW index is a table of nodes.  Rows are dealt by hash of their id to shards of bounded size; each shard's
graph is built and searched by one task, and the shards' answers are merged, so recall doesn't fall with the
number of shards.  A node is known to the graph before it is linked, hence always reachable.
"""

from __future__ import annotations

import heapq
import math
import random
import zlib
from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metrics import Metric
from .search import flat_index_search

NODES = "shard int, id string, vector array<float>, layer int, connections map<int,array<string>>"
FOUND = "query_id int, id string, distance double"


def _distances(metric: Metric, q: np.ndarray, v: np.ndarray, size_q: float | None = None, size_v: np.ndarray | None = None) -> np.ndarray:
    if metric is Metric.EUCLIDEAN:
        return np.sqrt(((v - q) ** 2).sum(axis=1))
    if metric is Metric.MANHATTAN:
        return np.abs(v - q).sum(axis=1)
    product = v @ q
    if metric is Metric.DOT_PRODUCT:
        return -product
    size = (np.sqrt((v * v).sum(axis=1)) if size_v is None else size_v) * (math.sqrt(float(q @ q)) if size_q is None else size_q)
    return 1.0 - np.divide(product, size, out=np.zeros_like(product), where=size > 0)


@dataclass(frozen=True)
class HnswConfig:
    m: int = 16
    m0: int = 32
    ef_construction: int = 200
    ef: int = 50
    seed: int = 42
    max_layer: int = 16
    shard_size: int = 2_000

    def __post_init__(self):
        if min(self.m, self.m0, self.ef_construction, self.ef, self.shard_size) < 1:
            raise ValueError("HNSW parameters must be positive")


class Graph:
    """One shard's graph, in memory of one task."""

    def __init__(self, config: HnswConfig, metric: Metric, dims: int):
        self.config, self.metric = config, metric
        self.hold(np.zeros((0, dims)))
        self.n = 0
        self.levels: list[int] = []
        self.links: list[list[list[int]]] = []
        self.entry = -1

    def hold(self, vectors: np.ndarray) -> None:
        """The vectors, and their sizes, which each distance would else take again."""
        self.vectors = np.asarray(vectors, np.float64)
        self.sizes = np.sqrt((self.vectors * self.vectors).sum(axis=1))

    def _level(self, key: str) -> int:
        draw = random.Random(zlib.crc32(key.encode()) ^ self.config.seed).random()
        return min(self.config.max_layer, int(-math.log(max(draw, 1e-12)) / math.log(self.config.m + 1)))

    def _layer(self, q: np.ndarray, start: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ``ef`` nearest nodes that a best-first walk from ``start`` finds in a layer, nearest first."""
        seen = set(start)
        size = math.sqrt(float(q @ q))
        first = _distances(self.metric, q, self.vectors[start], size, self.sizes[start])
        near = [(float(d), s) for d, s in zip(first, start, strict=True)]
        heapq.heapify(near)
        kept = [(-d, s) for d, s in near]
        heapq.heapify(kept)
        while near:
            d, at = heapq.heappop(near)
            if len(kept) >= ef and d > -kept[0][0]:
                break
            fresh = [x for x in self.links[at][layer] if x not in seen] if layer < len(self.links[at]) else []
            if not fresh:
                continue
            seen.update(fresh)
            for d, x in zip(_distances(self.metric, q, self.vectors[fresh], size, self.sizes[fresh]).tolist(), fresh, strict=True):
                if len(kept) < ef or d < -kept[0][0]:
                    heapq.heappush(near, (d, x))
                    heapq.heappush(kept, (-d, x))
                    if len(kept) > ef:
                        heapq.heappop(kept)
        return sorted((-d, s) for d, s in kept)

    def _prune(self, node: int, layer: int) -> None:
        most, links = self.config.m0 if layer == 0 else self.config.m, self.links[node][layer]
        if len(links) > most:
            d = _distances(self.metric, self.vectors[node], self.vectors[links], None, self.sizes[links])
            kept = [links[i] for i in np.argsort(d, kind="stable")[:most]]
            # A node that would lose its last link keeps this one.
            lone = [x for x in links if x not in kept and len(self.links[x][layer]) <= 1 and node in self.links[x][layer]]
            self.links[node][layer] = kept + lone
            for x in set(links) - set(kept) - set(lone):
                if len(self.links[x][layer]) > 1 and node in self.links[x][layer]:
                    self.links[x][layer].remove(node)

    def add_all(self, keys: list[str], vectors: np.ndarray) -> None:
        self.hold(vectors)
        for key in keys:
            node, level, q = self.n, self._level(key), self.vectors[self.n]
            self.n += 1
            self.levels.append(level)
            self.links.append([[] for _ in range(level + 1)])
            if self.entry < 0:
                self.entry = node
                continue
            start, top = [self.entry], self.levels[self.entry]
            for layer in range(top, level, -1):
                start = [self._layer(q, start, 1, layer)[0][1]]
            for layer in range(min(level, top), -1, -1):
                found = self._layer(q, start, self.config.ef_construction, layer)
                start = [x for _, x in found]
                chosen = start[: self.config.m0 if layer == 0 else self.config.m]
                self.links[node][layer] = list(chosen)
                for x in chosen:
                    self.links[x][layer].append(node)
                    self._prune(x, layer)
            if level > top:
                self.entry = node

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        start = [self.entry]
        for layer in range(self.levels[self.entry], 0, -1):
            start = [self._layer(q, start, 1, layer)[0][1]]
        return self._layer(q, start, max(ef, k), 0)[:k]


class Index(ABC):
    """An index over ``id, vector`` rows."""

    def __init__(self, metric: Metric | int | str = Metric.COSINE):
        self.metric = Metric.parse(metric)

    @abstractmethod
    def build(self, rows: DataFrame) -> Index: ...

    @abstractmethod
    def search(self, vector, k: int) -> DataFrame: ...


def _checked(rows: DataFrame, strict: bool) -> DataFrame:
    rows = rows.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    if strict and not rows.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("duplicate id")
    return rows


class FlatIndex(Index):
    """Exact search by distance."""

    rows: DataFrame

    def build(self, rows: DataFrame) -> FlatIndex:
        self.rows = _checked(rows, True)
        return self

    def add(self, rows: DataFrame) -> FlatIndex:
        """Rows under new ids; an id that is there already is an error."""
        self.rows = _checked(self.rows.unionByName(_checked(rows, True)), True)
        return self

    def delete(self, ids: list[str]) -> FlatIndex:
        known = self.rows.where(F.col("id").isin(ids)).count()
        if known < len(set(ids)):
            raise KeyError("no such id")
        self.rows = self.rows.where(~F.col("id").isin(ids))
        return self

    def search(self, vector, k: int) -> DataFrame:
        return flat_index_search(self.rows, vector, k, self.metric)

    def save(self, path: str) -> None:
        self.rows.withColumn("metric", F.lit(int(self.metric))).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, metric: Metric | int | str | None = None, dimensions: int | None = None) -> FlatIndex:
        """The saved index; it must have the metric and the dimensions that are asked for."""
        rows = spark.read.parquet(path)
        about = rows.agg(F.min("metric").alias("metric"), F.min(F.size("vector")).alias("dims"), F.max(F.size("vector")).alias("most")).first()
        if metric is not None and about.metric is not None and about.metric != Metric.parse(metric):
            raise ValueError("the index was saved with another metric")
        if dimensions is not None and about.dims is not None and (about.dims != dimensions or about.most != dimensions):
            raise ValueError("the index was saved with other dimensions")
        index = cls(about.metric if about.metric is not None else metric or Metric.COSINE)
        index.rows = rows.drop("metric")
        return index


class HnswIndex(Index):
    """Approximate search in sharded graphs; deleted ids stay in the graph and are left out of results."""

    nodes: DataFrame

    def __init__(self, metric: Metric | int | str = Metric.COSINE, config: HnswConfig | None = None):
        super().__init__(metric)
        self.config = config or HnswConfig()
        self.deleted: set[str] = set()
        self.shards = 0

    def build(self, rows: DataFrame) -> HnswIndex:
        rows = _checked(rows, True)
        shards = max(1, math.ceil(rows.count() / self.config.shard_size))
        config, metric = self.config, self.metric
        self.shards = shards
        schema = pa.schema([("shard", pa.int32()), ("id", pa.string()), ("vector", pa.list_(pa.float32())), ("layer", pa.int32()), ("connections", pa.map_(pa.int32(), pa.list_(pa.string())))])

        def build(table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            ids, vectors = table.column("id").to_pylist(), np.array(table.column("vector").to_pylist())
            graph = Graph(config, metric, vectors.shape[1])
            graph.add_all(ids, vectors)
            links = [[(layer, [ids[x] for x in held]) for layer, held in enumerate(of)] for of in graph.links]
            shard = table.column("shard").cast(pa.int32())
            return pa.table([shard, table.column("id"), table.column("vector").cast(pa.list_(pa.float32())), pa.array(graph.levels, pa.int32()), pa.array(links, schema.field("connections").type)], schema=schema)

        def build_all(batches):
            batches = list(batches)
            if batches and (table := pa.Table.from_batches(batches)).num_rows:
                yield from build(table).to_batches()

        # A partition for each shard: Spark, which sees few bytes, would give one task many of them.
        dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "vector").repartitionById(shards, F.col("shard"))
        self.nodes = dealt.mapInArrow(build_all, NODES)
        return self

    def save(self, path: str) -> HnswIndex:
        """Write the nodes, one folder a shard, and go on with the written table."""
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").partitionBy("shard").parquet(path)
        self.nodes = spark.read.parquet(path).select("shard", "id", "vector", "layer", "connections")
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str, metric: Metric | int | str = Metric.COSINE, config: HnswConfig | None = None) -> HnswIndex:
        index = cls(metric, config)
        index.nodes = spark.read.parquet(path).select("shard", "id", "vector", "layer", "connections")
        return index

    def delete(self, ids: list[str]) -> HnswIndex:
        self.deleted |= set(ids)
        return self

    def search(self, vector, k: int, ef: int | None = None) -> DataFrame:
        return self.search_many([vector], k, ef).select("id", "distance")

    def search_many(self, vectors, k: int, ef: int | None = None) -> DataFrame:
        """``query_id`` (place in ``vectors``), ``id, distance, rank``."""
        config, metric, deleted = self.config, self.metric, self.deleted
        q = np.asarray(vectors, np.float64)
        ef = ef or config.ef

        def search(table: pa.Table) -> pa.Table:
            ids = table.column("id").to_pylist()
            at = {x: i for i, x in enumerate(ids)}
            graph = Graph(config, metric, q.shape[1])
            graph.hold(np.array(table.column("vector").to_pylist(), np.float64))
            graph.n = len(ids)
            graph.levels = table.column("layer").to_pylist()
            graph.links = [[[at[x] for x in held if x in at] for _, held in sorted(of)] for of in table.column("connections").to_pylist()]
            graph.entry = max(range(len(ids)), key=lambda i: (graph.levels[i], ids[i]))
            out = [(i, ids[x], d) for i, v in enumerate(q) for d, x in [(d, x) for d, x in graph.search(v, k + len(deleted), ef + len(deleted)) if ids[x] not in deleted][:k]]
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            return pa.table({"query_id": pa.array(columns[0], pa.int32()), "id": pa.array(columns[1], pa.string()), "distance": pa.array(columns[2], pa.float64())})

        nodes = self.nodes.repartition(2 * self.shards, "shard") if self.shards else self.nodes  # as in ``build``
        found = nodes.groupBy("shard").applyInArrow(search, FOUND)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


class IvfIndex(Index):
    """Inverted lists: rows filed under their nearest of some centroids; a search reads the nearest lists only."""

    rows: DataFrame

    def __init__(self, metric: Metric | int | str = Metric.COSINE, clusters: int = 100, probes: int = 10, rounds: int = 8, seed: int = 42):
        super().__init__(metric)
        self.clusters, self.probes, self.rounds, self.seed = clusters, probes, rounds, seed
        self.centroids = np.zeros((0, 0))

    def _place(self, v: np.ndarray) -> np.ndarray:
        c = self.centroids
        if self.metric is Metric.COSINE:
            size = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
        return ((c * c).sum(axis=1)[None, :] - 2 * v @ c.T).argmin(axis=1)

    def build(self, rows: DataFrame) -> IvfIndex:
        """Centroids by Lloyd's iterations, each a grouped mean over all rows, from rows chosen by hash."""
        rows = _checked(rows, True)
        start = rows.orderBy(F.xxhash64("id", F.lit(self.seed))).limit(self.clusters).collect()
        self.centroids = np.array([r.vector for r in start], np.float64)
        if not len(self.centroids):
            self.rows = rows.withColumn("cluster", F.lit(0))
            return self
        dims = self.centroids.shape[1]

        def sums(batches):
            total, n = np.zeros(self.centroids.shape), np.zeros(len(self.centroids), np.int64)
            for batch in batches:
                v = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, dims)
                at = self._place(v)
                np.add.at(total, at, v)
                n += np.bincount(at, minlength=len(n))
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(len(n)), pa.int32()), "n": pa.array(n, pa.int64()), "total": pa.array(total.tolist(), pa.list_(pa.float64()))})

        for _ in range(self.rounds):
            parts = rows.select("vector").mapInArrow(sums, "cluster int, n bigint, total array<double>")
            merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total")).collect()  # one row a cluster
            for r in merged:
                if r.n:
                    self.centroids[r.cluster] = np.array(r.total) / r.n
            if self.metric is Metric.COSINE:
                size = np.sqrt((self.centroids**2).sum(axis=1, keepdims=True))
                self.centroids = np.divide(self.centroids, size, out=self.centroids, where=size > 0)

        def file(batches):
            for batch in batches:
                v = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, dims)
                yield batch.append_column("cluster", pa.array(self._place(v), pa.int32()))

        self.rows = rows.mapInArrow(file, "id string, vector array<float>, cluster int")
        return self

    def save(self, path: str) -> IvfIndex:
        """Write one folder a list, so a search prunes to the probed ones."""
        spark = self.rows.sparkSession
        self.rows.write.mode("overwrite").partitionBy("cluster").parquet(path)
        self.rows = spark.read.parquet(path)
        return self

    def search(self, vector, k: int, probes: int | None = None) -> DataFrame:
        if not len(self.centroids):
            return flat_index_search(self.rows, vector, k, self.metric)
        q = np.asarray(vector, np.float64)[None, :]
        c = self.centroids
        if self.metric is Metric.COSINE:
            q = q / max(float(np.sqrt((q * q).sum())), 1e-300)
        near = ((c * c).sum(axis=1) - 2 * (q @ c.T)[0]).argsort()[: probes or self.probes]
        return flat_index_search(self.rows.where(F.col("cluster").isin([int(x) for x in near])), vector, k, self.metric)


def make_index(kind: str, metric: Metric | int | str = Metric.COSINE, **params) -> Index:
    if kind == "flat":
        return FlatIndex(metric)
    if kind == "hnsw":
        return HnswIndex(metric, HnswConfig(**params))
    if kind == "ivf":
        return IvfIndex(metric, **params)
    raise ValueError(f"unknown index: {kind!r}")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id, recall``: the share of the exact neighbours that were found."""
    hits = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
