"""Exact nearest-neighbour search: one query as a plan that ends in TakeOrderedAndProject, many queries by Arrow and numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.filters import apply_filter
from ..functions.metrics import Metric, index_distance, literal, similarity

DEFAULT_LIMIT, MOST = 10, 1000
#: Queries of a join that are sent to each task, and beyond that, queries in a block.
BLOCK = 4_000


def clamp_limit(limit: int | None) -> int:
    """10 unless positive; 1000 at most."""
    return DEFAULT_LIMIT if not limit or limit <= 0 else min(limit, MOST)


@dataclass(frozen=True)
class SearchRequest:
    vector: list[float]
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    filter: dict | None = None
    include_vector: bool = False
    include_metadata: bool = False
    include_content: bool = False
    min_score: float | None = None
    params: dict = field(default_factory=dict)

    def validate(self, dimensions: int | None = None) -> None:
        if self.limit <= 0:
            raise ValueError("limit must be positive")
        if self.offset < 0:
            raise ValueError("offset must not be negative")
        if dimensions is not None and len(self.vector) != dimensions:
            raise ValueError(f"the query has {len(self.vector)} dimensions; {dimensions} expected")


def scored(rows: DataFrame, query: Column, metric: Metric | int | str, vector_col: str = "vector") -> DataFrame:
    """``rows`` with ``score``, higher is nearer."""
    return rows.withColumn("score", similarity(metric, F.col(vector_col), query))


def ranked(rows: DataFrame, limit: int, offset: int = 0, score: str = "score", id_col: str = "id", ascending: bool = False) -> DataFrame:
    """A page of the rows by score; equal scores by id."""
    out = rows.orderBy(F.col(score).asc() if ascending else F.col(score).desc(), F.col(id_col))
    return (out.offset(offset) if offset else out).limit(limit)


def knn(rows: DataFrame, request: SearchRequest, metric: Metric | int | str = Metric.COSINE, id_col: str = "id", vector_col: str = "vector", metadata_col: str | None = "metadata", content_col: str | None = "content") -> DataFrame:
    """Exact search: the filter, then the score, then a page of it; vector, metadata and content only when asked for."""
    request.validate()
    metadata_col = metadata_col if metadata_col in rows.columns else None
    kept = scored(apply_filter(rows, request.filter, metadata_col), literal(request.vector), metric, vector_col)
    if request.min_score is not None:
        kept = kept.where(F.col("score") >= request.min_score)
    columns = [id_col, "score"]
    if request.include_vector:
        columns.append(vector_col)
    if request.include_metadata and metadata_col:
        columns.append(metadata_col)
    if request.include_content and content_col in rows.columns:
        columns.append(content_col)
    return ranked(kept.select(*columns), request.limit, request.offset, id_col=id_col)


def candidates(rows: DataFrame, spec: dict | None, metadata_col: str | None = "metadata") -> DataFrame:
    """``total``: how many rows a search ranks, before its page is cut."""
    return apply_filter(rows, spec, metadata_col if metadata_col in rows.columns else None).agg(F.count("*").alias("total"))


def flat_index_search(rows: DataFrame, vector, k: int, metric: Metric | int | str = Metric.COSINE, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``id, distance`` of the ``k`` nearest, by ascending index distance."""
    return ranked(rows.select(id_col, index_distance(metric, F.col(vector_col), literal(vector)).alias("distance")), k, score="distance", id_col=id_col, ascending=True)


def parts(n: int, most: int, least: int) -> int:
    """Blocks for ``n`` rows: of ``most`` at most, and up to 10 of ``least`` so that small inputs keep the cores busy as well."""
    return max(1, -(-n // most), min(10, -(-n // least)))


def knn_join(rows: DataFrame, queries: DataFrame, k: int, metric: Metric | int | str = Metric.COSINE, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query", block: int = BLOCK) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` nearest rows of each query, for integer ids.

    Up to ``block`` queries are sent to each task.  More are dealt to blocks of up to four times so many, and the rows to blocks of
    their own; each pair of blocks has a partition, where matrix products find its ``k`` best, so no pairs are made.
    """
    metric = Metric.parse(metric)
    n = queries.count()
    if n <= block:
        few = queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(query_vector).cast("array<double>").alias("v")).collect()  # ``block`` at most
        found = batch_search(rows, [r.id for r in few], [r.v for r in few], k, metric, id_col, vector_col)
        return found.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), "score", "rank")
    single = all(t.schema[c].dataType.simpleString() == "array<float>" for t, c in ((rows, vector_col), (queries, query_vector)))
    asked, held = (t.select(F.col(i).cast("bigint").alias("id"), F.col(c).cast("array<float>" if single else "array<double>").alias("v")) for t, i, c in ((queries, query_id, query_vector), (rows, id_col, vector_col)))
    of_queries, of_rows = parts(n, 4 * block, max(1, block // 8)), parts(held.count(), 16 * block, 2 * block)
    deal = lambda parts: F.pmod(F.xxhash64("id", "v"), F.lit(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
    left = held.withColumn("row_block", deal(of_rows)).withColumn("query_block", each(of_queries)).withColumn("asks", F.lit(False))
    right = asked.withColumn("query_block", deal(of_queries)).withColumn("row_block", each(of_rows)).withColumn("asks", F.lit(True))
    dealt = left.unionByName(right).select((F.col("query_block") * of_rows + F.col("row_block")).cast("int").alias("pair"), "asks", "id", "v").repartitionById(of_queries * of_rows, F.col("pair"))

    def search(batches):
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        some, stored = table.filter(table.column("asks")), table.filter(pc.invert(table.column("asks")))
        if some.num_rows and stored.num_rows:
            dims = pc.max(pc.list_value_length(some.column("v"))).as_py() or 0
            ids = some.column("id").to_numpy()
            for at, own, score in _nearest(metric, stored.column("id").to_numpy(), _matrix(stored.column("v"), dims), _matrix(some.column("v"), dims), k):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(own, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "id", "score"])

    found = dealt.mapInArrow(search, "query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _sum(terms: np.ndarray) -> np.ndarray:
    """Sums of the rows from left to right, so that equal rows have equal sums, and the same as SQL's."""
    return np.add.accumulate(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def in_order(metric: Metric, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearness (the product, or less the squared or plain distance) and score of each row of ``a`` with that of ``b``."""
    if metric is Metric.MANHATTAN:
        near = -_sum(np.abs(a - b))
        return near, 1.0 / (1.0 - near)
    if metric is Metric.EUCLIDEAN:
        near = -_sum((a - b) ** 2)
        return near, 1.0 / (1.0 + np.sqrt(-near))
    near = _sum(a * b)
    if metric is Metric.COSINE:
        size = np.sqrt(_sum(a * a) * _sum(b * b))
        near = np.divide(near, size, out=np.zeros_like(near), where=size > 0)
    return near, near


def _about(metric: Metric, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
    """Nearness of all pairs by matrix products, and how far it may be from ``in_order``; cosines of unit vectors in single precision."""
    dims, most = v.shape[1] + 8, lambda x: float((x * x).sum(axis=1).max(initial=0.0))
    if metric is Metric.COSINE:
        return q @ v.T, dims * 2.0**-23
    if metric is Metric.MANHATTAN:
        near = -np.stack([np.abs(v - row).sum(axis=1) for row in q])
        return near, dims * 2.0**-51 * float(-near.min(initial=0.0))
    if metric is Metric.EUCLIDEAN:
        return 2 * (q @ v.T) - (q * q).sum(axis=1)[:, None] - (v * v).sum(axis=1)[None, :], dims * 2.0**-49 * (most(q) + most(v))
    return q @ v.T, dims * 2.0**-51 * float(np.sqrt(most(q) * most(v)))


def _nearest(metric: Metric, ids: np.ndarray, v: np.ndarray, q: np.ndarray, k: int, queries: int = 512, rows: int = 4_096):
    """Yields places in ``q``, ids and scores of the ``k`` best rows of some queries; equal scores by id.

    The products only choose candidates: those that may be as near as the k-th so far.  Rows come in random order, so these soon
    are few; at most ``k`` a query are kept from one product to the next.
    """
    order = np.random.default_rng(0).permutation(len(v))
    ids, v = ids[order], v[order]
    fast = [_unit(x).astype(np.float32) if metric is Metric.COSINE else x for x in (q, v)]
    for s in range(0, len(q), queries):
        some = fast[0][s : s + queries]
        floor = np.full(len(some), -np.inf)
        at, who, near, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        for t in range(0, len(v), rows):
            about, margin = _about(metric, some, fast[1][t : t + rows])
            if not t and about.shape[1] > k:
                floor = np.partition(about, -k, axis=1)[:, -k].astype(np.float64) - 2 * margin
            flat = np.flatnonzero(about >= floor.astype(about.dtype)[:, None])
            for c in range(0, len(flat), 100_000):
                i, j = np.divmod(flat[c : c + 100_000], about.shape[1])
                new = in_order(metric, q[s + i], v[t + j])
                at, who, near, score = (np.concatenate(x) for x in ((at, i), (who, ids[t + j]), (near, new[0]), (score, new[1])))
                best = np.lexsort((who, -score, at))
                at, who, near, score = (x[best] for x in (at, who, near, score))
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                last = rank == k - 1
                floor[at[last]] = np.maximum(floor[at[last]], near[last] - 2 * margin)
                at, who, near, score = (x[rank < k] for x in (at, who, near, score))
        yield s + at, who, score


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors of ``dims`` numbers as rows; others are rows of zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not column.null_count and (pc.list_value_length(column).to_numpy(zero_copy_only=False) == dims).all() and not (flat := column.flatten()).null_count:
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dims:
            out[i] = v
    return out


def _scores(metric: Metric, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    if metric in (Metric.COSINE, Metric.DOT_PRODUCT):
        s = q @ v.T
        if metric is Metric.COSINE:
            size = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
            s = np.divide(s, size, out=np.zeros_like(s), where=size > 0)
        return s
    if metric is Metric.MANHATTAN:
        return np.stack([1.0 / (1.0 + np.abs(v - row).sum(1)) for row in q]) if len(q) else np.zeros((0, len(v)))
    gap = np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T), 0.0)
    near = gap < 1e-6
    if near.any():  # cancellation: take these from the differences
        i, j = np.nonzero(near)
        gap[i, j] = ((q[i] - v[j]) ** 2).sum(1)
    return 1.0 / (1.0 + np.sqrt(gap))


def batch_search(rows: DataFrame, query_ids: list, query_vectors, k: int, metric: Metric | int | str = Metric.COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, id, score, rank`` for a batch of query vectors held by the driver: matrix products over Arrow batches.

    Every batch keeps its ``k`` best for each query, so what is shuffled doesn't depend on the vectors' length.
    """
    metric = Metric.parse(metric)
    spark = rows.sparkSession
    q = np.asarray(query_vectors, np.float64)
    shared = spark.sparkContext.broadcast((list(map(int, query_ids)), q))

    def search(batches):
        ids, q = shared.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own = batch.column(0).to_numpy(zero_copy_only=False)
            v, ids = _matrix(batch.column(1), q.shape[1]), np.asarray(ids)
            for at, who, score in _nearest(metric, own, v, q, k):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(who, pa.int64()), pa.array(score)], names=["query_id", "id", "score"])

    found = rows.select(F.col(id_col).cast("bigint"), F.col(vector_col).cast("array<double>")).mapInArrow(search, "query_id bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
