"""Scores of all pairs of rows.  Rows are dealt to blocks, and each pair of blocks is a matrix product in a partition of its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.metrics import Metric
from .search import _scores, _unit, in_order, parts

#: Rows of a block at most, rows of one product, and how near to a bucket's bound a score is taken again in the vectors' order.
BLOCK, STRIP, CLOSE = 16_384, 128, 1e-12


def _padded(column: pa.ChunkedArray, missing: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors filled up with zeros to one length, and their lengths; ``missing`` where there is none or a number is null."""
    column = column.combine_chunks()
    flat, size = column.flatten(), pc.fill_null(pc.list_value_length(column), missing).to_numpy(zero_copy_only=False).astype(np.int64)
    dims = int(size.max(initial=0))
    if not flat.null_count and (size == dims).all():
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(size), dims), size
    out = np.zeros((len(size), dims))
    for i, v in enumerate(column.to_pylist()):
        if v is not None and None not in v:
            out[i, : len(v)] = v
        else:
            size[i] = missing
    return out, size


def _blocks(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``pair, side, id, v``: every block in one partition with each other one (side 0 or 1), and in one by itself (side 2)."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    held = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>").alias("v")).where("id IS NOT NULL")
    blocks = parts(held.count(), BLOCK, 512)
    own, other = F.col("own"), F.col("other")
    low, high = F.least(own, other), F.greatest(own, other)
    each = held.withColumn("own", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    pair = low * blocks - F.expr("least(own, other) * (least(own, other) - 1) div 2") + high - low
    side = F.when(own == other, 2).when(own > other, 1).otherwise(0)
    return each.select(pair.cast("int").alias("pair"), side.alias("side"), "id", "v").repartitionById(blocks * (blocks + 1) // 2, F.col("pair"))


def _strips(batches, metric: Metric):
    """``ids, vectors, ids, vectors, scores, same`` of some rows of a block with all of their partners; ``same`` if they are of one block."""
    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    sides = [table.filter(pc.equal(table.column("side"), s)) for s in (0, 1, 2)]
    same = sides[2].num_rows > 0
    left, right = (sides[2], sides[2]) if same else sides[:2]
    if not left.num_rows or not right.num_rows:
        return
    a, b = (t.column("id").combine_chunks().to_numpy(zero_copy_only=False) for t in (left, right))
    (v, n), (w, m) = _padded(left.column("v"), -1), _padded(right.column("v"), -2)
    dims = max(v.shape[1], w.shape[1])
    v, w = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (v, w))
    even = n.min() == n.max() == m.min() == m.max()
    x, y = (_unit(v), _unit(w)) if metric is Metric.COSINE else (v, w)
    for s in range(0, len(v), STRIP):
        t = slice(s, s + STRIP)
        scores = _scores(Metric.DOT_PRODUCT if metric is Metric.COSINE else metric, x[t], y)
        if not even:  # vectors of different lengths, or that are missing, have nothing in common
            scores[n[t][:, None] != m[None, :]] = 0.0
        yield a[t], v[t], b, w, scores, same


def pairwise(vectors: DataFrame, metric: Metric | int | str = Metric.COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``a, b, score`` of every pair with a < b; the number of pairs is the square of that of rows, by definition."""
    metric, kind = Metric.parse(metric), vectors.schema[id_col].dataType

    def score(batches):
        for a, _, b, _, scores, same in _strips(batches, metric):
            i, j = np.nonzero(a[:, None] < b[None, :]) if same else np.nonzero(a[:, None] != b[None, :])
            low, high, found = a[i], b[j], scores[i, j]
            if not same:
                turn = low > high
                low, high = np.where(turn, high, low), np.where(turn, low, high)
            for s in range(0, len(found), 100_000):
                t = slice(s, s + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(low[t], to), pa.array(high[t], to), pa.array(found[t], pa.float64())], names=["a", "b", "score"])

    to = to_arrow_type(kind)
    return _blocks(vectors, id_col, vector_col).mapInArrow(score, f"a {kind.simpleString()}, b {kind.simpleString()}, score double")


def pairwise_histogram(vectors: DataFrame, metric: Metric | int | str = Metric.COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``score_histogram`` of all pairs with a < b, counted where they are made: no pair leaves its task."""
    metric = Metric.parse(metric)
    names = ["low", "medium", "high"]

    def count(batches):
        total = [[0, np.inf, -np.inf, 0.0] for _ in names]
        for a, v, b, w, scores, same in _strips(batches, metric):
            if same:
                scores = np.where(a[:, None] < b[None, :], scores, -np.inf)
            elif np.isin(a, b).any():
                scores = np.where(a[:, None] != b[None, :], scores, -np.inf)
            if metric is Metric.COSINE:  # the few at a bucket's bound, as SQL adds them up
                for bound in (0.2, 0.5):
                    if (close := np.abs(scores - bound) < CLOSE).any():
                        i, j = np.nonzero(close)
                        scores[i, j] = in_order(metric, v[i], w[j])[1]
            flat = scores.ravel()
            below = flat < 0.2
            upper = flat[~below]
            high = ~(upper <= 0.5)
            lower = flat[below]
            for k, x in enumerate((lower[lower > -np.inf], upper[~high], upper[high])):
                if len(x):
                    t = total[k]
                    total[k] = [t[0] + len(x), min(t[1], x.min()), max(t[2], x.max()), t[3] + x.sum()]
        held = [(n, *t) for n, t in zip(names, total, strict=True) if t[0]]
        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], k) for i, k in enumerate((pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["bucket", "n", "low", "high", "total"])

    found = _blocks(vectors, id_col, vector_col).mapInArrow(count, "bucket string, n bigint, low double, high double, total double")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("low").alias("min_score"), F.max("high").alias("max_score"), (F.sum("total") / F.sum("n")).alias("avg_score"))
