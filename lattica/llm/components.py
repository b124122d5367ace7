"""Connected components of a table of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

ROUNDS = 40


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, old, label)
        label = label[label]
        if np.array_equal(label, old):
            return label


def _forest(batches):
    """Of a partition's edges, one from each node to the smallest that they lead to."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = components(len(nodes), at[: len(a)], at[len(a) :])
    far = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["u", "v"])


def groups(pairs: DataFrame, a_col: str = "doc_a", b_col: str = "doc_b") -> DataFrame:
    """``member, head``: each document that the pairs lead, over any number of steps, to a smaller one; ``head`` is the smallest.

    Alternating large and small stars, on what is left of the pairs after each partition has joined its own.
    Pairs with a null or of one document say nothing; repeated pairs count once.
    """
    edges = pairs.select(F.greatest(a_col, b_col).cast("bigint").alias("u"), F.least(a_col, b_col).cast("bigint").alias("v")).where(f"{a_col} IS NOT NULL AND {b_col} IS NOT NULL AND u > v")
    edges = written(edges.mapInArrow(_forest, "u bigint, v bigint").distinct(), "groups")
    for _ in range(ROUNDS):
        tangled = edges.groupBy("u").count().where("count > 1").select("u").union(edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u"))
        if tangled.isEmpty():
            return edges.select(F.col("u").alias("member"), F.col("v").alias("head"))
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", "m")).distinct()
        edges = written(small, "groups")
    raise RuntimeError("groups did not settle")
