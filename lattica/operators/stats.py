"""Statistics of collections, documents and indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import IndexType


def collection_info(vectors: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``vector_count, dimensions, bytes`` of one collection."""
    size = F.size(vector_col)
    return vectors.agg(F.count("*").alias("vector_count"), F.max(size).alias("dimensions"), F.sum(size.cast("bigint") * 4 + F.octet_length(F.col(id_col).cast("string"))).alias("bytes"))


def stats_by(vectors: DataFrame, by: Column, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``collection`` and its ``vector_count, dimensions, bytes``, of the collections that lie in one table, in one pass."""
    size = F.size(vector_col)
    of = vectors.groupBy(by.alias("collection"))
    return of.agg(F.count("*").alias("vector_count"), F.max(size).alias("dimensions"), F.sum(size.cast("bigint") * 4 + F.octet_length(F.col(id_col).cast("string"))).alias("bytes"))


def database_stats(collections: dict[str, DataFrame], id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """One row a collection, by name."""
    parts = [collection_info(df, id_col, vector_col).select(F.lit(name).alias("collection"), "*") for name, df in collections.items()]
    return reduce(DataFrame.unionByName, parts).orderBy("collection")


def memory_estimate(n: Column, dimensions: Column, index: IndexType | int | str = IndexType.FLAT, m: int = 16) -> Column:
    """Bytes that ``n`` vectors take in memory under an index."""
    index = IndexType.parse(index)
    raw = n * dimensions * 4
    if index is IndexType.FLAT:
        return (raw + n * 64).cast("bigint")
    return (raw + n * F.lit(1.5 * m * 8).cast("bigint") + n * 128).cast("bigint") if index is IndexType.HNSW else raw.cast("bigint")


def index_stats(nodes: DataFrame) -> DataFrame:
    """``vectors, edges, average_degree, max_layer, bytes`` of a graph index."""
    degree = F.aggregate(F.map_values("connections"), F.lit(0), lambda a, x: a + F.size(x))
    out = nodes.agg(
        F.count("*").alias("vectors"), F.sum(degree.cast("bigint")).alias("edges"), F.max("layer").alias("max_layer"),
        F.sum(F.size("vector").cast("bigint") * 4 + degree * 8 + F.octet_length(F.col("id").cast("string"))).alias("bytes"),
    )
    return out.withColumn("average_degree", F.when(F.col("vectors") > 0, F.col("edges") / F.col("vectors")).otherwise(0.0))


def recommend(n: int, goal: str = "default") -> dict:
    """An index and its parameters for ``n`` vectors: small, medium, large, high_precision, fast_build, or by size."""
    known = {
        "small": ("flat", {}), "medium": ("hnsw", {"m": 16, "ef_construction": 200, "ef": 50}), "large": ("hnsw", {"m": 32, "ef_construction": 400, "ef": 100}),
        "high_precision": ("hnsw", {"m": 64, "ef_construction": 800, "ef": 200}), "fast_build": ("hnsw", {"m": 8, "ef_construction": 100, "ef": 50}),
    }
    index, params = known.get(goal) or known["small" if n < 10_000 else "medium"]
    return {"index": index, **params}


def documents_by_type(documents: DataFrame, type_col: str = "type", size_col: str = "size") -> DataFrame:
    return documents.groupBy(F.col(type_col).alias("type")).agg(F.count("*").alias("documents"), F.sum(size_col).alias("total_size"), F.avg(size_col).alias("avg_size"))


def repository_stats(files: DataFrame, size_col: str = "size", language_col: str = "language") -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.sum(size_col).alias("total_size"), F.sort_array(F.collect_set(language_col)).alias("languages"))
