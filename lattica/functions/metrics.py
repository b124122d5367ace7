"""Vector similarity and distance as columns; sums are taken in double precision."""

from __future__ import annotations

import math
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DIMENSIONS = 10_000


class _Named(IntEnum):
    @classmethod
    def parse(cls, value):
        """A member from itself, its number or its name in any case."""
        if isinstance(value, str):
            name = value.strip().lower()
            if name.isdecimal():
                value = int(name)
            else:
                found = {m.name.lower(): m for m in cls} | cls.aliases()
                if name not in found:
                    raise ValueError(f"unknown {cls.__name__.lower()}: {value!r}")
                return found[name]
        try:
            return cls(value)
        except ValueError:
            raise ValueError(f"unknown {cls.__name__.lower()}: {value!r}") from None

    @classmethod
    def aliases(cls) -> dict:
        return {}


class Metric(_Named):
    COSINE = 0
    EUCLIDEAN = 1
    DOT_PRODUCT = 2
    MANHATTAN = 3

    @classmethod
    def aliases(cls) -> dict:
        return {"dot": cls.DOT_PRODUCT, "l2": cls.EUCLIDEAN, "l1": cls.MANHATTAN}


class IndexType(_Named):
    FLAT = 0
    HNSW = 1
    IVF = 2


class VectorizerType(_Named):
    NONE = 0
    SENTENCE_TRANSFORMERS = 1
    OPENAI = 2
    HUGGINGFACE = 3
    OLLAMA = 4
    HASH = 5


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(_doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where a norm is 0 or the lengths differ.  Norms that are known can be given."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; infinite for vectors of different lengths."""
    return F.when(F.size(a) == F.size(b), F.sqrt(_total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))).otherwise(float("inf"))


def manhattan(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.abs(x - y)))).otherwise(float("inf"))


def similarity(metric: Metric | int | str, a: Column, b: Column) -> Column:
    """Collection score, higher is nearer: cosine, dot product, or 1 / (1 + distance)."""
    metric = Metric.parse(metric)
    if metric is Metric.COSINE:
        return cosine(a, b)
    if metric is Metric.DOT_PRODUCT:
        return dot(a, b)
    return 1.0 / (1.0 + (euclidean(a, b) if metric is Metric.EUCLIDEAN else manhattan(a, b)))


def index_distance(metric: Metric | int | str, a: Column, b: Column) -> Column:
    """Index score, lower is nearer: 1 - cosine, -dot product, or the distance."""
    metric = Metric.parse(metric)
    if metric is Metric.COSINE:
        return 1.0 - cosine(a, b)
    if metric is Metric.DOT_PRODUCT:
        return -dot(a, b)
    return euclidean(a, b) if metric is Metric.EUCLIDEAN else manhattan(a, b)


def normalize(a: Column) -> Column:
    """The vector at length 1; a vector of length 0 stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(_doubles(a), lambda x: x / size)).otherwise(_doubles(a))


def rounded(x: Column, places: int = 6) -> Column:
    """Half away from zero.  A negative number of which nothing is left becomes -0.0, as when SQL rounds doubles; Spark's own ``round`` gives 0.0."""
    return F.signum(x) * F.round(F.abs(x), places)


def literal(vector) -> Column:
    """A query vector as a constant that Catalyst folds."""
    return F.lit([float(x) for x in vector]).cast("array<double>") if len(vector) else F.array().cast("array<double>")


def parse_vector(text: str) -> list[float]:
    """``"[1, 2.5]"`` or ``"1,2.5"`` as numbers."""
    inner = text.replace(" ", "").strip("[]")
    if not inner:
        raise ValueError("empty vector")
    return [float(x) for x in inner.split(",")]


def parse_vector_column(text: Column) -> Column:
    """Vectors written in text; null where they can't be read."""
    parts = F.split(F.regexp_replace(text, r"[\[\] ]", ""), ",")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when(F.exists(numbers, lambda x: x.isNull()), None).otherwise(numbers)


def score_histogram(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """``bucket`` (high above 0.5, medium from 0.2, low), its number of pairs, and their least, greatest and mean score."""
    s = F.col(score_col)
    bucket = F.when(s > 0.5, "high").when(s >= 0.2, "medium").otherwise("low")
    return scores.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.avg(s).alias("avg_score"))


def python_similarity(metric: Metric | int | str, a, b) -> float:
    """``similarity`` of two sequences, on the driver."""
    metric = Metric.parse(metric)
    product = math.fsum(x * y for x, y in zip(a, b, strict=True))
    if metric is Metric.DOT_PRODUCT:
        return product
    if metric is Metric.COSINE:
        size = math.sqrt(math.fsum(x * x for x in a)) * math.sqrt(math.fsum(y * y for y in b))
        return product / size if size else 0.0
    gaps = [abs(x - y) for x, y in zip(a, b, strict=True)]
    return 1 / (1 + (math.sqrt(math.fsum(g * g for g in gaps)) if metric is Metric.EUCLIDEAN else math.fsum(gaps)))
