"""All pairs and nearest rows by blocks: equal to the plain rule on odd vectors, with bounded output."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import metrics as M
from lattica.operators import pairs, search

ROWS = "vec_id bigint, embedding array<double>"


def odd_rows(n=60):
    draw = random.Random(3)
    rows = [(k, [draw.gauss(0, 1) for _ in range(4)]) for k in range(n)]
    return rows + [(n, rows[0][1]), (n + 1, [0.0] * 4), (n + 2, None), (n + 3, [1.0, 2.0]), (n + 4, [2.0, 1.0]), (n + 5, [1.0, None, 1.0, 1.0]), (n + 5, rows[5][1]), (n + 6, [])]


def score(metric, a, b):
    return 0.0 if a is None or b is None or len(a) != len(b) or None in a or None in b else M.python_similarity(metric, a, b)


@pytest.mark.parametrize("metric", list(M.Metric))
def test_nearest_rows_by_blocks(spark, metric):
    draw = random.Random(2)
    rows = [(k, [draw.gauss(0, 1) for _ in range(5)]) for k in range(70)]
    rows += [(70 + i, rows[i % 7][1]) for i in range(40)]  # ties go by id
    df = spark.createDataFrame(rows, ROWS)
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    want = {(a, rank): b for a, v in rows for rank, b in enumerate([b for _, b in sorted((-round(M.python_similarity(metric, v, w), 9), b) for b, w in rows)][:8], 1)}
    for block in (9, 4_000):
        assert {(r.query_id, r["rank"]): r.vec_id for r in search.knn_join(df, asked, 8, metric, block=block).collect()} == want


def test_equal_rows_leave_a_task_k_at_a_time():
    v = np.ones((500, 3))
    found = list(search._nearest(M.Metric.COSINE, np.arange(500)[::-1].copy(), v, v[:20], 4, 8, 100))
    assert [len(x[0]) for x in found] == [32, 32, 16]
    assert [list(x[1][:4]) for x in found] == [[0, 1, 2, 3]] * 3


def test_float_vectors_are_read_without_python():
    import pyarrow as pa

    column = pa.chunked_array([pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32())), pa.array([[5.0, 6.0]], pa.list_(pa.float32()))])
    assert search._matrix(column, 2).tolist() == [[1, 2], [3, 4], [5, 6]]
    assert search._matrix(pa.array([[1.0], None, [1.0, 2.0]]), 2).tolist() == [[0, 0], [0, 0], [1, 2]]


@pytest.mark.parametrize("metric", list(M.Metric))
def test_pairs_by_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(pairs, "BLOCK", 9)
    rows = odd_rows()
    if metric is M.Metric.DOT_PRODUCT:  # null in Spark's sum, nothing here
        rows = [r for r in rows if r[1] is None or None not in r[1]]
    df = pairs.pairwise(spark.createDataFrame(rows, ROWS), metric)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted((r.a, r.b, round(r.score, 9)) for r in df.collect())
    assert got == sorted((a, b, round(score(metric, v, w), 9)) for a, v in rows for b, w in rows if a < b)
    named = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id string, embedding array<float>")
    assert [tuple(r) for r in pairs.pairwise(named, "dot").collect()] == [("a", "b", 1.0)]
    assert pairs.pairwise(named.where("false")).count() == 0


def test_histogram_of_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 9)
    monkeypatch.setattr(pairs, "STRIP", 4)
    rows = odd_rows() + [(100, [1.0, 1.0, 0.0, 0.0]), (101, [1.0, 0.0, 1.0, 0.0])]  # 0.5 is not above 0.5
    df = spark.createDataFrame(rows, ROWS)
    df = pairs.pairwise_histogram(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.bucket: (r.n, *(round(x, 9) for x in (r.min_score, r.max_score, r.avg_score))) for r in df.collect()}
    want = {}
    for a, v in rows:
        for b, w in rows:
            if a < b:
                s = 0.5 if (a, b) == (100, 101) else score("cosine", v, w)
                want.setdefault("high" if s > 0.5 else "medium" if s >= 0.2 else "low", []).append(s)
    assert got == {k: (len(x), *(round(y, 9) for y in (min(x), max(x), sum(x) / len(x)))) for k, x in want.items()}
