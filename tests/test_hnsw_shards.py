"""Each shard of an HNSW index is built by a task of its own."""

import random

from lattica.operators import index
from lattica.operators.index import HnswConfig


def test_a_task_for_each_shard(spark):
    draw = random.Random(6)
    rows = [(f"n{k}", [draw.gauss(0, 1) for _ in range(4)]) for k in range(90)]
    made = index.HnswIndex("cosine", HnswConfig(shard_size=12, ef_construction=20)).build(spark.createDataFrame(rows, "id string, vector array<float>"))
    held = made.nodes.rdd.glom().map(lambda p: sorted({r["shard"] for r in p})).collect()
    assert made.shards == 8 and held == [[k] for k in range(8)]
    found = {r.id for r in made.search(rows[0][1], 5, ef=50).collect()}
    exact = sorted(rows, key=lambda r: -sum(x * y for x, y in zip(r[1], rows[0][1], strict=True)) / sum(x * x for x in r[1]) ** 0.5)[:5]
    assert found == {k for k, _ in exact}
