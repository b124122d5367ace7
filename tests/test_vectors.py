import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import metrics as M
from lattica.functions.filters import apply_filter, condition, typed_field
from lattica.operators import index, search
from lattica.operators.search import SearchRequest

BASIS = [("v1", [1.0, 0.0, 0.0]), ("v2", [0.0, 1.0, 0.0]), ("v3", [0.0, 0.0, 1.0]), ("v4", [0.5, 0.5, 0.0])]
ROWS = "id string, vector array<float>"


def test_metric_edges(spark):
    cases = [([0.0, 0.0], [1.0, 0.0]), ([1.0, 2.0], [1.0, 2.0]), ([1.0, 2.0], [-1.0, -2.0]), ([1e-8, 0.0], [0.0, 1e-8]), ([1e6, 1.0], [1.0, 1e6]), ([0.6, 0.8], [0.8, 0.6])]
    df = spark.createDataFrame(cases, "a array<double>, b array<double>")
    for metric in M.Metric:
        got = [r[0] for r in df.select(M.similarity(metric, F.col("a"), F.col("b"))).collect()]
        assert got == pytest.approx([M.python_similarity(metric, a, b) for a, b in cases])
        far = [r[0] for r in df.select(M.index_distance(metric, F.col("a"), F.col("b"))).collect()]
        for s, d in zip(got, far, strict=True):
            want = 1 - s if metric is M.Metric.COSINE else -s if metric is M.Metric.DOT_PRODUCT else 1 / s - 1
            assert d == pytest.approx(want, rel=1e-6, abs=1e-9)
    odd = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    r = odd.select(M.cosine(F.col("a"), F.col("b")), M.dot(F.col("a"), F.col("b")), M.euclidean(F.col("a"), F.col("b"))).first()
    assert tuple(r) == (0.0, 0.0, math.inf)
    zero = odd.select(M.normalize(F.array(F.lit(0.0), F.lit(0.0))), M.normalize(F.array(F.lit(3.0), F.lit(4.0)))).first()
    assert zero[0] == [0.0, 0.0] and zero[1] == pytest.approx([0.6, 0.8])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-100, 100), st.floats(-100, 100)), min_size=1, max_size=8))
def test_metric_properties(pairs):
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    for metric in M.Metric:
        assert M.python_similarity(metric, a, b) == pytest.approx(M.python_similarity(metric, b, a))
    assert -1 - 1e-9 <= M.python_similarity("cosine", a, b) <= 1 + 1e-9
    assert M.python_similarity("euclidean", a, a) == 1


def test_names():
    assert M.Metric.parse("Cosine") is M.Metric.parse(0) is M.Metric.parse("0") is M.Metric.COSINE
    assert M.Metric.parse("dot") is M.Metric.DOT_PRODUCT
    for bad in ("nope", 9):
        with pytest.raises(ValueError):
            M.Metric.parse(bad)
    assert M.parse_vector("[1, 2.5,-3]") == [1, 2.5, -3]
    with pytest.raises(ValueError):
        M.parse_vector("[]")


def test_search_pages_tile_the_ranking(spark):
    df = spark.createDataFrame(BASIS, ROWS)
    top = search.knn(df, SearchRequest([1.0, 0.0, 0.0], 2)).collect()
    assert [(r.id, round(r.score, 4)) for r in top] == [("v1", 1.0), ("v4", 0.7071)]
    whole = [r.id for r in search.knn(df, SearchRequest([1.0, 1.0, 1.0], 10)).collect()]
    parts = [r.id for o in range(0, 6, 2) for r in search.knn(df, SearchRequest([1.0, 1.0, 1.0], 2, o)).collect()]
    assert whole == parts == ["v4", "v1", "v2", "v3"]  # equal scores by id
    assert search.knn(df, SearchRequest([1.0, 0.0, 0.0], 2)).columns == ["id", "score"]
    for bad in ({"limit": 0}, {"offset": -1}):
        with pytest.raises(ValueError):
            search.knn(df, SearchRequest([1.0, 0.0, 0.0], **bad))
    assert [search.clamp_limit(x) for x in (None, 0, -3, 5, 5000)] == [10, 10, 10, 5, 1000]


def test_plan_is_a_top_k(spark, tmp_path):
    spark.createDataFrame([("a", [1.0, 0.0], 3), ("b", [0.0, 1.0], 4)], ROWS + ", n int").write.parquet(str(tmp_path / "t"))
    df = search.knn(spark.read.parquet(str(tmp_path / "t")), SearchRequest([1.0, 0.0], 1, filter={"n": {"gt": 3}}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(n)" in plan and "Exchange" not in plan


@pytest.mark.parametrize("metric", list(M.Metric))
def test_batch_search_equals_expressions(spark, metric):
    draw = random.Random(1)
    rows = [(k, [draw.gauss(0, 1) for _ in range(6)]) for k in range(80)] + [(80, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = [v for _, v in rows[:5]]
    fast = search.batch_search(df, list(range(5)), q, 7, metric).collect()
    slow = search.knn_join(df, spark.createDataFrame(list(enumerate(q)), "query_id bigint, query array<double>"), 7, metric).collect()
    key = lambda rows, c: {(r.query_id, r.rank): (r[c], round(r.score, 9)) for r in rows}
    assert key(fast, "id") == key(slow, "vec_id")


META = [
    {"a": 1, "s": "tech", "b": True, "t": ["x", "y"], "n": [1, 2]}, {"a": 1.0, "s": "Tech"}, {"a": "1", "b": False}, {"a": None, "s": "science"}, {}, {"a": 7.5, "o": {"p": 3}, "s": "biotech"},
]
MISSING = object()


def reference(spec, row):
    def leaf(op, name, value):
        v = row
        for part in name.split("."):
            v = v.get(part, MISSING) if isinstance(v, dict) else MISSING
        v = None if v is MISSING else v
        number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
        same = lambda x, y: (number(x) and number(y) or type(x) is type(y)) and x == y
        eq = same(v, value)
        if op == "eq":
            return eq
        if op == "ne":
            return not eq
        if op == "exists":
            return (v is not None) == (value is None or bool(value))
        if op in ("in", "not_in"):
            return any(same(v, x) for x in value) == (op == "in")
        if op == "contains":
            return isinstance(v, str) and isinstance(value, str) and value in v or isinstance(v, list) and any(same(x, value) for x in v)
        if not (number(v) and number(value) or isinstance(v, str) and isinstance(value, str)):
            return False
        return {"gt": v > value, "gte": v >= value, "lt": v < value, "lte": v <= value}[op]

    if "and" in spec:
        return all(reference(x, row) for x in spec["and"])
    if "or" in spec:
        return any(reference(x, row) for x in spec["or"])
    if "not" in spec:
        return not reference(spec["not"], row)
    if "field" in spec:
        return leaf(spec["operator"], spec["field"], spec.get("value"))
    return all(leaf("eq", k, v) for k, v in spec.items())


def specs():
    leaves = [{"field": f, "operator": op, "value": v} for f in ("a", "s", "o.p") for op in ("eq", "ne", "gt", "gte", "lt", "lte") for v in (1, 7.5, "1", "tech")]
    leaves += [{"field": f, "operator": op, "value": v} for f in ("a", "s") for op in ("in", "not_in") for v in ([1, "tech"], [7.5], [])]
    leaves += [{"field": f, "operator": "contains", "value": v} for f in ("s", "t", "n") for v in ("tech", "x", 2)]
    leaves += [{"field": f, "operator": "exists", "value": v} for f in ("a", "b", "o", "zz") for v in (True, False)] + [{"field": "b", "operator": "eq", "value": True}]
    nested = [{"and": [leaves[0], {"not": leaves[30]}]}, {"or": [leaves[3], leaves[20], {"and": []}]}, {"not": {"or": [leaves[1], leaves[7]]}}, {"s": "tech", "a": 1}, {}]
    return leaves + nested


def test_filter_truth_table(spark):
    rows = [(k, json.dumps(m)) for k, m in enumerate(META)]
    as_json = spark.createDataFrame(rows, "id int, metadata string")
    as_variant = as_json.select("id", F.parse_json("metadata").alias("metadata"))
    from lattica.functions.filters import compile_filter, resolver

    every = specs()
    for df in (as_json, as_variant):
        find = resolver(df, "metadata")
        for s in range(0, len(every), 30):
            part = every[s : s + 30]
            got = df.select("id", *[compile_filter(x, find).alias(f"f{i}") for i, x in enumerate(part)]).collect()
            for r in got:
                for i, x in enumerate(part):
                    assert r[f"f{i}"] == reference(x, META[r.id]), (x, META[r.id])


def test_filter_errors(spark):
    field = typed_field(F.col("x"), spark.range(1).schema["id"].dataType)
    for operator, value in (("like", 1), ("in", 3), ("gt", True), ("eq", {"a": 1})):
        with pytest.raises(ValueError):
            condition(field, operator, value)
    df = spark.createDataFrame([(1, {"k": "v"}), (2, None)], "id int, metadata map<string,string>")
    assert [r.id for r in apply_filter(df, {"k": "v"}, "metadata").collect()] == [1]
    assert apply_filter(df, '{"field": "id", "operator": "gte", "value": 1}', "metadata").count() == 2


def vectors(n, dims=16, seed=0):
    draw = random.Random(seed)
    return [(f"v{k:04}", [draw.gauss(0, 1) for _ in range(dims)]) for k in range(n)]


def test_flat_index(spark, tmp_path):
    flat = index.FlatIndex("euclidean").build(spark.createDataFrame(BASIS, ROWS))
    assert [r.id for r in flat.search([1.0, 0.0, 0.0], 2).collect()] == ["v1", "v4"]
    with pytest.raises(ValueError):
        flat.add(spark.createDataFrame([("v1", [0.0, 0.0, 1.0])], ROWS))
    assert flat.add(spark.createDataFrame([("v5", [0.9, 0.0, 0.0])], ROWS)).search([1.0, 0.0, 0.0], 2).collect()[1].id == "v5"
    with pytest.raises(KeyError):
        flat.delete(["nope"])
    assert flat.delete(["v5"]).search([1.0, 0.0, 0.0], 9).count() == 4
    flat.save(str(tmp_path / "flat"))
    assert index.FlatIndex.load(spark, str(tmp_path / "flat"), "euclidean", 3).search([0.0, 0.0, 1.0], 1).first().id == "v3"
    for bad in (("cosine", 3), ("euclidean", 4)):
        with pytest.raises(ValueError):
            index.FlatIndex.load(spark, str(tmp_path / "flat"), *bad)


def test_hnsw_recall_structure_and_deletion(spark, tmp_path):
    df = spark.createDataFrame(vectors(700), ROWS)
    hnsw = index.HnswIndex("cosine", index.HnswConfig(ef_construction=100, shard_size=300)).build(df).save(str(tmp_path / "hnsw"))
    nodes = hnsw.nodes.collect()
    assert len(nodes) == 700 and len({r.shard for r in nodes}) == 3
    by = {r.id: r for r in nodes}
    for shard in range(3):
        own = [r for r in nodes if r.shard == shard]
        start = max(own, key=lambda r: (r.layer, r.id)).id
        seen, todo = {start}, [start]
        while todo:
            for x in by[todo.pop()].connections[0]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        assert len(seen) == len(own)  # all reachable on the lowest layer
        for r in own:
            for layer, links in r.connections.items():
                assert all(by[x].layer >= layer and by[x].shard == shard for x in links) and layer <= r.layer
    q = [v for _, v in vectors(20, seed=99)]
    rows = spark.createDataFrame([(int(i[1:]), v) for i, v in vectors(700)], "vec_id bigint, embedding array<double>")
    exact = search.batch_search(rows, list(range(20)), q, 10).select(F.col("query_id").cast("int"), F.format_string("v%04d", "id").alias("id"))
    by_ef = [index.recall(hnsw.search_many(q, 10, ef), exact).agg(F.avg("recall")).first()[0] for ef in (10, 50)]
    assert by_ef[1] >= 0.95 and by_ef[0] <= by_ef[1]
    best = hnsw.search(q[0], 1).first().id
    assert best not in {r.id for r in hnsw.delete([best]).search(q[0], 5).collect()}
    again = index.HnswIndex.load(spark, str(tmp_path / "hnsw"), config=hnsw.config)
    assert again.search(q[0], 1).first().id == best


def test_small_indexes(spark):
    one = spark.createDataFrame(BASIS[:1], ROWS)
    assert [r.id for r in index.HnswIndex().build(one).search([0.0, 1.0, 0.0], 5).collect()] == ["v1"]
    assert [r.id for r in index.IvfIndex(clusters=4, probes=4).build(spark.createDataFrame(BASIS, ROWS)).search([1.0, 0.0, 0.0], 2).collect()] == ["v1", "v4"]
    with pytest.raises(ValueError):
        index.make_index("tree")
    with pytest.raises(ValueError):
        index.FlatIndex().build(one.union(one))


def test_ivf_probing_every_list_is_exact(spark):
    df = spark.createDataFrame(vectors(300), ROWS)
    ivf = index.IvfIndex("cosine", clusters=8, probes=8, rounds=3).build(df)
    q = vectors(1, seed=5)[0][1]
    assert ivf.search(q, 10).collect() == index.FlatIndex("cosine").build(df).search(q, 10).collect()
    assert ivf.search(q, 10, 1).count() <= 10


def test_hash_vectors_by_their_definition():
    import re
    import zlib

    from lattica.operators.embed import VectorizerConfig, make_vectorizer

    texts = ["The quick brown fox, the QUICK fox", "", "é ab a", "word " * 50]
    got = make_vectorizer(VectorizerConfig("hash", dimensions=32)).embed(texts)
    for row, text in zip(got, texts, strict=True):
        want = [0.0] * 32
        words = re.findall(r"\w+", text.lower())
        features = [("w" + w, 1.0) for w in words] + [("p" + a + " " + b, 0.5) for a, b in zip(words, words[1:])] + [("c" + w[i : i + 3], 0.3) for w in words for i in range(len(w) - 2)]
        for name, weight in features:
            want[zlib.crc32(name.encode()) % 32] += weight if zlib.adler32(name.encode()) & 1 else -weight
        size = sum(x * x for x in want) ** 0.5
        assert all(abs(x - (y / size if size else 0)) < 1e-9 for x, y in zip(row, want, strict=True))


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan", "dot_product"])
def test_knn_join_in_blocks(spark, metric):
    import random

    from lattica.operators.search import knn_join

    draw = random.Random(2)
    df = spark.createDataFrame([(k, [draw.gauss(0, 1) for _ in range(6)]) for k in range(70)], "vec_id bigint, embedding array<double>")
    asked = df.selectExpr("vec_id AS query_id", "embedding AS query")
    few, many = (sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in knn_join(df, asked, 5, metric, block=b).collect()) for b in (100, 9))
    assert few == many and len(few) == 350
