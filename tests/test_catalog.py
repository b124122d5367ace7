import json
import os

import pytest
from pyspark.sql import functions as F

from lattica.functions.metrics import VectorizerType
from lattica.operators.embed import HashVectorizer
from lattica.operators.search import SearchRequest
from lattica.plans import config
from lattica.plans.cache import ResultCache
from lattica.sources.catalog import AlreadyExists, ContentStorage, Database, InvalidRequest, NotFound
from lattica.streaming.ingest import distinct_events, files_to_collection, vectors_to_collection


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def test_collection_life(spark, db, tmp_path):
    c = db.create("things", 3, "cosine")
    with pytest.raises(AlreadyExists):
        db.create("things", 3)
    c.insert("v1", [1, 0, 0], {"kind": "a", "n": 1})
    c.insert_batch([{"id": "v2", "vector": [0, 1, 0]}, {"id": "v3", "vector": [0, 0, 1], "metadata": {"kind": "b", "n": 3}}, {"id": "v2", "vector": [0.5, 0.5, 0], "metadata": {"kind": "a", "n": 2}}])
    assert c.count() == 3 and c.get("v2")["vector"] == [0.5, 0.5, 0.0]  # the last of a batch wins
    found = c.search([1, 0, 0], 2, include_metadata=True)
    assert [(r["id"], round(r["score"], 4)) for r in found["results"]] == [("v1", 1.0), ("v2", 0.7071)] and found["total"] == 3
    assert found["results"][0]["metadata"] == {"kind": "a", "n": 1}
    some = c.search([1, 0, 0], 5, filter={"field": "n", "operator": "gte", "value": 2})
    assert [r["id"] for r in some["results"]] == ["v2", "v3"] and some["total"] == 2
    with pytest.raises(InvalidRequest):
        c.insert_batch([{"id": "v9", "vector": [1, 1, 1]}, {"id": "bad", "vector": [1, 1]}])
    assert c.count() == 3
    c.delete("v1")
    with pytest.raises(NotFound):
        c.delete("v1")
    c.insert("v1", [0, 0, 2])
    assert c.get("v1")["vector"] == [0.0, 0.0, 2.0]
    again = Database(spark, db.root).collection("things")
    assert again.count() == 3 and again.info()["metric"] == "cosine"
    assert c.delete_where({"kind": "b"}) == 1 and c.delete_where({"kind": "b"}) == 0
    c.compact(1)
    assert c.count() == 2 and len([x for x in os.listdir(f"{db.root}/things") if x.startswith("base-")]) == 1 and not os.listdir(f"{db.root}/things/delta")
    db.backup(str(tmp_path / "copy"))
    db.drop("things")
    with pytest.raises(NotFound):
        db.collection("things")
    db.restore(str(tmp_path / "copy"))
    assert db.collection("things").count() == 2 and db.names() == ["things"] and db.stats()["total_vectors"] == 2
    assert [r.name for r in db.list().collect()] == ["things"] and db.health()["status"] == "healthy"
    db.close()
    with pytest.raises(Exception, match="closed"):
        db.names()


def test_two_handles_lose_nothing(spark, db):
    a = db.create("c", 2)
    b = Database(spark, db.root).collection("c")
    a.insert("x", [1, 0])
    b.insert("y", [0, 1])
    a.insert("y", [2, 2])
    b.delete("x")
    assert a.count() == b.count() == 1 and b.get("y")["vector"] == [2.0, 2.0]
    a.compact()
    b.insert("z", [1, 1])
    assert {r.id for r in a.rows().collect()} == {"y", "z"}


def test_a_faster_writer(spark, db, monkeypatch):
    """Another writer adds a version between the reading of the newest and the writing of the next."""
    a, b = db.create("c", 2), Database(spark, db.root).collection("c")
    add, done = a.db._add, []

    def slow(meta, root=None):
        if not done:
            done.append(1)
            b.insert("b", [0, 1])
        add(meta, root)

    monkeypatch.setattr(a.db, "_add", slow)
    a.insert("a", [1, 0])
    assert {r.id for r in a.rows().collect()} == {"a", "b"} and a.meta.version == 2


def test_a_lost_write_changes_nothing(db, monkeypatch):
    c = db.create("c", 2)
    c.insert("a", [1, 0])

    def lost(*_):
        raise OSError("the driver is gone")

    for step in ("rename", "create"):
        with monkeypatch.context() as m:
            m.setattr(db.files, step, lost)
            with pytest.raises(OSError):
                c.insert("b", [0, 1])
        assert [r.id for r in c.rows().collect()] == ["a"]
    c.insert("b", [0, 1])
    assert c.count() == 2


def test_an_insert_reads_nothing_old(db, monkeypatch):
    c = db.create("c", 2)
    c.insert("a", [1, 0])

    def read(*_):
        raise AssertionError("old rows are read")

    with monkeypatch.context() as m:
        m.setattr(type(c), "_rows", read)
        c.insert("a", [0, 1])
    assert c.get("a")["vector"] == [0.0, 1.0]


def test_texts_are_embedded_once(spark, db, tmp_path):
    log = tmp_path / "asked"

    class Counting(HashVectorizer):
        def embed(self, texts):
            with open(log, "a") as f:
                f.write("x" * len(texts))
            return super().embed(texts)

    from lattica.operators import embed

    c = db.create("t", 8, vectorizer={"type": "hash"})
    old = embed.VECTORIZERS[VectorizerType.HASH]
    embed.register_vectorizer(VectorizerType.HASH, Counting)
    try:
        c.insert_text_batch([{"id": str(k), "text": f"text {k}"} for k in range(8)])
    finally:
        embed.register_vectorizer(VectorizerType.HASH, old)
    assert c.count() == 8 and (not log.exists() or len(log.read_text()) == 8)


def test_cache_is_never_stale(db):
    c = db.create("c", 2)
    c.insert("a", [1, 0])
    assert c.search([0, 1], 1)["results"][0]["id"] == "a"
    c.search([0, 1], 1)
    assert db.cache.hits == 1
    c.insert("b", [0, 1])
    assert c.search([0, 1], 1)["results"][0]["id"] == "b"


def test_cache_rules():
    now = [0.0]
    cache = ResultCache(2, 1.0, lambda: now[0])
    key = cache.key(1, SearchRequest([1.0, 2.0, 3.0], 5))
    assert cache.get(key) is None and cache.get(key) is None
    cache.put(key, "x")
    assert cache.get(key) == cache.get(key) == "x"
    now[0] = 1.2
    assert cache.get(key) is None
    assert (cache.hits, cache.misses, cache.stats()["hit_rate"]) == (2, 3, 0.4)
    for k in "abc":
        cache.put(k, k)
    assert cache.get("a") is None and cache.get("c") == "c" and cache.evictions == 1
    assert cache.key(1, SearchRequest([1.0])) != cache.key(2, SearchRequest([1.0])) != cache.key(2, SearchRequest([1.0], 3))
    now[0] = 5
    assert cache.sweep() == 2


def test_texts_and_content(db):
    c = db.create("texts", 64, vectorizer={"type": "hash"}, content_storage=ContentStorage(max_size=200))
    c.insert_text_batch([{"id": "a", "text": "spark runs queries on clusters"}, {"id": "b", "text": "bread needs flour and water", "metadata": {"k": 1}}])
    best = c.search_text("queries on clusters", 1)["results"][0]
    assert best["id"] == "a" and best["content"] == "spark runs queries on clusters" == best["metadata"]["_content"]
    with pytest.raises(InvalidRequest):
        c.insert_text("long", "x" * 300)
    with pytest.raises(InvalidRequest):
        db.create("none", 4).insert_text("a", "b")
    with pytest.raises(InvalidRequest):
        ContentStorage(field="")
    for bad in ({"dimensions": 0}, {"dimensions": 20_000}, {"dimensions": 3, "metric": "nope"}):
        with pytest.raises(InvalidRequest):
            db.create("bad", **bad)


def test_import_json(db, tmp_path):
    p = tmp_path / "dump.json"
    p.write_text(json.dumps({"a": {"id": "a", "vector": [1, 2], "metadata": {"x": 1}}, "b": {"vector": [3, 4]}}))
    c = db.import_json("old", str(p), 2)
    assert c.count() == 2 and c.get("a")["metadata"] == {"x": 1} and c.get("b")["vector"] == [3.0, 4.0]


def test_streams(spark, db, tmp_path):
    c = db.create("s", 2)
    source = tmp_path / "in"
    schema = "id string, vector array<float>"
    spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], schema).coalesce(1).write.parquet(str(source))
    for _ in range(2):
        vectors_to_collection(spark.readStream.schema(schema).parquet(str(source)), c, str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([("b", [0.5, 1.0]), ("c", [1.0, 1.0])], schema).coalesce(1).write.mode("append").parquet(str(source))
    assert c.count() == 3 and c.get("b")["vector"] == [0.5, 1.0]
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.txt").write_text("A sentence of some length is here. " * 10)
    d = db.create("d", 16, vectorizer={"type": "hash"})
    files_to_collection(spark, str(files), d, str(tmp_path / "cp2")).awaitTermination()
    n = d.count()
    assert n >= 1
    files_to_collection(spark, str(files), d, str(tmp_path / "cp2")).awaitTermination()
    assert d.count() == n
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:20:00")], "k int, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    q = distinct_events(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), ["k"]).writeStream.format("memory").queryName("ev_out").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("ev_out").count() == 2


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"search": {"default_limit": 5}, "index": {"m": 8}}))
    c = config.load(str(p), {"LATTICA_INDEX_M": "12", "LATTICA_DATA_DIR": "/x"}, search={"default_limit": 7})
    assert (c.search.default_limit, c.index.m, c.data_dir, c.index.ef) == (7, 12, "/x", 50)
    for bad in ({"index": {"type": "tree"}}, {"processing": {"overlap": 5000}}, {"search": {"default_limit": 0}}, {"nope": 1}):
        with pytest.raises(ValueError):
            config.load(env={}, **bad)
    watcher, heard = config.Watcher(str(p)), []
    watcher.listeners.append(lambda a, b: heard.append((a.index.m, b.index.m)))
    p.write_text(json.dumps({"index": {"m": 9}}))
    watcher.reload()
    assert heard == [(8, 9)]

    def refuse(c):
        raise ValueError("no")

    watcher.validators.append(refuse)
    with pytest.raises(ValueError):
        watcher.reload()
    assert watcher.config.index.m == 9
