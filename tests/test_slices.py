"""Texts are chunked and embedded a part of a batch at a time, whatever their length."""

import pyarrow as pa
from pyspark.sql import functions as F

from lattica.operators import chunking


def test_a_batch_is_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"id": list(range(6)), "text": ["a" * 6, None, "é" * 2, "b" * 30, "", "c"]})
    got = [p.column(0).to_pylist() for p in chunking.slices(batch, 1, 10)]
    assert got == [[0, 1, 2], [3], [4, 5]]
    assert [p.num_rows for p in chunking.slices(batch.slice(0, 0), 1, 10)] == [0]


def test_chunks_come_in_parts_and_keep_columns(spark, monkeypatch):
    monkeypatch.setattr(chunking, "PART_BYTES", 40)
    docs = spark.createDataFrame([(k, f"Number {k} is here. It stays.", f"t{k}") for k in range(9)] + [(9, None, "t9")], "doc_id int, text string, title string")
    for strategy in chunking.CHUNKERS:
        config = chunking.ChunkConfig(20, 4, 1)
        got = chunking.chunk_documents(docs, strategy, config, keep=["title"]).select("doc_id", "position", "content", "title").collect()
        want = [(r.doc_id, c.position, c.content, r.title) for r in docs.orderBy("doc_id").collect() if r.text for c in chunking.CHUNKERS[strategy](r.text, config)]
        assert sorted(map(tuple, got)) == sorted(want)
    assert chunking.chunk_documents(docs, "token").where(F.col("content").isNull()).count() == 0
