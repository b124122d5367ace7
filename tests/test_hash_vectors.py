"""Hash vectors made for many texts at once equal the features' definition."""

import json
import random
import re
import zlib

import numpy as np

from lattica.operators import embed


def plain(text, dims):
    out = np.zeros(dims)

    def add(name, weight):
        data = name.encode()
        out[zlib.crc32(data) % dims] += weight if zlib.adler32(data) & 1 else -weight

    words = re.findall(r"\w+", text.lower())
    for w in words:
        add("w" + w, 1.0)
        for i in range(len(w) - 2):
            add("c" + w[i : i + 3], 0.3)
    for a, b in zip(words, words[1:], strict=False):
        add("p" + a + " " + b, 0.5)
    return out / (np.sqrt((out * out).sum()) or 1)


def test_hash_vectors(monkeypatch):
    draw = random.Random(4)
    letters = "abcdeéßжİ日_9"
    texts = [" ".join("".join(draw.choices(letters, k=draw.randint(1, 9))) for _ in range(draw.randint(0, 40))) for _ in range(60)]
    texts += ["", "!", "one", "x" * 300 + " " + "é" * 40_000 + " z", "same same same"]
    for dims, part in ((1, 500_000), (100, 50), (128, 500_000)):
        monkeypatch.setattr(embed, "PART", part)
        got = embed.HashVectorizer(embed.VectorizerConfig("hash", dimensions=dims)).embed(texts)
        assert np.allclose(got, [plain(t, dims) for t in texts], atol=1e-12)


def test_checksums_of_joined_words():
    words = [b"", b"a", "日本".encode(), b"x" * 1_000]
    got = embed.moved_on(np.array([zlib.crc32(a) for a in words for _ in words]), np.array([len(b) for _ in words for b in words])) ^ np.array([zlib.crc32(b) for _ in words for b in words])
    assert got.tolist() == [zlib.crc32(a + b) for a in words for b in words]


def test_ingestion_reads_a_file_once(spark):
    from lattica.sources import documents

    files = spark.createDataFrame([(f"p{k}.html", f"<title>T{k}</title><p>{'This is a sentence of some length. ' * 9}".encode()) for k in range(3)], "path string, content binary")
    df = documents.ingest(documents.process_documents(files), embed.VectorizerConfig("hash", dimensions=8), "sentence")
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted({json.loads(r.metadata)["filename"] for r in df.collect()}) == ["p0.html", "p1.html", "p2.html"]
