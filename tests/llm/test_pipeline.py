"""The pipeline against a brute-force version of every stage, and on tables without rows."""

from collections import Counter

import corpus_pipeline
import pytest

from tests.llm.test_operators import brute_mix, brute_pairs, brute_pieces, brute_values, docs_of, packed_again

from lattica.llm import packing, pii, quality, shared


def tables(spark, tmp_path, rows, labels):
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def made():
    import random

    draw = random.Random(12)
    rows, labels = [], []
    for k in range(1300):
        words = [f"w{draw.randint(0, 3000)}" for _ in range(draw.randint(1, 60))]
        bad = k % 6 == 0
        if bad:
            words = [w + "#$%" for w in words]
        rows.append((k, " ".join(words), draw.choice(["en", "de"]), f"s{draw.randint(0, 3)}"))
        labels.append((k, int(not bad), 0))
    for k in range(0, 300, 7):
        rows.append((5000 + k, rows[k][1] + " more", "en", "s1"))
    rows += [(8000, "write to bob [at] example [dot] com or five five five one two three four five six seven", "en", "s0"), (8001, None, "en", "s0"), (8002, "", None, None), (None, "a null id", "en", "s2"), (8003, rows[5][1], "en", "s3"), (8003, rows[5][1], "en", "s3")]
    rows.append((8004, " ".join(f"long{j}" for j in range(30_000)), "en", "s1"))
    return rows, labels


def brute(rows, labels):
    values = lambda t: dict(zip(quality.RULES, brute_values(t), strict=True))
    truth = {i: q for i, q, _ in labels}
    measured = [(r, values(r[1])) for r in rows]
    held = [(r[2] or "", truth[r[0]], v) for r, v in measured if r[0] in truth]
    strata = {s for s, _, _ in held}
    cuts = {}
    for s in strata:
        for rule in quality.RULES:
            good = [v[rule] for t, q, v in held if t == s and q]  # texts are distinct here
            bad = [v[rule] for t, q, v in held if t == s and not q]
            reach = lambda of: [sum(x >= g for x in of) for g in quality.GRID]  # noqa: E731, B023
            cuts[s, rule] = quality.choose_cutoff(reach(good), reach(bad), len(good), len(bad), quality.ALPHA / 4, quality.DELTA / (4 * len(strata)))
    kept = [r for r, v in measured if not any((c := cuts.get((r[2] or "", k))) is not None and v[k] >= c for k in quality.RULES)]
    assert len(kept) < len(rows)

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in brute_pairs(kept):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    single = [r for r in kept if r[0] is None or find(r[0]) == r[0]]
    again = Counter(r[0] for r in single)
    single = [r for r in single if again[r[0]] == 1] + sorted({r for r in single if again[r[0]] > 1}, key=repr)
    assert len(single) < len(kept)

    masked = [(i, pii.mask(t), lang, s) for i, t, lang, s in single]
    assert sum(a != b for a, b in zip(single, masked, strict=True)) == 1
    text = Counter({(r[0], r[1], r[3]): 1 for r in masked})
    assert len(text) == len(masked)
    of = {(i, s): t for i, t, _, s in masked}
    return Counter((i, of[i, s]) for (i, s, _), k in brute_mix(masked, {}, 1.0, 1.0).items() for _ in range(k) if of[i, s])


def test_pipeline(spark, tmp_path):
    rows, labels = made()
    sf = tables(spark, tmp_path, rows, labels)
    want = brute(rows, labels)
    before = shared.tables()
    got = corpus_pipeline.run(spark, sf).collect()
    documents = {}
    for r in sorted(got, key=lambda r: r.piece):
        documents.setdefault((r.doc_id, r.row_id), []).append(r)
    assert Counter((i, "".join(r.text for r in x)) for (i, _), x in documents.items()) == want
    sizes = {t: [(x, n) for x, n in brute_pieces(t, packing.CAPACITY)] for _, t in want if len(t) < 400}
    assert all([(r.text, r.size) for r in x] == sizes[t] for x in documents.values() if (t := "".join(r.text for r in x)) in sizes)
    for found, again in packed_again(got, packing.CAPACITY):
        assert found == again and max(map(sum, found)) <= packing.CAPACITY
    assert len(set(shared.tables()) - set(before)) < 3  # the last stage's input, and what the last stage wrote


def test_stages_keep_the_columns(spark, tmp_path):
    rows, labels = made()
    sf = tables(spark, tmp_path, rows[:50], labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


@pytest.mark.parametrize("with_labels", [True, False])
def test_pipeline_without_documents(spark, tmp_path, with_labels):
    sf = tables(spark, tmp_path, [], [(1, 1, 0)] if with_labels else [])
    assert corpus_pipeline.run(spark, sf).count() == 0
