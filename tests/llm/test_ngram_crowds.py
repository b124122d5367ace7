"""Crowds of the n-gram join: sets with so many links that these are counted by blocks."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import ngram_join

from .test_operators import brute_classes, brute_pairs, docs_of, got_classes, got_pairs


def versions(draw: random.Random, first_id: int, count: int, length: int, changes: int) -> list[tuple]:
    base = [f"t{draw.randint(0, 10**6)}" for _ in range(length)]
    rows = []
    for k in range(count):
        words = list(base)
        for _ in range(draw.randint(0, changes)):
            words[draw.randrange(length)] = f"t{draw.randint(0, 10**6)}"
        rows.append((first_id + k, " ".join(words), "en", "a"))
    return rows


def crowded(seed: int = 11) -> list[tuple]:
    """Two crowds, one of them of several lengths, texts that share a passage with many others, and strangers."""
    draw = random.Random(seed)
    rows = versions(draw, 0, 60, 40, 10) + versions(draw, 100, 40, 70, 25)
    rows += [(k, t.rsplit(" ", draw.randint(1, 30))[0], "en", "a") for k, (_, t, _, _) in enumerate(rows[60:90], 200)]
    passage = " ".join(f"p{k}" for k in range(12))
    rows += [(300 + k, f"{passage} " + " ".join(f"t{draw.randint(0, 30)}" for _ in range(draw.randint(2, 9))), "en", "a") for k in range(60)]
    rows += [(400 + k, f"{rows[k][1]} {rows[60 + k][1]}", "en", "a") for k in range(20)]
    return rows


@pytest.mark.parametrize("threshold,crowd,block", [(0.5, 12, 600), (0.3, 3, 1000)])
def test_crowds_brute(spark, threshold, crowd, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 9)
    rows = crowded()
    df = docs_of(spark, rows)
    assert got_pairs(df, threshold=threshold) == brute_pairs(rows, threshold=threshold)
    assert got_classes(df, threshold=threshold) == brute_classes(rows, threshold=threshold)


def test_crowds_of_repeated_ids(spark, monkeypatch):
    """An id that heads several classes has one link to another class, however many of its texts link."""
    rows = [(k % 25, *r) for k, (_, *r) in enumerate(crowded()[:100])]
    pairs = lambda: Counter((r.doc_a, r.doc_b, round(r.jaccard, 9)) for r in ngram_join.similar_pairs(docs_of(spark, rows)).collect())
    usual = pairs(), got_classes(docs_of(spark, rows))
    monkeypatch.setattr(ngram_join, "CROWD", 5)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 9)
    monkeypatch.setattr(ngram_join, "SMALL", 0)
    assert (pairs(), got_classes(docs_of(spark, rows))) == usual


def test_crowds_write_no_pairs(spark, monkeypatch):
    """Versions of one text have some 25,000 links; none has a row of its own, as candidate or as link."""
    held, write = {}, ngram_join.written

    def counted(df, name):
        out = write(df, name)
        held[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    rows = versions(random.Random(2), 0, 300, 100, 3)
    found = ngram_join.ngram_jaccard_join(docs_of(spark, rows)).collect()
    assert len(found) == 300 and sum(r.n_links for r in found) > 60_000
    assert held["ngram_candidates"] < 300 and held["ngram_links"] < 300


def test_candidates_of_a_crowd_take_no_memory():
    """One task of 3,000 sets that are one crowd: no pair is held, where all 4.5 million were."""
    sets, grams = 3000, 3
    ids = np.repeat(np.arange(sets), grams)
    columns = {"ids": ids, "n": np.full(sets * grams, 50, np.int32), "pos": np.zeros(sets * grams, np.int32), "grams": np.tile(np.arange(grams, dtype=np.uint64), sets)}
    columns["crowds"] = np.stack([np.arange(sets), np.zeros(sets, np.int64)], 1)
    table = pa.table({k: pa.array([v.tobytes()], pa.binary()) for k, v in columns.items()})
    tracemalloc.start()
    found = ngram_join._candidates(0.5)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 0 and peak < 20_000_000
