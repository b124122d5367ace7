"""Rows whose neighbours lie outside the radius that the dense rows set."""

import numpy as np
import pytest

from lattica.llm import ann
from tests.llm.test_operators import exact_neighbours


@pytest.mark.parametrize("noise,unit", [(0.05, ann.UNIT), (0.0, 100)])
def test_isolated_rows_get_their_neighbours(spark, noise, unit):
    draw = np.random.default_rng(2)
    dense = np.repeat(draw.normal(size=(30, 32)), 40, axis=0)
    v = np.concatenate([dense + noise * draw.normal(size=dense.shape), draw.normal(size=(60, 32))]).astype(np.float32)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest_neighbours(df, unit=unit).collect():
        got.setdefault(r.vec_id, []).append((r.neighbour, r.cosine))
    assert set(map(len, got.values())) == {10} and len(got) == len(v)
    want = exact_neighbours(v.astype(np.float64), list(range(len(v))), 10)
    for rows in (range(1200), range(1200, 1260)):
        near = sum(s >= want[i][-1][1] - 1e-5 for i in rows for _, s in got[i])
        assert near / (10 * len(rows)) >= 0.9


def test_settling_cosine():
    found = [ann.settling_cosine(64, r) for r in range(65)]
    assert found == sorted(found, reverse=True) and found[0] > 0.99 and found[64] < -0.99
