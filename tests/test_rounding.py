"""Rounding as SQL does it."""

import math

from pyspark.sql import functions as F

from lattica.functions import metrics as M


def test_a_negative_number_rounds_to_negative_zero(spark):
    got = [r[0] for r in spark.createDataFrame([(-1e-9,), (1e-9,), (-0.0,), (-1.5e-6,), (0.1234565,), (None,)], "x double").select(M.rounded(F.col("x"))).collect()]
    assert got[3:] == [-2e-6, 0.123457, None] and [math.copysign(1, x) for x in got[:3]] == [-1, 1, -1] and got[:3] == [0, 0, 0]
