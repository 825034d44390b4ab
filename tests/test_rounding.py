"""Rounding against Python's round()."""

import math
import random

from pyspark.sql import functions as F

from quorumtab.functions.robust import rounded


def test_equals_python(spark):
    rng = random.Random(1)
    xs = [5e-07, 1234.0000005, 2.675, 0.5, -1e-9, 1e300, -0.0, math.inf, 5e-324, 2.0**33, 2.0**33 - 2.0**-20, 2.0**32 + 2.0**-21]
    xs += [i / 128 for i in range(-2001, 2001, 2)]  # ties in binary
    xs += [round(rng.uniform(-2000, 2000), 6) + rng.choice([5e-7, -5e-7]) for _ in range(100_000)]  # next to ties
    xs += [rng.randint(-(10**12), 10**12) / 10**6 + rng.choice([0, 5e-7]) for _ in range(100_000)]
    xs += [rng.uniform(-1, 1) * 10 ** rng.uniform(-9, 11) for _ in range(200_000)]
    xs += [math.ldexp(rng.getrandbits(53), -20 - rng.randint(0, 8)) for _ in range(100_000)]
    got = [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", rounded(F.col("x")).alias("y")).orderBy("i").toLocalIterator()]
    bad = [(x, y, round(x, 6)) for x, y in zip(xs, got) if y != (x if math.isinf(x) else round(x, 6))]
    assert not bad, (len(bad), bad[:5])


def test_null_and_nan(spark):
    got = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(rounded(F.col("x")).alias("y")).collect()
    assert got[0].y is None and math.isnan(got[1].y)
