"""Ranks in slices equal those of one window, also for a hot key; intermediate tables can be released."""

from __future__ import annotations

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark import session
from quillspark.operators.ordering import ranked


def test_ranked(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc") if rng.random() < 0.9 else None, None if rng.random() < 0.02 else rng.randint(-500, 10_000), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, x long, i int")
    want = df.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("x", "i")))
    assert sorted(map(str, ranked(df, ["k"], "x", "r", "i").collect())) == sorted(map(str, want.collect()))
    assert ranked(df.limit(0), ["k"], "x", "r").count() == 0


def test_materialize_and_release(spark):
    df = session.materialize(spark.range(5))
    assert df.count() == 5 and session.release(spark) >= 1 and session.release(spark) == 0
