"""Mixture: a scarce source, with the exact total and with all tokens."""

from __future__ import annotations

from test_mixture import SIZES, TARGETS

from quillspark.llm import mixture


def test_scarce_source(spark):
    df = spark.createDataFrame([(i, "big", 100) for i in range(1000)] + [(5000 + i, "tiny", 100) for i in range(10)], SIZES)
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 2)], TARGETS)
    exact = {r.source: r for r in mixture.report(mixture.mixture(df, targets), targets).collect()}
    assert exact["big"].reached_share == exact["tiny"].reached_share == 0.5
    assert exact["big"].kept_share == 0.02 and exact["tiny"].kept_share == 1.0
    assert abs(exact["big"].kept_of_all - 30 / 1010) < 1e-9
    whole = {r.source: r for r in mixture.report(mixture.mixture(df, targets, whole=True), targets).collect()}
    assert whole["tiny"].mix_tokens == 2000 and whole["tiny"].difference < 0
    assert abs(whole["big"].mix_tokens - 50_500) <= 100 and whole["big"].kept_share > 0.5
