"""Mixture: shares, limits, expected copies; edge cases."""

from __future__ import annotations

import random

from quillspark.llm import mixture

TARGETS = "source string, target_share double, max_repeats int"
SIZES = "doc_id long, source string, n_tokens long"


def sizes(spark, n=6000):
    rng = random.Random(1)
    rows = [(i, rng.choices(["big", "mid", "tiny"], [70, 29, 1])[0], rng.choice([0, 5, 40, 300, 900])) for i in range(n)]
    return rows, spark.createDataFrame(rows, SIZES)


def test_shares_and_limits(spark, monkeypatch):
    monkeypatch.setattr(mixture, "FAN_IN", 64)  # several levels of the tree
    rows, df = sizes(spark)
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("tiny", 0.05, 3), ("none", 0.05, 4)], TARGETS)
    mixed = mixture.mixture(df, targets)
    got = {r.doc_id: r for r in mixed.collect()}
    assert len(got) == len(rows) == mixed.count()
    limit = {"big": 1, "mid": 2, "tiny": 3}
    assert all(0 <= r.copies <= limit[r.source] and (r.n_tokens or not r.copies) for r in got.values())
    report = {r.source: r for r in mixture.report(mixed, targets).collect()}
    for source, share in (("big", 0.6), ("mid", 0.3), ("tiny", 0.05)):
        assert abs(report[source].reached_share - share / 0.95) < 0.02
    assert report["none"].mix_tokens == 0 and report["none"].n_docs == 0
    assert got == {r.doc_id: r for r in mixture.mixture(df, targets).collect()}  # the same draw every time


def test_fixed_total_caps(spark):
    rows, df = sizes(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("tiny", 0.5, 3)], TARGETS)
    per = {r.source: r for r in mixture.report(mixture.mixture(df, targets, total_tokens=500_000.0), targets).collect()}
    assert per["tiny"].most_repeats == 3 and per["tiny"].mix_tokens == 3 * per["tiny"].available_tokens
    assert abs(per["big"].mix_tokens - 250_000) < 3_000


def test_expected_copies(spark):
    """Over many seeds each document is used as often as its factor says."""
    df = spark.createDataFrame([(i, "a", 10 + i) for i in range(30)] + [(100 + i, "b", 20) for i in range(10)], SIZES)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    import pandas as pd

    total = pd.Series(0.0, index=range(30))
    bucket = pd.DataFrame({"source": "a", "bucket": 0, "doc_id": range(30), "n_tokens": range(10, 40), "base": 0, "p": 0.3})
    for seed in range(400):
        out = mixture._settle(seed, 0)(bucket)
        assert ((out["p"] > 1e-9) & (out["p"] < 1 - 1e-9)).sum() <= 1 and abs(out["p"].sum() - 9) < 1e-6
        total += out.set_index("doc_id")["p"]
    assert (abs(total / 400 - 0.3) < 0.1).all()
    assert mixture.mixture(df, targets).count() == 40


def test_empty(spark):
    none = spark.createDataFrame([], SIZES)
    targets = spark.createDataFrame([("a", None, None), (None, 0.5, 1), ("b", 0.5, 2)], TARGETS)
    assert mixture.mixture(none, targets).count() == 0
    assert mixture.report(mixture.mixture(none, targets), targets).count() == 2
    assert mixture.mixture(none, targets.limit(0)).count() == 0
