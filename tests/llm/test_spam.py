"""Spam pages: planted cases held out from the weak labels' view, ordinary pages, edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import spam

WORDS = "river stone golden market harbor falcon quiet winter garden letter shadow morning keeper ancient bridge silver".split()
GOODS = ["Rubi Blade", "Tomo Flower", "Kade Ore"]


def sentence(rng):
    return " ".join(rng.sample(WORDS, 8)).capitalize() + rng.choice([".", ".", "!", "?"])


def pages(n=150):
    rng = random.Random(4)
    good, bad = [], []
    for _ in range(n):
        body = [sentence(rng) for _ in range(10)]
        good.append(rng.choice([" ".join(body), "\n".join(body), "\n".join(f"{rng.choice(WORDS)}: {s}" for s in body), " ".join(body[:8]) + "\n#tag #other", "\n".join(x for s in body[:5] for x in (s, body[9])), f"{body[0]} [link](https://a.example/x1) " + " ".join(body)]))
        g = rng.choice(GOODS)
        bad.append(rng.choice([
            " | ".join(f"{g} {rng.choice(['cheap', 'buy', 'sale'])}" for _ in range(50)), " ".join(f"#{g.replace(' ', '')}{rng.choice(['sale', 'best'])}" for _ in range(40)),
            "\n".join(f"{rng.choice(GOODS)} ★{i % 5} {1000 + i},00 [sale] SKU{10000 + i}" for i in range(30)), "\n".join(f"[{g}](https://shop{i}.example/go/{i}1)" for i in range(30)),
            " ".join(rng.choice([g, "cheap", "buy", "online"]) for _ in range(120)), body[0] + "\n" + ", ".join(rng.choice([g, "cheap", "guide", "sale"]) for _ in range(100)),
        ]))
    return good, bad


@pytest.fixture(scope="module")
def scores(spark):
    good, bad = pages()
    rows = [(i, t, "a.example") for i, t in enumerate(good)] + [(1000 + i, t, None) for i, t in enumerate(bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    return {r.doc_id: r.score for r in spam.smoothed(spam.judged(df)).collect()}


def test_held_out_accuracy(scores):
    good = [s for k, s in scores.items() if k < 1000]
    bad = [s for k, s in scores.items() if k >= 1000]
    assert sum(s <= 0.5 for s in good) >= 0.97 * len(good) and sum(s > 0.5 for s in bad) >= 0.95 * len(bad)


def test_hosts_move_scores(spark):
    rows = [(i, "bad", 0.9) for i in range(200)] + [(300 + i, "good", 0.1) for i in range(200)] + [(1, "bad", 0.5), (2, "good", 0.5), (3, None, 0.5)]
    got = {(r.doc_id, r.host): r.score for r in spam.smoothed(spark.createDataFrame(rows, "doc_id long, host string, p double")).filter("p = 0.5").collect()}
    assert got[(1, "bad")] > got[(3, None)] > got[(2, "good")]


def test_edges(spark):
    texts = ["", " ", "x", "\n\n", "," * 500, "가" * 5000, "http://a.example/1", "#", "[]()", "​"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, host string")
    rows = spam.with_features(df).collect()
    assert len(rows) == len(texts) and all(r[f] is not None for r in rows for f in spam.FEATURES)
    assert spam.smoothed(spam.judged(df.filter(F.lit(False)))).count() == 0


def test_long_texts(spark):
    n = 20_000
    texts = ["ab." * n, "a1." * n, "漢" * n, "a" * n, "http:" * n, "#" * n, "word " * n, "다 " * n, "a.b-" * n, "[x](" * n, "!" * n + "a", " " * n + "a", "😀a" * n]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, host string").repartition(8)
    rows = spam.with_features(df).collect()
    assert len(rows) == len(texts) and all(r[f] is not None for r in rows for f in spam.FEATURES)


def test_hot_host(spark):
    from quillspark.llm import skew

    members = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('h', id)) as host", "'x' as n")
    groups = members.groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    got = skew.join_groups(members, groups, "host", "size", "doc_id", hot_rows=100)
    assert got.columns == ["host", "doc_id", "n", "size"] and got.count() == 5000 and got.filter("size = 1667").count() == 1667
