"""Mixing sources to target weights (problem 7).

Each source gets a factor, the expected number of copies of each of its documents: target share x total / size, at most
``max_repeats``. The whole part is given to every document; the fractional part is settled by pivotal dependent
rounding: two fractional copies meet, mass moves at random from one to the other until one of them is whole, and the
remaining fraction goes on. Buckets of bounded size are settled in parallel; each hands at most one fraction to the
next level of a reduction tree, until one fraction per source is left. Within a bucket documents meet in order of size, so
what one gives up and the other takes is of like size, and the tokens of a source come close to the wanted number.

The total. The queries take all tokens of the listed sources (``whole``): a source whose limit binds gives all it may and
falls short, and the report shows the shares that result. Without ``whole`` and ``total_tokens`` the mixture has the
largest total for which every source with text still reaches its share within ``max_repeats``; a scarce source then makes
that total small. The report shows which part of each source's tokens, and of all of them, is used at least once.

Defined results
  documents without a source, or of a source that is not listed: in no target, not in the result.
  null, empty texts: no tokens, so zero copies.
  a listed source without documents: a row of the report with zero tokens.
  null or negative shares count as zero, a null max_repeats as one; a source listed twice counts once.
  rows repeated with the same doc_id and text: one document.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.encode import TOKENIZERS, token_counts
from quillspark.session import materialize, table

#: Most documents (or fractions of the level below) that are settled in one task at once.
FAN_IN = 4096
EPS = 1e-9


def plan(targets: DataFrame, sizes: DataFrame, total_tokens: float | None = None, whole: bool = False) -> list[dict]:
    """One entry per listed source (a handful): its tokens, factor and number of documents with text."""
    listed = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).filter("source is not null")
    stats = sizes.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    rows = [r.asDict() for r in listed.join(stats, "source", "left").orderBy("source").collect()]
    for r in rows:
        r["share"] = max(0.0, r["share"] or 0.0)
        r["repeats"] = max(0, 1 if r["repeats"] is None else r["repeats"])
        r["tokens"], r["n_docs"] = r["tokens"] or 0, r["n_docs"] or 0
    if whole and total_tokens is None:
        total_tokens = float(sum(r["tokens"] for r in rows))
    limits = [r["tokens"] * r["repeats"] / r["share"] for r in rows if r["tokens"] and r["share"] and r["repeats"]]
    total = total_tokens if total_tokens is not None else min(limits, default=0.0)
    for r in rows:
        r["factor"] = min(float(r["repeats"]), r["share"] * total / r["tokens"]) if r["tokens"] else 0.0
    return rows


def _settle(seed: int, level: int):
    """Pivotal rounding of one bucket: all fractions but at most one become 0 or 1."""

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        rows = bucket.sort_values(["n_tokens", "doc_id"], ascending=False, kind="stable").reset_index(drop=True)
        rng = np.random.Generator(np.random.Philox(key=[seed * 1000 + level, int(rows["doc_id"].iloc[0]) & 0xFFFFFFFF]))
        p, draws = rows["p"].to_numpy(dtype=float, copy=True), rng.random(len(rows))
        held = -1
        for k in range(len(p)):
            if p[k] < EPS or p[k] > 1 - EPS:
                p[k] = round(p[k])
                continue
            if held < 0:
                held = k
                continue
            a, b = p[held], p[k]
            if a + b < 1:
                first_wins = draws[k] * (a + b) < a
                p[held], p[k] = (a + b, 0.0) if first_wins else (0.0, a + b)
            else:
                first_wins = draws[k] * (2 - a - b) < 1 - b
                p[held], p[k] = (1.0, a + b - 1) if first_wins else (a + b - 1, 1.0)
            held = held if EPS < p[held] < 1 - EPS else k if EPS < p[k] < 1 - EPS else -1
        rows["p"] = np.where((p < EPS) | (p > 1 - EPS), np.round(p), p)
        return rows[["source", "bucket", "doc_id", "n_tokens", "base", "p"]]

    return run


SETTLED = "source string, bucket long, doc_id long, n_tokens long, base int, p double"


def _rounded(known: DataFrame, rows: list[dict], seed: int) -> DataFrame:
    """(doc_id, source, n_tokens, copies) with whole copies, for (doc_id, source, n_tokens) and each source's factor."""
    spark = known.sparkSession
    factors = spark.createDataFrame([(r["source"], float(r["factor"]), max(1, math.ceil(r["n_docs"] / FAN_IN))) for r in rows], "source string, factor double, buckets long")
    # The plan has one row per listed source; that is its bound.
    known = known.join(F.broadcast(factors), "source")
    factor = F.when(F.col("n_tokens") > 0, F.col("factor")).otherwise(0.0)
    base = F.floor(factor + EPS)
    state = known.select("source", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("buckets")).alias("bucket"), "doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), base.cast("int").alias("base"), F.greatest(F.lit(0.0), factor - base).alias("p"))
    open_, whole = state.filter(F.col("p") > EPS), [state.filter(F.col("p") <= EPS)]
    buckets = max((max(1, math.ceil(r["n_docs"] / FAN_IN)) for r in rows), default=1)
    for level in range(64):
        settled = materialize(open_.groupBy("source", "bucket").applyInPandas(_settle(seed, level), SETTLED))
        fraction = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        whole.append(settled.filter(~fraction))
        open_ = settled.filter(fraction)
        if buckets == 1:
            break
        buckets = math.ceil(buckets / FAN_IN)
        open_ = open_.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
    # The last fraction of a source becomes whole by one more draw with its own probability.
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    whole.append(open_.withColumn("p", (draw < F.col("p")).cast("double")))
    out = whole[0]
    for part in whole[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "source", "n_tokens", (F.col("base") + F.round("p").cast("int")).alias("copies"))


def mixture(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, whole: bool = False) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of every document of a listed source; ``sizes``: (doc_id, source, n_tokens)."""
    return _rounded(sizes.select("doc_id", "source", "n_tokens"), plan(targets, sizes, total_tokens, whole), seed)


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The shares really reached, a row per listed source."""
    per = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_repeats"), F.sum(F.when(F.col("copies") > 0, F.col("n_tokens")).otherwise(0)).alias("used_tokens"))
    total = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("total")).first()["total"] or 0
    listed = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = listed.join(per, "source", "left").na.fill(0, ["n_docs", "available_tokens", "mix_tokens", "n_copies", "most_repeats", "used_tokens"])
    reached = F.col("mix_tokens") / F.lit(float(total)) if total else F.lit(0.0)
    kept = F.sum("used_tokens").over(W.partitionBy()) / F.sum("available_tokens").over(W.partitionBy())
    joined = joined.withColumn("kept_share", F.when(F.col("available_tokens") > 0, F.col("used_tokens") / F.col("available_tokens")).otherwise(0.0)).withColumn("kept_of_all", F.coalesce(kept, F.lit(0.0)))
    return joined.withColumn("reached_share", reached).withColumn("difference", F.col("reached_share") - F.col("target_share"))


def _sizes(spark: SparkSession, sf_dir: str, tokenizers: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").filter("source is not null")
    counts = token_counts(documents.select("doc_id", "source", "text"), f"{tokenizers}/byte_bpe_50k.tiktoken", "source")
    return materialize(counts.select("doc_id", "source", "n_tokens"))


def p7_mixture(spark: SparkSession, sf_dir: str, total_tokens: float | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each document is used, all tokens of the listed sources in total."""
    return mixture(_sizes(spark, sf_dir, tokenizers), table(spark, sf_dir, "mix_targets"), total_tokens, whole=True)


def p7_shares(spark: SparkSession, sf_dir: str, total_tokens: float | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The report: each source's target, limit, sizes and the share it really reached."""
    targets = table(spark, sf_dir, "mix_targets")
    return report(materialize(mixture(_sizes(spark, sf_dir, tokenizers), targets, total_tokens, whole=True)), targets)


def p7_exact(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The largest mixture in which every source with text reaches its share."""
    return mixture(_sizes(spark, sf_dir, tokenizers), table(spark, sf_dir, "mix_targets"))


def p7_exact_shares(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The report of that mixture."""
    targets = table(spark, sf_dir, "mix_targets")
    return report(materialize(mixture(_sizes(spark, sf_dir, tokenizers), targets)), targets)


def p7_whole(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The mixture whose total is all tokens of the listed sources: limits bind, scarce sources fall short."""
    return mixture(_sizes(spark, sf_dir, tokenizers), table(spark, sf_dir, "mix_targets"), whole=True)


def p7_whole_shares(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The report of that mixture."""
    targets = table(spark, sf_dir, "mix_targets")
    return report(materialize(mixture(_sizes(spark, sf_dir, tokenizers), targets, whole=True)), targets)
