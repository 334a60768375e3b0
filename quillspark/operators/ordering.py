"""Ranks and running values within keys of which one may hold a third of all rows.

The order column is cut into slices of about equal size, at its quantiles; ranks and running values are formed per (key, slice) and continued from
a small table with one row per key and slice. So no task sees a whole hot key, and results equal those of one window.
Rows whose order value is null come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICES = 64


def sliced(df: DataFrame, order: str) -> DataFrame:
    """Adds ``_slice``, which grows with the order column (a number or a timestamp)."""
    value = F.unix_micros(F.col(order).cast("timestamp")) if dict(df.dtypes)[order].startswith("timestamp") else F.col(order)
    # Approximate quantiles, so an outlier does not put all other rows into one slice; any cuts give the same ranks.
    cuts = df.agg(F.percentile_approx(value, [k / SLICES for k in range(1, SLICES)], 10_000).alias("cuts")).first()["cuts"] or []
    place = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < value)) if cuts else F.lit(0)
    return df.withColumn("_slice", F.when(value.isNotNull(), place).otherwise(-1))


def ranked(df: DataFrame, keys: list[str], order: str, name: str, *ties: str) -> DataFrame:
    """Adds the rank of each row within its keys, from 1, in the order of a column (then of ``ties``)."""
    cut = sliced(df, order)
    counts = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_slice").alias("_s"), before.alias("_before"))
    same: Column = cut["_slice"] == offsets["_s"]
    for k in keys:
        same = same & cut[k].eqNullSafe(offsets[f"_{k}"])
    joined = cut.join(offsets, same)
    inside = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(order, *ties))
    return joined.withColumn(name, inside + F.col("_before")).drop("_slice", "_s", "_before", *(f"_{k}" for k in keys))
