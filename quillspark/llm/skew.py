"""Joins of many rows with one row per group, where a group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot above so many rows, and is then spread over so many tasks.
HOT_ROWS, SALTS = 100_000, 64


def join_groups(members: DataFrame, groups: DataFrame, key: str, size: str, spread: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """members x groups on ``key``; ``size`` is the groups' number of members, ``spread`` the members' id.

    Only hot groups are repeated, once per salt; their keys are broadcast. There are at most (all rows / hot_rows) of
    them: 10,000 keys in a thousand million rows. All others are joined as they are."""
    hot = groups.filter(F.col(size) > hot_rows).select(key, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = members.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(F.col(size) > hot_rows, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(groups.withColumn("_salt", F.explode(salts)), [key, "_salt"], how).drop("_salt")
