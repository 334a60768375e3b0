"""The ordered fold of sessions as a stream, and counts of events per window.

State per user is one small row. Events may arrive late up to the watermark; later ones are dropped by Spark, which is
the defined result. The batch form of the same fold is ``reader.session_fold``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.session import shared_dir

STATE = "turns long, last_value double, last_type string"
OUTPUT = "user_id long, turns long, last_value double, last_type string"


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Running count, last positive value and last type of a user, carried over micro-batches.

    Arrow batches are folded one by one, in any order, so a user with a third of all events is never held as a whole."""
    turns, value, kind = state.get if state.exists else (0, None, None)
    value_at = kind_at = None
    for rows in batches:
        turns += len(rows)
        if len(rows):
            at = rows.sort_values(["ts", "event_id"])
            last, positive = at.iloc[-1], at[at["value"] > 0]
            if kind_at is None or (last["ts"], last["event_id"]) > kind_at:
                kind_at, kind = (last["ts"], last["event_id"]), last["event_type"]
            if len(positive):
                best = positive.iloc[-1]
                if value_at is None or (best["ts"], best["event_id"]) > value_at:
                    value_at, value = (best["ts"], best["event_id"]), float(best["value"])
    state.update((turns, value, kind))
    yield pd.DataFrame({"user_id": [key[0]], "turns": [turns], "last_value": [value], "last_type": [kind]})


def sessions(events: DataFrame) -> DataFrame:
    """The state of each user after each batch of a stream of events."""
    return events.groupBy("user_id").applyInPandasWithState(fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type and tumbling window, with a watermark for late ones."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over all events there are now, run to its end, as a table.

    A micro-batch sends out only the windows it changed, with its number, and appends them: nothing that is there is
    written again. The last state of a window is its result. The watermark is wide enough for any event of a first run, as
    a table read as a stream may bring its rows in any order; a feed in order of time would use ``windowed``."""
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").filter("ts is not null")
    rows = windowed(stream, late="36500 days").select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

    def keep(batch: DataFrame, number: int) -> None:
        # Overwriting the folder of this number makes a repeated micro-batch harmless.
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = rows.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    out = spark.read.schema("start timestamp, event_type string, n long, total double, batch int").parquet(f"{at}/out")
    return out.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r")).select("start", "event_type", "r.n", "r.total")


QUERIES = {"event_windows": event_windows}
ORACLE = {"event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL"}
