"""Staged files, idempotent appends, replacing rows; the session fold as a stream against the batch form."""

from __future__ import annotations

import json

from conftest import GIVEN
from pyspark.sql import functions as F

from quillspark.operators import reader
from quillspark.sources import files
from quillspark.streaming import sessions


def test_raw_files(spark, tmp_path):
    for name, text in (("raw/s/en/book/detail/1.raw.json", '\ufeff{"a": 1}'), ("raw/s/ko/book/list.raw.json", "")):
        p = tmp_path / name
        p.parent.mkdir(parents=True)
        p.write_text(text, encoding="utf-8")
    rows = {(r.source, r.language, r.content_type, r.name): r.payload for r in files.read_raw(spark, str(tmp_path)).collect()}
    assert rows[("s", "en", "book", "1")] == '{"a": 1}'


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": "x"\n{"b": 2}\n')
    good, bad = files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a:long,b:long")
    assert sorted((r.a or 0, r.b or 0) for r in good.collect()) == [(0, 2), (1, 0)] and bad.count() == 1


def test_wanted_and_released(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, x string")
    there = spark.createDataFrame([(2,)], "id int")
    assert files.wanted(t, there, ["id"]).count() == 1 and files.wanted(t, there, ["id"], force=True).count() == 2
    items = spark.createDataFrame([("x", "5"), ("$unreleased y", None), ("z", "99999999"), (None, "soon")], "name string, release string")
    assert sorted(r.name or "" for r in files.released(items, now=10).collect()) == ["", "x"]


def test_replace_and_append(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 3)], "k int, v string, seq int")
    assert {(r.k, r.v) for r in files.replace_rows(old, new, ["k"]).collect()} == {(1, "a"), (2, "d"), (3, "e")}
    for _ in range(2):
        files.append_absent(str(tmp_path / "pins"), new, "k")
    assert spark.read.parquet(str(tmp_path / "pins")).count() == 2


def test_session_stream(spark, tmp_path):
    """Two batches of a stream leave the same last state as the batch fold over all rows."""
    events = spark.read.parquet(f"{GIVEN}/events.parquet")
    half = events.approxQuantile("event_id", [0.5], 0.0)[0]
    order = events.withColumn("part", (F.col("ts") > events.orderBy("ts", "event_id").collect()[events.count() // 2]["ts"]).cast("int"))
    for part in (0, 1):
        order.filter(F.col("part") == part).drop("part").coalesce(1).write.parquet(str(tmp_path / "in" / str(part)))
    assert half
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    seen: dict = {}

    def keep(batch, number):
        for r in batch.collect():
            seen[r.user_id] = (r.turns, r.last_value)

    q = sessions.sessions(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    batch = reader.session_fold(spark, GIVEN).join(events.select("event_id", "user_id"), "event_id").groupBy("user_id").agg(F.max("turn").alias("turns"), F.max_by("last_value", "turn").alias("v"))
    assert json.dumps(sorted((k, *v) for k, v in seen.items())) == json.dumps(sorted((r.user_id, r.turns, r.v) for r in batch.collect()))


def test_windowed_schema(spark):
    stream = spark.readStream.schema(spark.read.parquet(f"{GIVEN}/events.parquet").schema).parquet(f"{GIVEN}/events.parquet*")
    assert sessions.windowed(stream).isStreaming
