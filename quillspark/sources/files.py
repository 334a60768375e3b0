"""Sources and sinks of raw records: staged files in, tables out.

There is no network here: what a crawler would fetch is read from staged files. Whole files are read by Spark, a
partition each batch of files; what is already there is found by an anti join, so a second run fetches only the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Layout of the staged tree: raw/<source>/<language>/<content type>/.../<name>.raw.json
LAYOUT = r"/raw/([^/]+)/([^/]+)/([^/]+)/(?:.*/)?([^/]+?)\.(?:raw\.)?json$"


def read_raw(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(path, source, language, content_type, name, payload) of every file below a folder, a byte-order mark removed."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("payload"))
    parts = {c: F.nullif(F.regexp_extract("path", LAYOUT, i), F.lit("")) for i, c in enumerate(("source", "language", "content_type", "name"), 1)}
    return files.withColumns(parts)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines with a given schema, and the lines that are no JSON. Blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", f"struct<{schema},_bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.filter("row is not null and row._bad is null").select("row.*").drop("_bad")
    return good, parsed.filter("row is null or row._bad is not null").select("value")


def wanted(targets: DataFrame, there: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """The targets of a crawl that are not there yet; all of them if forced."""
    return targets.dropDuplicates(keys) if force else targets.dropDuplicates(keys).join(there, keys, "left_anti")


def released(items: DataFrame, now: int, grace_days: int = 0) -> DataFrame:
    """Items without the mark of unreleased ones in a title field and without a release date beyond the grace period."""
    marked = F.upper(F.concat_ws(" ", *[c for c in ("name", "title", "chapterTitle", "route") if c in items.columns])).contains("$UNRELEASED")
    future = F.coalesce(F.expr("try_cast(release as bigint)") > now + grace_days * 86_400, F.lit(False))
    return items.filter(~marked & ~future)


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a table after insert-or-replace: new rows by key, the last of them by their order column ``seq``."""
    last = new.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("seq")))).filter("_r = 1").drop("_r")
    return old.join(last, keys, "left_anti").unionByName(last)


def append_absent(path: str, new: DataFrame, key: str) -> None:
    """Append-only table of pins: rows whose key is not there yet."""
    spark = new.sparkSession
    try:
        there = spark.read.parquet(path).select(key)
        new = new.join(there, key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.dropDuplicates([key]).write.mode("append").parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str, partition_by: tuple[str, ...] = ()) -> None:
    """One Parquet folder a table; filters on the partition columns then skip whole folders."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{name}.parquet")


def write_readable(documents: DataFrame, path: str) -> None:
    """A readable copy: JSON lines in a folder per language and content type."""
    documents.write.mode("overwrite").partitionBy("language", "content_type").json(path)
