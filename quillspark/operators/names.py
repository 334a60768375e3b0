"""Concepts and their names: building aliases from three sources, primary names, shared names, expansion of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.text import Sql
from quillspark.operators.search import contained
from quillspark.session import table


def alias_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(canonical_id, language, name, source, weight, seq) of every usable name: alias table, titles, speakers of units."""
    a = table(spark, sf_dir, "aliases").select("canonical_id", "language", "name", F.lit("alias").alias("alias_source"), F.coalesce("weight", F.lit(0.5)).alias("weight"), F.col("row_id").alias("seq"))
    t = table(spark, sf_dir, "localizations").select("canonical_id", "language", F.col("title").alias("name"), F.lit("title").alias("alias_source"), F.lit(1.0).alias("weight"), (F.col("loc_id") + 1_000_000_000).alias("seq"))
    d = table(spark, sf_dir, "documents").select("canonical_id", "language", F.col("title").alias("name"), F.lit("document").alias("alias_source"), F.lit(0.8).alias("weight"), (F.col("doc_id") + 2_000_000_000).alias("seq"))
    rows = a.unionByName(t).unionByName(d).withColumn("name", T.clean_alias(F.col("name"))).filter("name is not null")
    return rows.withColumn("normalized", T.normalize_alias(F.col("name")))


def merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("canonical_id", "language", "normalized").agg(F.min_by("name", "seq").alias("name"), F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"), F.count_distinct("alias_source").alias("n_sources"))


def build_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (item, language, key): first name, greatest weight, counts per source."""
    return merged(alias_rows(spark, sf_dir))


def concept_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best alias of each concept in each language: by weight, then the shortest, then the first in order."""
    best = F.min_by("name", F.struct(-F.col("weight"), F.length("name"), "name")).alias("name")
    return merged(alias_rows(spark, sf_dir)).groupBy("canonical_id", "language").agg(best, F.count(F.lit(1)).alias("n_names"))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary name of each concept: the best alias of each language, Korean before English before any other."""
    order = F.struct(F.when(F.col("language") == "ko", 0).when(F.col("language") == "en", 1).otherwise(2), "language")
    return concept_names(spark, sf_dir).groupBy("canonical_id").agg(F.min_by("name", order).alias("primary_name"), F.count(F.lit(1)).alias("n_languages"))


def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that several concepts use in one language."""
    rows = merged(alias_rows(spark, sf_dir))
    return rows.groupBy("language", "normalized").agg(F.count(F.lit(1)).alias("n_concepts"), F.max("weight").alias("weight")).filter("n_concepts > 1")


def expand_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts whose names (at least two characters, of any language) a query's text contains; the queries are every
    hundredth text unit. Each name adds its weight and up to eight for its length; the best fourteen concepts stay.

    Containment is a join on the name's rarest pair of characters, then an exact test."""
    queries = table(spark, sf_dir, "text_units").filter("unit_seq % 100 = 0").select("unit_seq", T.normalize_alias(F.concat_ws("\n", "speaker", "title", "text")).alias("hay"))
    names = merged(alias_rows(spark, sf_dir)).select("canonical_id", F.col("normalized").alias("needle"), "weight")
    hits = contained(names, "needle", queries, "hay").join(queries, "hay").join(names, "needle")
    per = hits.groupBy("unit_seq", "canonical_id").agg(F.round(F.sum(F.col("weight") + F.least(F.length("needle") / 4.0, F.lit(8.0))), 6).alias("score"))
    ranked = per.withColumn("rank", F.row_number().over(W.partitionBy("unit_seq").orderBy(F.desc("score"), "canonical_id")))
    return ranked.filter("rank <= 14").select("unit_seq", "canonical_id", "score", "rank")


QUERIES = {"build_aliases": build_aliases, "concept_names": concept_names, "concepts": concepts, "shared_names": shared_names, "expand_queries": expand_queries}

_ALIAS = f"""WITH src AS (
    SELECT canonical_id, language, name, 'alias' AS alias_source, coalesce(weight, 0.5) AS weight, row_id AS seq FROM aliases
    UNION ALL SELECT canonical_id, language, title, 'title', 1.0, loc_id + 1000000000 FROM localizations
    UNION ALL SELECT canonical_id, language, title, 'document', 0.8, doc_id + 2000000000 FROM documents),
  cleaned AS (SELECT canonical_id, language, {Sql.clean('name')} AS name, alias_source, weight, seq, {Sql.alias('name')} AS normalized FROM src),
  usable AS (SELECT * FROM cleaned WHERE NOT contains(name, '$UNRELEASED') AND lower(name) NOT IN ('unknown', 'none', 'null') AND length(name) <= 140 AND length(normalized) >= 2 AND NOT regexp_matches(normalized, '^\\p{{Nd}}+$')),
  merged AS (SELECT canonical_id, language, normalized, arg_min(name, seq) AS name, CAST(max(weight) AS DOUBLE) AS weight, count(*) AS n, count(DISTINCT alias_source) AS n_sources FROM usable GROUP BY ALL)"""

ORACLE = {
    "build_aliases": f"{_ALIAS} SELECT * FROM merged",
    "concept_names": f"{_ALIAS} SELECT canonical_id, language, name, count(*) OVER (PARTITION BY canonical_id, language) AS n_names FROM merged QUALIFY row_number() OVER (PARTITION BY canonical_id, language ORDER BY weight DESC, length(name), name) = 1",
    "concepts": f"""{_ALIAS}, best AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY canonical_id, language ORDER BY weight DESC, length(name), name) = 1)
      SELECT canonical_id, arg_min(name, row(CASE language WHEN 'ko' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, language)) AS primary_name, count(*) AS n_languages FROM best GROUP BY 1""",
    "shared_names": f"{_ALIAS} SELECT language, normalized, count(*) AS n_concepts, max(weight) AS weight FROM merged GROUP BY ALL HAVING count(*) > 1",
    "expand_queries": f"""{_ALIAS}, q AS (SELECT unit_seq, {Sql.alias("concat_ws(chr(10), speaker, title, text)")} AS query FROM text_units WHERE unit_seq % 100 = 0),
      hits AS (SELECT unit_seq, canonical_id, round(sum(weight + least(length(normalized) / 4.0::DOUBLE, 8.0::DOUBLE)), 6) AS score FROM q JOIN merged m ON contains(query, normalized) GROUP BY ALL)
      SELECT unit_seq, canonical_id, score, row_number() OVER (PARTITION BY unit_seq ORDER BY score DESC, canonical_id) AS rank FROM hits QUALIFY rank <= 14""",
}
