"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import build, corpus, evidence, expansion, groups, investigate, names, nested, payload, reader, search
from quillspark.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (nested, corpus, groups, names, search, reader, payload, build, expansion, investigate, evidence, sessions)


def core_queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def core_oracle() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE", {}).items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25_unicode(spark, sf_dir)
