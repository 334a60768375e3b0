"""Exact-duplicate and parallel groups, data-quality counters, occurrence ids, fingerprints.

Groups are aggregated before they are shuffled; reports list the first ids and most frequent titles, the counts cover all.
Null texts count as empty texts here, as in the rule this follows; null titles count as ``<untitled>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.text import Sql
from quillspark.operators.ordering import ranked
from quillspark.session import table

#: Order of preference of the kinds when a group chooses its representative.
KIND_PRIORITY = {"detail": 10, "volume": 20, "story": 20, "readable": 25, "list": 30}


def _priority() -> Column:
    out = F.lit(50)
    for kind, rank in KIND_PRIORITY.items():
        out = F.when(F.col("document_kind") == kind, rank).otherwise(out)
    return out


def keyed(documents: DataFrame) -> DataFrame:
    """Adds key_hash (of the cleaned, folded text), group_id and the rank for choosing a representative."""
    key = F.sha2(T.normalize_for_hash(F.coalesce("text", F.lit(""))), 256)
    return documents.withColumn("key_hash", key).withColumn("group_id", F.concat_ws(":", F.lit("exact"), "language", F.left("key_hash", F.lit(20)))).withColumn("priority", _priority())


def groups_of(documents: DataFrame) -> DataFrame:
    return keyed(documents).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("document_id", F.struct("priority", "document_id")).alias("representative"), F.count_distinct("source").alias("n_sources"))


def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with the same key in one language, with their representative."""
    return groups_of(table(spark, sf_dir, "documents")).filter("n > 1")


def duplicate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unique, representative or duplicate, and of which document.

    Only the representative travels back to the members: the member side of the join is split by AQE if one group is
    hot, the group side has one row per group."""
    d = keyed(table(spark, sf_dir, "documents")).select("doc_id", "document_id", "group_id", "priority")
    groups = groups_of(table(spark, sf_dir, "documents")).select("group_id", "n", "representative")
    joined = d.join(groups, "group_id")
    status = F.when(F.col("n") == 1, "unique").when(F.col("document_id") == F.col("representative"), "representative").otherwise("duplicate")
    return joined.select("doc_id", F.when(F.col("n") > 1, F.col("group_id")).alias("group_id"), status.alias("status"), F.when(status == "duplicate", F.col("representative")).alias("duplicate_of"))


#: Category and subcategory of each content type, names of the kinds of quests, and what all others are.
CATEGORIES = {
    "avatar": ("캐릭터", None), "weapon": ("무기", None), "reliquary": ("성유물", None), "gcg": ("일곱 성인의 소환", None), "quest": ("여행 기록", None), "achievement": ("업적", None),
    "food": ("아카이브", "음식"), "material": ("아카이브", "재료"), "furniture": ("아카이브", "가구"), "furnitureSuite": ("아카이브", "가구 세트"), "namecard": ("아카이브", "명함"), "monster": ("아카이브", "생물지"), "book": ("아카이브", "서적"), "elements": ("가이드북", "원소"),
    "advanced_avatar_guide": ("보조 데이터", "고급 가이드/캐릭터"), "advanced_weapon_guide": ("보조 데이터", "고급 가이드/무기"), "advanced_reliquary_guide": ("보조 데이터", "고급 가이드/성유물"),
    "avatarCurve": ("보조 데이터", "캐릭터 성장 곡선"), "weaponCurve": ("보조 데이터", "무기 성장 곡선"), "reliquaryCurve": ("보조 데이터", "성유물 성장 곡선"), "monsterCurve": ("보조 데이터", "몬스터 성장 곡선"),
    "event": ("보조 데이터", "이벤트"), "pronoun": ("보조 데이터", "대명사"), "everything": ("보조 데이터", "전체 목록"), "manualWeapon": ("보조 데이터", "수동 무기"), "combine": ("보조 데이터", "합성"), "dailyDungeon": ("보조 데이터", "요일 던전"),
    "upgrade": ("보조 데이터", "강화 비용"), "tower": ("보조 데이터", "나선 비경"), "static_changelog": ("보조 데이터", "변경 이력"), "readable": ("보조 데이터", "읽을거리"),
}
QUESTS = {"aq": "마신 임무", "lq": "전설 임무", "eq": "이벤트 임무", "wq": "월드 임무", "iq": "일일 의뢰"}
OTHER_CATEGORY, OTHER_QUEST = "보조 데이터", "기타"


def document_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and subcategory of each document; a content type without one is its own subcategory, quests have their kind's."""
    named = F.create_map(*(F.lit(x) for kind, value in CATEGORIES.items() for x in (kind, value[0])))
    parts = F.create_map(*(F.lit(x) for kind, value in CATEGORIES.items() for x in (kind, value[1])))
    quests = F.create_map(*(F.lit(x) for pair in QUESTS.items() for x in pair))
    kind = F.col("content_type")
    quest = F.coalesce(quests[F.get_json_object("metadata_json", "$.quest_type")], F.lit(OTHER_QUEST))
    part = F.when(kind == "quest", quest).when(kind.isin(*CATEGORIES), parts[kind]).otherwise(kind)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(named[kind], F.lit(OTHER_CATEGORY)).alias("category"), part.alias("subcategory"))


def parallel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one item across languages."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("language").alias("n_languages"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"), F.count_distinct(F.coalesce("title", F.lit("<untitled>"))).alias("n_titles")).filter("n > 1")


def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(~T.is_generic_title(F.col("title")))
    return d.groupBy("language", "content_type", T.normalize_alias(F.col("title")).alias("title_key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc_id")).filter("n > 1")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per language and kind in one pass."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").groupBy("language", "document_kind").agg(
        F.count(F.lit(1)).alias("n"), count(T.strip(text) == "").alias("blank"), count(F.length(text) < 20).alias("short"), count(text.contains("<color=")).alias("marked_up"),
        count(T.is_generic_title(F.col("title"))).alias("untitled"), count(F.col("n_chars") != F.length("text")).alias("stale"), count(F.col("source").isNull()).alias("no_source"),
        count(F.col("ingested_at") > F.col("fetched_at") + F.expr("interval 7 days")).alias("late"), F.max(F.length(text)).alias("longest"),
    )


def quality_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents of each kind of flaw; the cut comes before the shuffle, so a flaw of a third of all rows is no burden."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flaws = {"blank": T.strip(text) == "", "short": F.length(text) < 20, "marked_up": text.contains("<color="), "untitled": T.is_generic_title(F.col("title")), "stale": F.col("n_chars") != F.length("text"), "no_source": F.col("source").isNull()}
    named = F.explode(F.filter(F.array(*(F.when(c, name) for name, c in flaws.items())), lambda x: x.isNotNull())).alias("flaw")
    rows = table(spark, sf_dir, "documents").filter("doc_id is not null").select(named, "doc_id")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("flaw").orderBy("doc_id"))).filter(F.col("place") <= IDS)


def occurrence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit ids made unique: an id that occurs once stays; else it gets a suffix of its content, and a number if need be."""
    u = table(spark, sf_dir, "text_units").select("unit_seq", "unit_id", F.left(F.sha2(F.concat_ws("|", "document_id", "text_hash"), 256), F.lit(12)).alias("suffix"))
    counted = u.join(u.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")), "unit_id")
    named = ranked(counted, ["unit_id", "suffix"], "unit_seq", "k").withColumn("base", F.concat_ws(":", "unit_id", F.lit("occurrence"), "suffix"))
    return named.select("unit_seq", F.when(F.col("n") == 1, F.col("unit_id")).when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws(":", "base", "k")).alias("occurrence_id"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint per source that does not depend on order: sums of row hashes add up in any tree of tasks."""
    r = table(spark, sf_dir, "raw_records").select("source", F.sha2(F.concat_ws("|", "raw_id", "content_hash"), 256).alias("h"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 7), 16, 10).cast("long"))
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("n"), part(1).alias("low"), part(8).alias("high"))


#: Order of preference of sources and kinds, and how many titles and ids a report lists.
SOURCE_PRIORITY = {"lumen_archive": 10, "lumen_readable": 20}
REPORT_KINDS = {"detail": 10, "deep": 20, "readable": 25, "list": 30}
TITLES, IDS = 20, 50


def _order(column: str, given: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for value, rank in given.items():
        out = F.when(F.col(column) == value, rank).otherwise(out)
    return out


def _report(rows: DataFrame, facets: dict[str, str]) -> DataFrame:
    """Per key of rows (key, doc_id, ...): counts of the values of each facet, the most frequent titles, the first ids.

    Values are counted before anything is ranked, and ids are cut to the first few on either side of the shuffle."""
    # Equal values are one row from here on, so a group with a third of all documents is ranked by its different values.
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("facet"), F.col(c).alias("value")) for name, c in facets.items()))).alias("f")
    counts = rows.select("key", pairs).groupBy("key", "f.facet", "f.value").agg(F.count(F.lit(1)).alias("k"))
    placed = counts.withColumn("r", F.row_number().over(W.partitionBy("key", "facet").orderBy(F.desc("k"), "value"))).filter((F.col("facet") != "titles") | (F.col("r") <= TITLES))
    entry = F.when(F.col("facet") == "titles", F.col("value")).otherwise(F.concat_ws(":", "value", "k"))
    listed = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("facet") == name, F.struct("r", entry.alias("e"))))), lambda x: x["e"]), "|").alias(name)
    lists = placed.groupBy("key").agg(*map(listed, facets))
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("doc_id"))).filter(F.col("r") <= IDS)
    ids = first.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("doc_ids"))
    return lists.join(ids, "key")


def _report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", "document_id", "canonical_id", F.coalesce("language", F.lit("und")).alias("language"), F.coalesce("title", F.lit("<untitled>")).alias("title"), F.coalesce("content_type", F.lit("unknown")).alias("content_type"), F.coalesce("source", F.lit("unknown")).alias("source"), "document_kind", "text")
    key = F.sha2(T.normalize_for_hash(F.coalesce("text", F.lit(""))), 256)
    return d.withColumn("text_hash", key).drop("text")


def duplicate_group_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group of exact copies: size, representative by source, kind and id, counts of sources and content types, its most
    frequent titles and first ids."""
    d = _report_rows(spark, sf_dir).withColumn("key", F.concat_ws(":", F.lit("exact"), "language", F.left("text_hash", F.lit(20))))
    rank = F.struct(_order("source", SOURCE_PRIORITY, 100).alias("a"), _order("document_kind", REPORT_KINDS, 50).alias("b"), F.col("document_id").alias("c"))
    groups = d.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("language").alias("language"), F.min("text_hash").alias("text_hash"), F.min_by("document_id", rank).alias("representative")).filter("n > 1")
    return groups.join(_report(d.join(groups.select("key"), "key", "left_semi"), {"sources": "source", "content_types": "content_type", "titles": "title"}), "key").withColumnRenamed("key", "group_id")


def parallel_group_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with several documents: size, counts of languages, sources and content types, titles and first ids."""
    d = _report_rows(spark, sf_dir).filter("canonical_id is not null").withColumnRenamed("canonical_id", "key")
    groups = d.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.join(_report(d.join(groups.select("key"), "key", "left_semi"), {"languages": "language", "sources": "source", "content_types": "content_type", "titles": "title"}), "key").withColumnRenamed("key", "canonical_id")


QUERIES = {
    "document_categories": document_categories, "quality_samples": quality_samples,
    "duplicate_group_reports": duplicate_group_reports, "parallel_group_reports": parallel_group_reports,
    "exact_groups": exact_groups, "duplicate_status": duplicate_status, "parallel_groups": parallel_groups, "duplicate_titles": duplicate_titles,
    "quality_report": quality_report, "occurrence_ids": occurrence_ids, "fingerprints": fingerprints,
}

_KEYED = f"""WITH k AS (SELECT *, CASE document_kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in KIND_PRIORITY.items())} ELSE 50 END AS priority,
  'exact:' || language || ':' || left(sha256({Sql.for_hash("coalesce(text, '')")}), 20) AS group_id FROM documents),
  g AS (SELECT group_id, count(*) AS n, arg_min(document_id, row(priority, document_id)) AS representative, count(DISTINCT source) AS n_sources FROM k GROUP BY group_id)"""
_GENERIC = f"(title IS NULL OR {Sql.strip('title')} IN {T.GENERIC_TITLES})"

_ROWS = f"""d AS MATERIALIZED (SELECT doc_id, document_id, canonical_id, coalesce(language, 'und') AS language, coalesce(title, '<untitled>') AS title, coalesce(content_type, 'unknown') AS content_type, coalesce(source, 'unknown') AS source, document_kind,
  sha256({Sql.for_hash("coalesce(text, '')")}) AS text_hash FROM documents WHERE doc_id IS NOT NULL)"""


def _facet_sql(name: str, column: str) -> str:
    value = "value" if name == "titles" else "value || ':' || c"
    return f"(SELECT key, string_agg({value}, '|' ORDER BY c DESC, value) AS {name} FROM (SELECT key, {column} AS value, count(*) AS c FROM k GROUP BY key, {column} QUALIFY row_number() OVER (PARTITION BY key ORDER BY c DESC, value) <= {TITLES if name == 'titles' else 1_000_000}) GROUP BY key)"


def _report_sql(facets: dict[str, str]) -> str:
    return " ".join(f"JOIN {_facet_sql(name, c)} USING (key)" for name, c in facets.items()) + f" JOIN (SELECT key, string_agg(doc_id, ',' ORDER BY doc_id) AS doc_ids FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) <= {IDS}) GROUP BY key) USING (key)"


_RANK = "row(CASE source " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in SOURCE_PRIORITY.items()) + " ELSE 100 END, CASE document_kind " + " ".join(f"WHEN '{a}' THEN {b}" for a, b in REPORT_KINDS.items()) + " ELSE 50 END, document_id)"

_FLAWS = {
    "blank": Sql.strip("coalesce(text, '')") + " = ''", "short": "length(coalesce(text, '')) < 20", "marked_up": "contains(text, '<color=')",
    "untitled": _GENERIC, "stale": "n_chars <> length(text)", "no_source": "source IS NULL",
}

ORACLE = {
    "quality_samples": "SELECT *, row_number() OVER (PARTITION BY flaw ORDER BY doc_id) AS place FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS flaw, doc_id FROM documents WHERE doc_id IS NOT NULL AND {c}" for name, c in _FLAWS.items()) + f") QUALIFY place <= {IDS}",
    "document_categories": f"""SELECT doc_id, CASE content_type {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in CATEGORIES.items())} ELSE '{OTHER_CATEGORY}' END AS category,
      CASE content_type WHEN 'quest' THEN CASE metadata_json->>'$.quest_type' {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in QUESTS.items())} ELSE '{OTHER_QUEST}' END
        {' '.join(f"WHEN '{k}' THEN " + (f"'{v[1]}'" if v[1] else 'NULL') for k, v in CATEGORIES.items() if k != 'quest')} ELSE content_type END AS subcategory FROM documents""",
    "duplicate_group_reports": f"""WITH {_ROWS}, k AS MATERIALIZED (SELECT *, 'exact:' || language || ':' || left(text_hash, 20) AS key FROM d),
      g AS (SELECT key, count(*) AS n, min(language) AS language, min(text_hash) AS text_hash, arg_min(document_id, {_RANK}) AS representative FROM k GROUP BY key HAVING count(*) > 1)
      SELECT key AS group_id, * EXCLUDE (key) FROM g {_report_sql({"sources": "source", "content_types": "content_type", "titles": "title"})}""",
    "parallel_group_reports": f"""WITH {_ROWS}, k AS MATERIALIZED (SELECT * EXCLUDE (canonical_id), canonical_id AS key FROM d WHERE canonical_id IS NOT NULL), g AS (SELECT key, count(*) AS n FROM k GROUP BY key HAVING count(*) > 1)
      SELECT key AS canonical_id, * EXCLUDE (key) FROM g {_report_sql({"languages": "language", "sources": "source", "content_types": "content_type", "titles": "title"})}""",
    "exact_groups": f"{_KEYED} SELECT * FROM g WHERE n > 1",
    "duplicate_status": f"""{_KEYED}, j AS (SELECT doc_id, group_id, n, representative, CASE WHEN n = 1 THEN 'unique' WHEN document_id = representative THEN 'representative' ELSE 'duplicate' END AS status FROM k JOIN g USING (group_id))
      SELECT doc_id, CASE WHEN n > 1 THEN group_id END AS group_id, status, CASE WHEN status = 'duplicate' THEN representative END AS duplicate_of FROM j""",
    "parallel_groups": "SELECT canonical_id, count(*) AS n, count(DISTINCT language) AS n_languages, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, count(DISTINCT coalesce(title, '<untitled>')) AS n_titles FROM documents GROUP BY 1 HAVING count(*) > 1",
    "duplicate_titles": f"SELECT language, content_type, {Sql.alias('title')} AS title_key, count(*) AS n, min(doc_id) AS first_doc_id FROM documents WHERE NOT {_GENERIC} GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "quality_report": f"""SELECT language, document_kind, count(*) AS n, count(*) FILTER ({Sql.strip("coalesce(text, '')")} = '') AS blank, count(*) FILTER (length(coalesce(text, '')) < 20) AS short, count(*) FILTER (contains(text, '<color=')) AS marked_up,
      count(*) FILTER ({_GENERIC}) AS untitled, count(*) FILTER (n_chars <> length(text)) AS stale, count(*) FILTER (source IS NULL) AS no_source, count(*) FILTER (ingested_at > fetched_at + INTERVAL 7 DAY) AS late, max(length(coalesce(text, ''))) AS longest
      FROM documents GROUP BY ALL""",
    "occurrence_ids": """WITH u AS (SELECT unit_seq, unit_id, left(sha256(document_id || '|' || text_hash), 12) AS suffix FROM text_units),
      k AS (SELECT *, count(*) OVER (PARTITION BY unit_id) AS n, row_number() OVER (PARTITION BY unit_id, suffix ORDER BY unit_seq) AS k FROM u)
      SELECT unit_seq, CASE WHEN n = 1 THEN unit_id WHEN k = 1 THEN unit_id || ':occurrence:' || suffix ELSE unit_id || ':occurrence:' || suffix || ':' || k END AS occurrence_id FROM k""",
    "fingerprints": """WITH r AS (SELECT source, sha256(concat_ws('|', raw_id, content_hash)) AS h FROM raw_records)
      SELECT source, count(*) AS n, CAST(sum(CAST('0x' || substr(h, 1, 7) AS BIGINT)) AS BIGINT) AS low, CAST(sum(CAST('0x' || substr(h, 8, 7) AS BIGINT)) AS BIGINT) AS high FROM r GROUP BY source""",
}
