"""Leaves of payloads, word stems and name candidates for expanding queries, search over short texts of payloads.

Defined results: unreadable payloads have no leaves; words shorter than two characters have no stem; queries that match
nothing expand to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.text import Sql
from quillspark.operators import names, payload, search
from quillspark.operators.build import nodes_of
from quillspark.operators.nested import _read
from quillspark.session import materialize, table

#: Hits that are looked into.
LOOKED_INTO = 25
LEAVES = "record_no long, pos int, path string, kind string, value string"
#: Fields whose texts say nothing about the content.
SKIPPED = ("icon", "route", "source_url", "content_hash", "raw_id", "fetched_at", "crawler_version", "raw_format", "metadata", "params")
#: Particles of Korean and Japanese, and words that are no candidates.
KOREAN = "으로부터 으로서 에서는 에게서 까지 부터 에게 에서 으로 라고 이랑 와 과 의 은 는 이 가 을 를 에 로 도 만".split()
JAPANESE = "について から まで には では とは が を に へ の は も で と".split()
NO_CANDIDATES = "the and that this with from traveler paimon 솔직히 기억 정보 정도 자신 우리 너희 시간 역시 거야 맞아 정말 그럼 이제 아무튼 좋다".split()


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for n, text in zip(batch["record_no"], batch["payload"]):
            value = _read(text)
            if isinstance(value, (dict, list)):
                rows += [(n, pos, path, kind, x) for pos, path, _, _, kind, x in nodes_of(value) if x is not None]
        yield pd.DataFrame(rows, columns=["record_no", "pos", "path", "kind", "value"])


def leaves(records: DataFrame) -> DataFrame:
    """Every scalar of every payload with its path, in the payload's own order; nulls are left out."""
    return records.select("record_no", "payload").filter("record_no is not null").mapInPandas(_leaves, LEAVES)


def payload_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves(table(spark, sf_dir, "raw_records")).select("record_no", "path", "kind", "value")


def payload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different texts each payload has and how long they are, fields that say nothing left out."""
    skipped = F.col("path").rlike(r"\.(?:" + "|".join(SKIPPED) + r")(?:[.\[]|$)")
    rows = leaves(table(spark, sf_dir, "raw_records")).filter((F.col("kind") == "text") & ~skipped)
    rows = rows.select("record_no", T.clean_text(F.col("value")).alias("t")).filter("t <> ''").distinct()
    return rows.groupBy("record_no").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("t")).alias("n_chars"))


def _valid(c: Column) -> Column:
    key = T.normalize_alias(c)
    return F.length(key).between(2, 30) & ~key.rlike(r"^\p{Nd}+$") & ~key.isin(*NO_CANDIDATES)


def stem(c: Column, particles: list[str]) -> Column:
    """A word without up to three particles; at least two characters stay. The last valid form, null if there is none."""
    forms = [c]
    for _ in range(3):
        forms.append(F.regexp_replace(forms[-1], "^(.{2,}?)(?:" + "|".join(particles) + ")$", "$1"))
    return F.coalesce(*(F.when(_valid(f), f) for f in reversed(forms)))


def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stems of all Korean and Japanese words with the number of forms each has."""
    u = table(spark, sf_dir, "text_units").filter(F.col("language").isin("ko", "ja")).select("language", T.clean_text(F.col("text")).alias("t"))
    parts = F.when(F.col("language") == "ko", F.split("t", "[^0-9A-Za-z가-힣']+")).otherwise(F.split("t", "[^0-9A-Za-zァ-ヶー一-龯']+"))
    words = u.select("language", F.explode(parts).alias("word")).filter("word <> ''").distinct()
    stemmed = words.withColumn("stem", F.when(F.col("language") == "ko", stem(F.col("word"), KOREAN)).otherwise(stem(F.col("word"), JAPANESE)))
    return stemmed.filter("stem is not null").groupBy("language", "stem").agg(F.count(F.lit(1)).alias("n_forms"))


def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-like spans of English and Chinese units that occur at least twice."""
    u = table(spark, sf_dir, "text_units").filter(F.col("language").isin("en", "zh-Hans")).select("language", T.clean_text(F.col("text")).alias("t"))
    english = F.regexp_extract_all("t", F.lit(r"[A-Z][A-Za-z'’-]{2,}(?:\s+[A-Z][A-Za-z'’-]{2,})?"), F.lit(0))
    chinese = F.regexp_extract_all("t", F.lit("[「《]([^」》]{2,12})[」》]"), F.lit(1))
    spans = u.select("language", F.explode(F.when(F.col("language") == "en", english).otherwise(chinese)).alias("candidate"))
    return spans.groupBy("language", "candidate").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= 2) & _valid(F.col("candidate")))


def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story rows of payloads as rows of the index; unit_seq numbers them by record, section and ordinal."""
    rows = payload.story_rows(spark, sf_dir).join(table(spark, sf_dir, "raw_records").select("record_no", "language"), "record_no")
    number = F.col("record_no") * 2000 + F.when(F.col("section") == "story", 0).otherwise(1000) + F.col("ordinal")
    return rows.select(number.alias("unit_seq"), F.lit("").alias("canonical_id"), "language", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("speaker"), "text")


def short_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries against the short texts, by trigrams."""
    return search.top(search.bm25(short_texts(spark, sf_dir), search._queries(spark, sf_dir), "trigram")).select("query_id", "unit_seq", "score", "rank")


def united_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and short texts ranked together and cut to ten."""
    queries = search._queries(spark, sf_dir)
    units = search.top(search.bm25(search._units(spark, sf_dir), queries, "unicode")).select("query_id", "unit_seq", "score", F.lit("unit").alias("kind"))
    short = search.top(search.bm25(short_texts(spark, sf_dir), queries, "unicode")).select("query_id", "unit_seq", "score", F.lit("short text").alias("kind"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "kind", "unit_seq")
    return units.unionByName(short).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= search.LIMIT)


def related_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts named in a query's best units: their aliases of at least three characters contained in title and text.

    Aliases of any language and the 25 best units meet on the alias's rarest pair of characters, then containment is tested."""
    hits = search.top(search.bm25(search._units(spark, sf_dir), search._queries(spark, sf_dir), "unicode"), LOOKED_INTO).select("query_id", "unit_seq")
    units = search._units(spark, sf_dir).select("unit_seq", T.normalize_alias(F.concat_ws("\n", "title", "text")).alias("hay"))
    near = materialize(hits.join(units, "unit_seq"))
    known = names.merged(names.alias_rows(spark, sf_dir)).filter(F.length("normalized") >= 3).select("canonical_id", "normalized", "weight")
    found = search.contained(known, "normalized", near, "hay").join(near, "hay").join(known.withColumnRenamed("normalized", "needle"), "needle").withColumnRenamed("needle", "normalized")
    gain = F.col("weight") + F.least(F.length("normalized") / 6.0, F.lit(5.0))
    return found.groupBy("query_id", "canonical_id").agg(F.round(F.sum(gain), 6).alias("score"), F.count_distinct("unit_seq").alias("n_units"))


QUERIES = {"payload_leaves": payload_leaves, "payload_texts": payload_texts, "word_stems": word_stems, "name_candidates": name_candidates, "short_text_search": short_text_search, "united_search": united_search, "related_concepts": related_concepts}

_LEAVES = """WITH p AS (SELECT record_no, CASE WHEN json_valid(payload) THEN CASE WHEN left(payload, 1) = '"' THEN payload->>'$' ELSE payload END END AS j FROM raw_records),
  l AS (SELECT record_no, replace(e.fullkey, '"', '') AS path, CASE e.type WHEN 'BOOLEAN' THEN 'bool' WHEN 'VARCHAR' THEN 'text' ELSE 'number' END AS kind, e.atom->>'$' AS value
    FROM p, json_tree(j) e WHERE json_valid(j) AND e.type NOT IN ('OBJECT', 'ARRAY', 'NULL'))"""
_KEY = Sql.alias("x")
_VALID = f"(length({_KEY}) BETWEEN 2 AND 30 AND NOT regexp_matches({_KEY}, '^\\p{{Nd}}+$') AND {_KEY} NOT IN {tuple(NO_CANDIDATES)})"


def _stem_sql(particles: list[str]) -> str:
    once = lambda c: f"regexp_replace({c}, '^(.{{2,}}?)(?:{'|'.join(particles)})$', '\\1')"
    forms = ["word", once("word"), once(once("word")), once(once(once("word")))]
    return "coalesce(" + ", ".join(f"CASE WHEN {_VALID.replace(_KEY, Sql.alias(f))} THEN {f} END" for f in reversed(forms)) + ")"


_STORY = payload.ORACLE["story_rows"]
_SHORT = f"(SELECT record_no * 2000 + CASE section WHEN 'story' THEN 0 ELSE 1000 END + ordinal AS unit_seq, '' AS canonical_id, language, NULL::VARCHAR AS title, NULL::VARCHAR AS speaker, text FROM ({_STORY}) JOIN raw_records USING (record_no))"

ORACLE = {
    "payload_leaves": f"{_LEAVES} SELECT * FROM l",
    "payload_texts": rf"""{_LEAVES}, t AS (SELECT DISTINCT record_no, {Sql.clean('value')} AS t FROM l WHERE kind = 'text' AND NOT regexp_matches(path, '\.(?:{'|'.join(SKIPPED)})(?:[.\[]|$)'))
      SELECT record_no, count(*) AS n_texts, CAST(sum(length(t)) AS BIGINT) AS n_chars FROM t WHERE t <> '' GROUP BY 1""",
    "word_stems": f"""WITH w AS (SELECT DISTINCT language, unnest(CASE WHEN language = 'ko' THEN regexp_split_to_array({Sql.clean('text')}, '[^0-9A-Za-z가-힣'']+') ELSE regexp_split_to_array({Sql.clean('text')}, '[^0-9A-Za-zァ-ヶー一-龯'']+') END) AS word FROM text_units WHERE language IN ('ko', 'ja')),
      s AS (SELECT language, CASE WHEN language = 'ko' THEN {_stem_sql(KOREAN)} ELSE {_stem_sql(JAPANESE)} END AS stem FROM w WHERE word <> '') SELECT language, stem, count(*) AS n_forms FROM s WHERE stem IS NOT NULL GROUP BY ALL""",
    "name_candidates": rf"""WITH c AS (SELECT language, unnest(CASE WHEN language = 'en' THEN regexp_extract_all({Sql.clean('text')}, '[A-Z][A-Za-z''’-]{{2,}}(?:\s+[A-Z][A-Za-z''’-]{{2,}})?') ELSE regexp_extract_all({Sql.clean('text')}, '[「《]([^」》]{{2,12}})[」》]', 1) END) AS x FROM text_units WHERE language IN ('en', 'zh-Hans'))
      SELECT language, x AS candidate, count(*) AS n FROM c WHERE {_VALID} GROUP BY ALL HAVING count(*) >= 2""",
    "short_text_search": f"WITH {search._bm25_sql('trigram', 'z', search._Q, _SHORT)} SELECT {search._COLS} FROM ({search._top_sql('SELECT * FROM z')})",
    "united_search": f"""WITH {search._U}, {search._bm25_sql('unicode', 'z', search._Q, _SHORT)}, a AS (SELECT query_id, unit_seq, score, 'unit' AS kind FROM ({search._top_sql('SELECT * FROM u')}) UNION ALL SELECT query_id, unit_seq, score, 'short text' FROM ({search._top_sql('SELECT * FROM z')}))
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, unit_seq) AS rank FROM a QUALIFY rank <= 10""",
    "related_concepts": f"""WITH {search._U}, h AS ({search._top_sql('SELECT * FROM u', LOOKED_INTO)}), n AS ({names._ALIAS} SELECT * FROM merged WHERE length(normalized) >= 3),
      y AS (SELECT query_id, t.unit_seq, {Sql.alias("concat_ws(chr(10), title, text)")} AS hay FROM h JOIN text_units t USING (unit_seq))
      SELECT query_id, canonical_id, round(sum(weight + least(length(normalized) / 6.0::DOUBLE, 5.0::DOUBLE)), 6) AS score, count(DISTINCT unit_seq) AS n_units FROM y JOIN n ON contains(hay, normalized) GROUP BY 1, 2""",
}
