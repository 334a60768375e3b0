"""Positional reads: windows, documents, parallel versions; evidence pins; audits of references; event sessions.

Windows never cross a document; missing ordinals leave a gap, repeated units appear as often as they are stored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.text import Sql
from quillspark.operators import search
from quillspark.operators.ordering import sliced
from quillspark.session import table

#: Words that mark a contrast, and those that mark a translation note.
CONTRAST = ("not", "never", "however", "but", "instead", "않", "아니", "하지만", "그러나")
BEFORE = AFTER = 1
#: Units before and after a unit that is read, and a hit that is shown with its surroundings.
WINDOW, HIT_WINDOW = 5, 3
#: Words that suggest a role for a pin; their first match decides, all else is context.
ROLES = (("counter", ("반례", "모순", "counter", "contradict", "however", "but", "아니")), ("translation_note", ("번역", "translation", "원문", "일본어", "중국어", "영어")))
SOURCE_LEVEL = "L0"


def _around(centers: DataFrame, units: DataFrame, size: int) -> DataFrame:
    """(center, unit_seq, ordinal, side) for centers (center, d, o); the ordinals wanted are listed, so a long document
    costs no more per unit than a short one."""
    wanted = centers.withColumn("ordinal", F.explode(F.sequence(F.greatest(F.lit(0), F.col("o") - size), F.col("o") + size)))
    near = units.select("document_id", "ordinal", "unit_seq").join(wanted.withColumnRenamed("d", "document_id"), ["document_id", "ordinal"])
    side = F.when(F.col("ordinal") < F.col("o"), "before").when(F.col("ordinal") > F.col("o"), "after").otherwise("center")
    return near.withColumn("side", side).drop("document_id", "o")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units around every unit: same document, ordinals from one before to one after."""
    u = table(spark, sf_dir, "text_units").filter("ordinal >= 0")
    return _around(u.select(F.col("unit_seq").alias("center"), F.col("document_id").alias("d"), F.col("ordinal").alias("o")), u, BEFORE).select("center", "unit_seq", "ordinal", "side")


def unit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units around every unit: same document, ordinals from five before to five after."""
    u = table(spark, sf_dir, "text_units").filter("ordinal >= 0")
    return _around(u.select(F.col("unit_seq").alias("center"), F.col("document_id").alias("d"), F.col("ordinal").alias("o")), u, WINDOW).select("center", "unit_seq", "ordinal", "side")


def hit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units around each hit of the stated queries: ordinals from three before to three after."""
    u = table(spark, sf_dir, "text_units").filter("ordinal >= 0")
    hits = search.top(search.bm25(search._units(spark, sf_dir), search._queries(spark, sf_dir), "unicode")).select("query_id", "unit_seq")
    centers = hits.join(u, "unit_seq").select("query_id", F.col("unit_seq").alias("center"), F.col("document_id").alias("d"), F.col("ordinal").alias("o"))
    return _around(centers, u, HIT_WINDOW).select("query_id", "center", "unit_seq", "ordinal", "side")


def window_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with how much text surrounds it; a window per document, so work grows with the text."""
    w = W.partitionBy("document_id").orderBy("ordinal").rangeBetween(-BEFORE, AFTER)
    u = table(spark, sf_dir, "text_units")
    return u.select("unit_seq", F.count(F.lit(1)).over(w).alias("n_units"), F.sum(F.length("text")).over(w).alias("n_chars"))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its units and all of them as one text, in order."""
    u = table(spark, sf_dir, "text_units")
    first = u.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "unit_seq", "text"))), lambda x: x["text"]), "\n").alias("unit_text"))
    counts = u.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_units"), F.max("ordinal").alias("last_ordinal"))
    d = table(spark, sf_dir, "documents").select("doc_id", "document_id")
    return d.join(counts, "document_id", "left").join(first, "document_id", "left").select("doc_id", F.coalesce("n_units", F.lit(0)).alias("n_units"), "last_ordinal", "unit_text")


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit of every document with its place in the document; units of equal ordinal by unit_seq."""
    u = table(spark, sf_dir, "text_units").select("document_id", "ordinal", "unit_seq", "text")
    d = table(spark, sf_dir, "documents").select("doc_id", "document_id")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("ordinal", "unit_seq"))
    return d.join(u, "document_id").select("doc_id", "ordinal", "unit_seq", place.alias("place"), "text")


def parallel_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit with its counterparts: same item, same part, same ordinal, another language.

    The first unit of each language is chosen before anything is joined, so an item with a tenth of all rows adds at most
    one row per unit and language."""
    part = F.regexp_replace("document_id", r"^((?:[^:]*:){3})[^:]*", "$1")
    u = table(spark, sf_dir, "text_units").select("unit_seq", part.alias("part"), "language", "ordinal")
    heads = u.groupBy("part", "ordinal", "language").agg(F.min("unit_seq").alias("unit_seq"))
    other = heads.select("part", "ordinal", F.col("language").alias("other_language"), F.col("unit_seq").alias("other_seq"))
    return heads.join(other, ["part", "ordinal"]).filter("language <> other_language").select("unit_seq", "other_language", "other_seq")


#: Fields of the metadata that two versions of a unit must not differ in, where both have them.
SCOPE = ("kind", "deep_kind", "deep_id", "story_id", "volume_id", "volume_index", "item_id")


def parallel_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_seq, language, other_seq): for every unit the first unit of each language with the same item, kind, ordinal and
    scope, in a document with as many units.

    Equal candidates are reduced to one before any join, so an item with a tenth of all rows forms no pairs of documents."""
    u = table(spark, sf_dir, "text_units").filter("unit_seq is not null")
    sizes = u.groupBy("document_id").agg(F.count(F.lit(1)).alias("size"))
    key = ["canonical_id", "document_kind", "ordinal", "size"]
    scope = F.struct(*(F.get_json_object("metadata_json", f"$.{k}").alias(k) for k in SCOPE))
    rows = u.select("unit_seq", "document_id", "canonical_id", "document_kind", "ordinal", "language", scope.alias("scope")).join(sizes, "document_id")
    heads = rows.filter("language is not null").groupBy(*key, "scope", "language").agg(F.min(F.struct("document_id", "unit_seq")).alias("head"))
    asked = heads.select(*key, F.col("scope").alias("asked")).distinct()
    same = F.lit(True)
    for k in SCOPE:
        same = same & F.coalesce(F.col(f"asked.{k}") == F.col(f"scope.{k}"), F.lit(True))
    found = asked.join(heads, key).filter(same).groupBy(*key, "asked", "language").agg(F.min("head").alias("head"))
    a, b = rows.withColumnRenamed("language", "own").alias("a"), found.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col("a.scope").eqNullSafe(F.col("b.asked"))]
    return a.join(b, on).select("a.unit_seq", "b.language", F.col("b.head.unit_seq").alias("other_seq"))


def missing_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and the languages in which they have no localization."""
    loc = table(spark, sf_dir, "localizations")
    items = table(spark, sf_dir, "items").select("canonical_id").distinct()
    wanted = items.withColumn("language", F.explode(F.array(*(F.lit(x) for x in ("en", "ko", "ja", "zh-Hans")))))
    return wanted.join(loc, ["canonical_id", "language"], "left_anti")


def _quoted(c: Column) -> Column:
    """A JSON string as Python's json.dumps writes it with ensure_ascii=False."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    marked = out
    for n in range(32):
        marked = F.replace(marked, F.lit(chr(n)), F.lit(json.dumps(chr(n))[1:-1]))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), marked).otherwise(out), F.lit('"'))


def unit_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pin of the whole text of every unit, with the reference's id; a unit without text cannot be pinned."""
    u = table(spark, sf_dir, "text_units").filter("length(text) > 0").select("unit_seq", "unit_id", "document_id", "canonical_id", "title", "text")
    hay = F.lower(T.clean_text(F.concat_ws("\n", "text", "title")))
    role = F.lit("context")
    for name, words in reversed(ROLES):
        said = F.lit(False)
        for word in words:
            said = said | hay.contains(word)
        role = F.when(said, name).otherwise(role)
    u = u.withColumn("role", role).withColumn("end_char", F.length("text"))
    or_null = lambda c: F.coalesce(_quoted(F.col(c)), F.lit("null"))
    key = F.concat(
        F.lit('{"document_id": '), or_null("document_id"), F.lit(', "end_char": '), F.col("end_char").cast("string"), F.lit(', "excerpt": '), _quoted(F.col("text")),
        F.lit(', "hypothesis_ids": [], "role": "'), "role", F.lit(f'", "source_level": "{SOURCE_LEVEL}", "start_char": 0, "unit_id": '), or_null("unit_id"), F.lit("}"),
    )
    return u.select("unit_seq", "document_id", "canonical_id", F.concat(F.lit("E-"), F.left(F.sha2(key, 256), F.lit(12))).alias("evidence_id"), "role", "end_char", F.col("text").alias("excerpt"))


def unit_pins_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append if absent: of the pins of all units, those whose id is not among the stored ones (every second unit's)."""
    pins = unit_pins(spark, sf_dir).select("unit_seq", "evidence_id")
    there = pins.filter("unit_seq % 2 = 0").select("evidence_id").distinct()
    return pins.join(there, "evidence_id", "left_anti").groupBy("evidence_id").agg(F.min("unit_seq").alias("unit_seq"))


def documents_of_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents pinned through any unit, or whose item is."""
    pins = unit_pins(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", "document_id", "canonical_id")
    # The keys are made distinct first: one item holds a tenth of all units.
    by_document = d.join(pins.select("document_id").distinct(), "document_id", "left_semi").select("doc_id", F.lit(1).alias("how"))
    by_item = d.join(pins.select("canonical_id").distinct(), "canonical_id", "left_semi").select("doc_id", F.lit(2).alias("how"))
    return by_document.unionByName(by_item).groupBy("doc_id").agg(F.min("how").alias("how"))


def evidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per group of evidence: contrast, stories, other; and items found in several languages."""
    low = F.lower("text")
    contrast = F.lit(False)
    for word in CONTRAST:
        contrast = contrast | low.contains(word)
    kind = F.when(contrast, "contrast").when(F.col("document_kind").isin("story", "volume"), "story").otherwise("other")
    u = table(spark, sf_dir, "text_units").withColumn("evidence", kind)
    return u.groupBy("evidence", "language").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("canonical_id").alias("n_items"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language, kind, content type and source in one pass over the documents."""
    d = table(spark, sf_dir, "documents").select("language", "document_kind", "content_type", F.coalesce("source", F.lit("unknown")).alias("source"))
    facet = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in d.columns))).alias("f")
    return d.select(facet).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


#: Child table, its key, parent table, parent's key.
REFERENCES = (
    ("text_units", "document_id", "documents", "document_id"), ("localizations", "canonical_id", "items", "canonical_id"), ("documents", "canonical_id", "items", "canonical_id"), ("aliases", "canonical_id", "items", "canonical_id"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"),
)


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose reference leads nowhere, per reference."""
    out = None
    for child, key, parent, parent_key in REFERENCES:
        c, p = table(spark, sf_dir, child).select(key), table(spark, sf_dir, parent).select(F.col(parent_key).alias(key)).distinct()
        lost = c.filter(F.col(key).isNotNull()).join(p, key, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{child}.{key}").alias("reference"), "n")
        out = lost if out is None else out.unionByName(lost)
    return out


def unit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per kind, and those without any unit, reconciled."""
    counts = table(spark, sf_dir, "text_units").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ordinal").alias("n_ordinals"))
    joined = table(spark, sf_dir, "documents").select("document_id", "document_kind").join(counts, "document_id", "left")
    return joined.groupBy("document_kind").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("n").isNull().cast("int")).alias("without_units"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_units"), F.sum(F.coalesce(F.col("n") > F.col("n_ordinals"), F.lit(False)).cast("int")).alias("with_repeats"))


def reference_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without documents and documents' items that are no items: set difference both ways."""
    i, d = table(spark, sf_dir, "items").select("canonical_id").distinct(), table(spark, sf_dir, "documents").select("canonical_id").distinct()
    return i.exceptAll(d).withColumn("side", F.lit("item only")).unionByName(d.exceptAll(i).withColumn("side", F.lit("document only")))


def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and event: running count, last positive value carried forward, last event type before.

    Events without a user belong to no session. A user with a third of all events is worked on slice by slice."""
    e = sliced(table(spark, sf_dir, "events").filter("user_id is not null").select("event_id", "user_id", "ts", "value", "event_type"), "ts")
    positive = F.when(F.col("value") > 0, F.col("value"))
    when = F.struct("ts", "event_id")
    # One row per user and slice carries what a slice leaves to those after it.
    ends = e.groupBy("user_id", "_slice").agg(F.count(F.lit(1)).alias("k"), F.max_by(positive, F.when(positive.isNotNull(), when)).alias("v"), F.max_by("event_type", when).alias("t"))
    earlier = W.partitionBy("user_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("user_id", "_slice", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("k0"), F.last("v", ignorenulls=True).over(earlier).alias("v0"), F.lag("t").over(W.partitionBy("user_id").orderBy("_slice")).alias("t0"))
    w = W.partitionBy("user_id", "_slice").orderBy("ts", "event_id")
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    at = F.row_number().over(w)
    rows = e.join(ends, ["user_id", "_slice"])
    return rows.select("event_id", (at + F.col("k0")).alias("turn"), F.coalesce(F.last(positive, ignorenulls=True).over(upto), F.col("v0")).alias("last_value"), F.when(at == 1, F.col("t0")).otherwise(F.lag("event_type").over(w)).alias("previous_type"))


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of events as rows, counted."""
    e = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))
    return e.groupBy("event_type", "name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


QUERIES = {
    "unit_windows": unit_windows, "hit_windows": hit_windows, "unit_pins": unit_pins, "unit_pins_appended": unit_pins_appended, "documents_of_pins": documents_of_pins,
    "windows": windows, "window_texts": window_texts, "read_documents": read_documents, "document_units": document_units, "parallel_units": parallel_units, "parallel_reads": parallel_reads, "missing_languages": missing_languages,
    "evidence_groups": evidence_groups, "coverage": coverage, "orphans": orphans, "unit_counts": unit_counts,
    "reference_coverage": reference_coverage, "session_fold": session_fold, "event_properties": event_properties,
}

_HAY = f"""lower({Sql.clean("concat_ws(chr(10), text, title)")})"""
_ROLE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({_HAY}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in ROLES) + " ELSE 'context' END"
_JSON = lambda c: f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"
_PINS = f"""SELECT unit_seq, document_id, canonical_id, 'E-' || left(sha256('{{"document_id": ' || {_JSON('document_id')} || ', "end_char": ' || length(text) || ', "excerpt": ' || {_JSON('text')} || ', "hypothesis_ids": [], "role": "' || role || '", "source_level": "{SOURCE_LEVEL}", "start_char": 0, "unit_id": ' || {_JSON('unit_id')} || '}}'), 12) AS evidence_id,
  role, length(text) AS end_char, text AS excerpt FROM (SELECT *, {_ROLE} AS role FROM text_units WHERE length(text) > 0)"""
_SCOPE_SQL = " AND ".join(f"coalesce(a.{k} = b.{k}, true)" for k in SCOPE)

ORACLE = {
    "unit_windows": "SELECT c.unit_seq AS center, u.unit_seq, u.ordinal, CASE WHEN u.ordinal < c.ordinal THEN 'before' WHEN u.ordinal > c.ordinal THEN 'after' ELSE 'center' END AS side FROM text_units u JOIN text_units c ON u.document_id = c.document_id AND u.ordinal BETWEEN c.ordinal - 5 AND c.ordinal + 5",
    "hit_windows": f"""WITH {search._U}, h AS (SELECT query_id, unit_seq FROM ({search._top_sql('SELECT * FROM u')}))
      SELECT query_id, c.unit_seq AS center, t.unit_seq, t.ordinal, CASE WHEN t.ordinal < c.ordinal THEN 'before' WHEN t.ordinal > c.ordinal THEN 'after' ELSE 'center' END AS side
      FROM h JOIN text_units c ON c.unit_seq = h.unit_seq JOIN text_units t ON t.document_id = c.document_id AND t.ordinal BETWEEN c.ordinal - {HIT_WINDOW} AND c.ordinal + {HIT_WINDOW}""",
    "documents_of_pins": "WITH u AS (SELECT * FROM text_units WHERE length(text) > 0) SELECT doc_id, CASE WHEN document_id IN (SELECT document_id FROM u) THEN 1 ELSE 2 END AS how FROM documents WHERE document_id IN (SELECT document_id FROM u) OR canonical_id IN (SELECT canonical_id FROM u)",
    "windows": "SELECT c.unit_seq AS center, u.unit_seq, u.ordinal, CASE WHEN u.ordinal < c.ordinal THEN 'before' WHEN u.ordinal > c.ordinal THEN 'after' ELSE 'center' END AS side FROM text_units u JOIN text_units c ON u.document_id = c.document_id AND u.ordinal BETWEEN c.ordinal - 1 AND c.ordinal + 1",
    "window_texts": "SELECT unit_seq, count(*) OVER w AS n_units, CAST(sum(length(text)) OVER w AS BIGINT) AS n_chars FROM text_units WINDOW w AS (PARTITION BY document_id ORDER BY ordinal RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
    "read_documents": """WITH r AS (SELECT document_id, text, row_number() OVER (PARTITION BY document_id ORDER BY ordinal, unit_seq) AS r FROM text_units), o AS (SELECT document_id, string_agg(text, chr(10) ORDER BY r) AS unit_text FROM r GROUP BY 1),
      c AS (SELECT document_id, count(*) AS n_units, max(ordinal) AS last_ordinal FROM text_units GROUP BY 1)
      SELECT doc_id, coalesce(n_units, 0) AS n_units, last_ordinal, unit_text FROM documents LEFT JOIN c USING (document_id) LEFT JOIN o USING (document_id)""",
    "document_units": "SELECT doc_id, ordinal, unit_seq, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, unit_seq) AS place, u.text FROM documents d JOIN text_units u USING (document_id)",
    "parallel_units": r"""WITH h AS (SELECT regexp_replace(document_id, '^((?:[^:]*:){3})[^:]*', '\1') AS part, ordinal, language, min(unit_seq) AS unit_seq FROM text_units GROUP BY ALL)
      SELECT a.unit_seq, b.language AS other_language, b.unit_seq AS other_seq FROM h a JOIN h b USING (part, ordinal) WHERE a.language <> b.language""",
    "missing_languages": "SELECT canonical_id, language FROM (SELECT DISTINCT canonical_id FROM items) CROSS JOIN (SELECT unnest(['en', 'ko', 'ja', 'zh-Hans']) AS language) EXCEPT SELECT canonical_id, language FROM localizations",
    "unit_pins": _PINS,
    "unit_pins_appended": f"WITH p AS MATERIALIZED ({_PINS}) SELECT evidence_id, min(unit_seq) AS unit_seq FROM p WHERE evidence_id NOT IN (SELECT evidence_id FROM p WHERE unit_seq % 2 = 0) GROUP BY 1",
    "parallel_reads": f"""WITH u AS (SELECT unit_seq, document_id, canonical_id, document_kind, ordinal, language, {', '.join(f"metadata_json->>'$.{k}' AS {k}" for k in SCOPE)}, count(*) OVER (PARTITION BY document_id) AS size FROM text_units),
      f AS (SELECT a.unit_seq, b.language, b.unit_seq AS other_seq, row_number() OVER (PARTITION BY a.unit_seq, b.language ORDER BY b.document_id, b.unit_seq) AS r FROM u a JOIN u b ON a.canonical_id = b.canonical_id AND a.document_kind = b.document_kind AND a.ordinal = b.ordinal AND a.size = b.size AND {_SCOPE_SQL})
      SELECT unit_seq, language, other_seq FROM f WHERE r = 1""",
    "evidence_groups": f"""SELECT CASE WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in CONTRAST)} THEN 'contrast' WHEN document_kind IN ('story', 'volume') THEN 'story' ELSE 'other' END AS evidence, language, count(*) AS n, count(DISTINCT canonical_id) AS n_items FROM text_units GROUP BY 1, 2""",
    "coverage": " UNION ALL ".join(f"SELECT '{c}' AS facet, coalesce({c}, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 2" for c in ("language", "document_kind", "content_type", "source")),
    "orphans": " UNION ALL ".join(f"SELECT '{c}.{k}' AS reference, count(*) AS n FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL)" for c, k, p, pk in REFERENCES),
    "unit_counts": """WITH c AS (SELECT document_id, count(*) AS n, count(DISTINCT ordinal) AS k FROM text_units GROUP BY 1)
      SELECT document_kind, count(*) AS n_documents, count(*) FILTER (n IS NULL) AS without_units, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_units, count(*) FILTER (n > k) AS with_repeats FROM documents LEFT JOIN c USING (document_id) GROUP BY 1""",
    "reference_coverage": "SELECT canonical_id, 'item only' AS side FROM (SELECT canonical_id FROM items EXCEPT SELECT canonical_id FROM documents) UNION ALL SELECT canonical_id, 'document only' FROM (SELECT canonical_id FROM documents EXCEPT SELECT canonical_id FROM items)",
    "session_fold": "SELECT event_id, count(*) OVER u AS turn, last_value(CASE WHEN value > 0 THEN value END IGNORE NULLS) OVER u AS last_value, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_type FROM events WHERE user_id IS NOT NULL WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "event_properties": "SELECT event_type, j.key AS name, count(*) AS n, count(DISTINCT props->>('$.\"' || j.key || '\"')) AS n_values FROM events, json_each(props) j GROUP BY 1, 2",
}
