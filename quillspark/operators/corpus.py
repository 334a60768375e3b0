"""Corpus building: cleaning, units, chunks, upserts, relations, readable paths.

Each operator takes whole tables. Rows whose text is null are cleaned to null and give no units or chunks; "first" and
"last" always mean the order of the ingest key, so repeated rows have a defined winner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.text import Sql
from quillspark.operators.ordering import ranked
from quillspark.session import table

CHUNK_CHARS = 1600
#: Lines that are placed in one go.
FOLD = 256


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned length, key hash and whether the stored length is stale, per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return d.select("doc_id", F.length(T.clean_text(F.col("text"))).alias("clean_chars"), F.sha2(T.normalize_for_hash(F.col("text")), 256).alias("key_hash"), (F.col("n_chars") != F.length("text")).alias("stale"))


def unit_rows(documents: DataFrame) -> DataFrame:
    """(document_id, ordinal, speaker, text) of the units of each document; ordinals count empty units too."""
    units = documents.filter("text is not null").select("document_id", F.posexplode(T.split_units(F.col("text"))).alias("ordinal", "unit"))
    return units.select("document_id", "ordinal", T.speaker_of(F.col("unit")).alias("speaker"), T.speech_of(F.col("unit")).alias("text")).filter("text <> ''")


def split_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_rows(table(spark, sf_dir, "documents"))


def units_by_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "text_units").filter("speaker is not null")
    return units.groupBy("language", "speaker").agg(F.count(F.lit(1)).alias("n_units"), F.countDistinct("document_id").alias("n_documents"))


def unit_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that the documents give but the table lacks, and the other way round."""
    built = split_units(spark, sf_dir).join(table(spark, sf_dir, "documents").filter("document_kind <> 'page'").select("document_id"), "document_id", "left_semi")
    built = built.select(F.concat_ws(":", "document_id", F.lit("unit"), "ordinal").alias("unit_id")).distinct()
    stored = table(spark, sf_dir, "text_units").select("unit_id").distinct()
    missing = built.join(stored, "unit_id", "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(stored.join(built, "unit_id", "left_anti").withColumn("side", F.lit("extra")))


def unit_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "text_units").select("unit_seq", T.numbers_of(F.col("text")).alias("numbers"))
    return u.filter(F.size("numbers") > 0).select("unit_seq", F.array_join("numbers", ",").alias("numbers"))


def quoted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "text_units").select("unit_seq", F.posexplode(T.quoted_of(F.col("text"))).alias("place", "name"))
    return u.select("unit_seq", "place", "name")


def chunk_rows(documents: DataFrame, longest: int = CHUNK_CHARS) -> DataFrame:
    """(document_id, ordinal, text): lines packed greedily into chunks; a longer line is cut into chunks of its own.

    The fold runs over line lengths inside the row; lines are then gathered per chunk, which is bounded."""
    lines = F.filter(F.transform(F.split(F.col("text"), "\n"), T.strip), lambda x: x != "")
    docs = documents.filter("text is not null").select("document_id", lines.alias("lines"))

    def step(s: F.Column, n: F.Column) -> F.Column:
        full = s["open"] & (s["used"] + n + 1 > longest)
        closing = full | (s["open"] & (n > longest))
        chunk = s["chunk"] + closing.cast("int")
        used = F.when(full, 0).otherwise(s["used"])
        cut = n > longest
        return F.struct(
            F.when(cut, chunk + F.ceil(n / longest).cast("int")).otherwise(chunk).alias("chunk"),
            F.when(cut, 0).otherwise(used + n + 1).alias("used"), (~cut).alias("open"), F.concat(s["firsts"], F.array(chunk)).alias("firsts"),
        )

    # In blocks, as each step copies the array it adds to: a text of many lines costs its length, not its square.
    def block(s: F.Column, lengths: F.Column) -> F.Column:
        begin = F.struct(s["chunk"].alias("chunk"), s["used"].alias("used"), s["open"].alias("open"), none.alias("firsts"))
        done = F.aggregate(lengths, begin, step)
        # The fold of a block is bound to a name of its own, so that it runs once.
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["chunk"].alias("chunk"), d["used"].alias("used"), d["open"].alias("open"), F.concat(s["firsts"], F.array(d["firsts"])).alias("firsts"))), F.lit(0))

    none = F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size("lengths"), F.lit(1)) - 1) / FOLD).cast("int")), lambda k: F.slice("lengths", k * FOLD + 1, F.lit(FOLD)))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("used"), F.lit(False).alias("open"), F.array().cast("array<array<int>>").alias("firsts"))
    docs = docs.withColumn("lengths", F.transform("lines", F.length)).withColumn("blocks", blocks)
    placed = docs.withColumn("firsts", F.flatten(F.aggregate("blocks", start, block, lambda s: s["firsts"]))).drop("lengths", "blocks")
    rows = placed.select("document_id", F.posexplode(F.arrays_zip("firsts", "lines")).alias("n", "x"))
    rows = rows.select("document_id", "n", F.col("x.firsts").alias("first"), F.posexplode(T.slices(F.col("x.lines"), longest)).alias("k", "piece"))
    grouped = rows.groupBy("document_id", (F.col("first") + F.col("k")).alias("ordinal")).agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("p"))
    return grouped.select("document_id", "ordinal", F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("text"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_rows(table(spark, sf_dir, "documents"))
    return chunks.select("document_id", "ordinal", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"))


def item_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item row's rank as a number (0 if it is none), the fields of its metadata that have a value, its route without blanks."""
    given = T.without_nulls(F.from_json("metadata_json", "map<string,string>"))
    return table(spark, sf_dir, "items").select("ingest_seq", T.safe_int(F.col("item_rank"), 0).alias("item_rank"), F.array_join(F.array_sort(F.map_keys(given)), ",").alias("fields"), T.compact(F.col("route")).alias("route"))


def upsert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item: identity of the first row, first non-empty scalar fields, last metadata."""
    seq = F.col("ingest_seq")
    first_filled = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", seq)).alias(c)
    return table(spark, sf_dir, "items").groupBy("canonical_id").agg(
        *(F.min_by(c, seq).alias(c) for c in ("content_type", "item_id", "entity_type")), *(first_filled(c) for c in ("icon", "item_rank", "route", "released")),
        F.max_by("metadata_json", seq).alias("metadata_json"), F.count(F.lit(1)).alias("n_rows"),
    )


def upsert_localizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (item, language): the last one from a detail page; else the first with a title; else the first."""
    detail = F.coalesce(F.get_json_object("metadata_json", "$.kind") == "detail", F.lit(False))
    titled = F.coalesce(F.col("title") != "", F.lit(False))
    order = [F.when(detail, 0).when(titled, 1).otherwise(2), F.when(detail, -F.col("loc_id")).otherwise(F.col("loc_id"))]
    ranked = table(spark, sf_dir, "localizations").withColumn("r", F.row_number().over(W.partitionBy("canonical_id", "language").orderBy(*order)))
    return ranked.filter("r = 1").select("canonical_id", "language", "loc_id", "title", "description", "chapter_num", "chapter_title", "route", "source_url")


def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-if-absent of names by (item, language, key): the first stays."""
    rows = table(spark, sf_dir, "localizations").select("canonical_id", "language", "loc_id", "title", F.lower(T.clean_text(F.col("title"))).alias("normalized")).filter("normalized <> ''")
    return rows.groupBy("canonical_id", "language", "normalized").agg(F.min_by("title", "loc_id").alias("name"), F.min("loc_id").alias("loc_id"))


def last_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace by key: the last row of each alias_id wins."""
    fields = ("concept_id", "language", "name", "normalized", "source", "weight")
    rows = table(spark, sf_dir, "aliases").groupBy("alias_id").agg(F.max_by(F.struct("row_id", *fields), "row_id").alias("r"))
    return rows.select("alias_id", "r.row_id", *(f"r.{f}" for f in fields))


def lists_without_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List documents of items that have no detail document in that language."""
    d = table(spark, sf_dir, "documents")
    details = d.filter("document_kind = 'detail'").select("canonical_id", "language")
    return d.filter("document_kind = 'list'").join(details, ["canonical_id", "language"], "left_anti").select("doc_id", "document_id")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from items to their stories."""
    d = table(spark, sf_dir, "documents").filter(F.col("document_kind").isin("story", "volume", "avatar_stories", "avatar_quotes"))
    kind = F.when(F.col("document_kind") == "volume", "item_has_volume").otherwise("item_has_story")
    return d.select(F.concat_ws(":", kind, "canonical_id", "document_id").alias("relation_id"), F.col("canonical_id").alias("source_id"), F.col("document_id").alias("target_id"), kind.alias("relation_type"))


def readable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path per document; documents with the same path get a number from the second on, in ingest order."""
    d = table(spark, sf_dir, "documents")
    title = F.when(T.is_generic_title(F.col("title")), F.col("document_id")).otherwise(F.col("title"))
    base = F.concat_ws("/", "language", "content_type", T.safe_path(title))
    numbered = ranked(d.select("doc_id", base.alias("base")), ["base"], "doc_id", "n")
    return numbered.select("doc_id", F.when(F.col("n") > 1, F.format_string("%s (%d).json", "base", "n")).otherwise(F.concat("base", F.lit(".json"))).alias("path"))


def safe_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "aliases").select("row_id", T.safe_id(F.col("name")).alias("safe_name"), F.left(F.sha2("name", 256), F.lit(12)).alias("short_hash"))


def usable_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "aliases").select("row_id", T.clean_alias(F.col("name")).alias("alias"), T.normalize_alias(F.col("name")).alias("alias_key"), "normalized")
    return a.filter("alias is not null").select("row_id", "alias", "alias_key", (F.col("alias_key") != F.col("normalized")).alias("differs"))


QUERIES = {
    "clean_documents": clean_documents, "split_units": split_units, "units_by_speaker": units_by_speaker, "unit_differences": unit_differences, "unit_numbers": unit_numbers,
    "quoted_names": quoted_names, "chunk_documents": chunk_documents, "item_fields": item_fields, "upsert_items": upsert_items, "upsert_localizations": upsert_localizations, "entity_names": entity_names,
    "last_aliases": last_aliases, "lists_without_detail": lists_without_detail, "relations": relations, "readable_paths": readable_paths, "safe_identifiers": safe_identifiers, "usable_aliases": usable_aliases,
}

_CLEAN = Sql.clean("text")
_UNITS = f"""
  SELECT document_id, ordinal, {Sql.speaker("unit")} AS speaker, {Sql.speech("unit")} AS text
  FROM (SELECT document_id, unnest(u) AS unit, generate_subscripts(u, 1) - 1 AS ordinal FROM (SELECT document_id, {Sql.units("text")} AS u FROM documents WHERE text IS NOT NULL))"""
_TITLE = Sql.clean("CASE WHEN title IS NULL OR " + Sql.strip("title") + " IN ('', 'Other Undefined', 'undefined', 'none', 'null') THEN document_id ELSE title END")
_PATH = rf"""regexp_replace({Sql.strip(rf"regexp_replace(regexp_replace({_TITLE}, '[<>:{chr(34)}/\\|?*\n]', ' ', 'g'), '{T.WS}+', ' ', 'g')")}, '[ .]+$', '')"""
_PATH = rf"regexp_replace(left({_PATH}, 120), '[ .]+$', '')"

ORACLE = {
    "item_fields": f"""WITH j AS (SELECT *, CASE WHEN json_valid(metadata_json) THEN CAST(metadata_json AS JSON) END AS j, {Sql.strip('item_rank')} AS bare FROM items)
      SELECT ingest_seq, CASE WHEN regexp_full_match(bare, '[+-]?[0-9]{{1,18}}') THEN CAST(bare AS BIGINT) ELSE 0 END AS item_rank, CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(array_to_string(list_sort([k FOR k IN json_keys(j) IF json_type(j, '$."' || k || '"') <> 'NULL']), ','), '') END AS fields,
        regexp_replace({Sql.clean('route')}, '{T.WS}+', '', 'g') AS route FROM j""",
    "clean_documents": f"SELECT doc_id, length({_CLEAN}) AS clean_chars, sha256({Sql.for_hash('text')}) AS key_hash, n_chars <> length(text) AS stale FROM documents",
    "split_units": f"SELECT * FROM ({_UNITS}) WHERE text <> ''",
    "units_by_speaker": "SELECT language, speaker, count(*) AS n_units, count(DISTINCT document_id) AS n_documents FROM text_units WHERE speaker IS NOT NULL GROUP BY ALL",
    "unit_differences": f"""WITH built AS (SELECT DISTINCT document_id || ':unit:' || ordinal AS unit_id FROM ({_UNITS}) WHERE text <> '' AND document_id IN (SELECT document_id FROM documents WHERE document_kind <> 'page'))
      SELECT unit_id, 'missing' AS side FROM built WHERE unit_id NOT IN (SELECT unit_id FROM text_units)
      UNION ALL SELECT DISTINCT unit_id, 'extra' FROM text_units WHERE unit_id NOT IN (SELECT unit_id FROM built)""",
    "unit_numbers": r"""WITH n AS (SELECT unit_seq, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?%?') AS x FROM text_units)
      SELECT unit_seq, array_to_string([y FOR y, i IN x IF list_position(x, y) = i], ',') AS numbers FROM n WHERE len(x) > 0""",
    "quoted_names": """WITH q AS (SELECT unit_seq, list_concat(regexp_extract_all(text, '「([^」]{1,40})」', 1), regexp_extract_all(text, '"([^"]{1,40})"', 1)) AS names FROM text_units)
      SELECT unit_seq, generate_subscripts(names, 1) - 1 AS place, unnest(names) AS name FROM q""",
    "chunk_documents": f"""WITH RECURSIVE l AS (SELECT document_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT document_id, [y FOR y IN [{Sql.strip('y')} FOR y IN string_split(text, chr(10))] IF y <> ''] AS x FROM documents WHERE text IS NOT NULL)),
      f(document_id, n, first, chunk, used, open) AS (
        SELECT document_id, 0, 0, 0, 0, false FROM l WHERE n = 1
        UNION ALL
        SELECT f.document_id, l.n, c, CASE WHEN length(line) > 1600 THEN c + CAST(ceil(length(line) / 1600.0) AS INT) ELSE c END, CASE WHEN length(line) > 1600 THEN 0 ELSE u + length(line) + 1 END, length(line) <= 1600
        FROM f JOIN l ON l.document_id = f.document_id AND l.n = f.n + 1,
          LATERAL (SELECT f.chunk + CAST(f.open AND (f.used + length(line) + 1 > 1600 OR length(line) > 1600) AS INT) AS c, CASE WHEN f.open AND f.used + length(line) + 1 > 1600 THEN 0 ELSE f.used END AS u)),
      p AS (SELECT f.document_id, f.n, f.first + k AS ordinal, substr(line, CAST(k * 1600 + 1 AS BIGINT), 1600) AS piece FROM f JOIN l USING (document_id, n), LATERAL (SELECT unnest(generate_series(0, CAST(ceil(length(line) / 1600.0) AS INT) - 1)) AS k)),
      g AS (SELECT document_id, ordinal, string_agg(piece, chr(10) ORDER BY n) AS text FROM p GROUP BY ALL)
      SELECT document_id, ordinal, length(text) AS chars, sha256(text) AS text_hash FROM g""",
    "upsert_items": """SELECT canonical_id, arg_min(content_type, ingest_seq) AS content_type, arg_min(item_id, ingest_seq) AS item_id, arg_min(entity_type, ingest_seq) AS entity_type,
        arg_min(icon, ingest_seq) FILTER (icon <> '') AS icon, arg_min(item_rank, ingest_seq) FILTER (item_rank <> '') AS item_rank, arg_min(route, ingest_seq) FILTER (route <> '') AS route,
        arg_min(released, ingest_seq) FILTER (released <> '') AS released, arg_max_null(metadata_json, ingest_seq) AS metadata_json, count(*) AS n_rows FROM items GROUP BY canonical_id""",
    "upsert_localizations": """WITH k AS (SELECT *, CASE WHEN json_valid(metadata_json) THEN coalesce(metadata_json->>'$.kind' = 'detail', false) ELSE false END AS detail FROM localizations)
      SELECT canonical_id, language, loc_id, title, description, chapter_num, chapter_title, route, source_url FROM k
      QUALIFY row_number() OVER (PARTITION BY canonical_id, language ORDER BY CASE WHEN detail THEN 0 WHEN coalesce(title <> '', false) THEN 1 ELSE 2 END, CASE WHEN detail THEN -loc_id ELSE loc_id END) = 1""",
    "entity_names": f"""SELECT canonical_id, language, normalized, arg_min(title, loc_id) AS name, min(loc_id) AS loc_id
      FROM (SELECT canonical_id, language, loc_id, title, lower({Sql.clean('title')}) AS normalized FROM localizations) WHERE normalized <> '' GROUP BY ALL""",
    "last_aliases": "SELECT alias_id, row_id, concept_id, language, name, normalized, source, weight FROM aliases QUALIFY row_number() OVER (PARTITION BY alias_id ORDER BY row_id DESC) = 1",
    "lists_without_detail": "SELECT doc_id, document_id FROM documents l WHERE document_kind = 'list' AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.document_kind = 'detail' AND d.canonical_id = l.canonical_id AND d.language = l.language)",
    "relations": """SELECT k || ':' || canonical_id || ':' || document_id AS relation_id, canonical_id AS source_id, document_id AS target_id, k AS relation_type
      FROM (SELECT *, CASE WHEN document_kind = 'volume' THEN 'item_has_volume' ELSE 'item_has_story' END AS k FROM documents WHERE document_kind IN ('story', 'volume', 'avatar_stories', 'avatar_quotes'))""",
    "readable_paths": f"""WITH b AS (SELECT doc_id, language || '/' || content_type || '/' || CASE WHEN {_PATH} = '' THEN 'unknown' ELSE {_PATH} END AS base FROM documents),
      n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n FROM b)
      SELECT doc_id, CASE WHEN n > 1 THEN base || ' (' || n || ').json' ELSE base || '.json' END AS path FROM n""",
    "safe_identifiers": r"""SELECT row_id, CASE WHEN p = '' THEN 'unknown' ELSE p END AS safe_name, left(sha256(name), 12) AS short_hash
      FROM (SELECT row_id, name, regexp_replace(regexp_replace(name, '[^\p{L}\p{M}\p{N}_.\-:]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS p FROM aliases)""",
    "usable_aliases": rf"""SELECT row_id, alias, alias_key, alias_key <> normalized AS differs FROM (SELECT row_id, {Sql.clean('name')} AS alias, {Sql.alias('name')} AS alias_key, normalized FROM aliases)
      WHERE NOT contains(alias, '$UNRELEASED') AND lower(alias) NOT IN ('unknown', 'none', 'null') AND length(alias) <= 140 AND length(alias_key) >= 2 AND NOT regexp_matches(alias_key, '^\p{{Nd}}+$')""",
}
