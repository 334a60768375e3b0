"""Evidence: excerpts and matched terms of hits, candidates and packages, window ids, references resolved, pins found, metrics.

The stated queries are the aliases whose id is divisible by 100; pins, windows and references are those of all units.

Defined results
  hits without title, speaker or text have empty ones; a query without terms matches none and is excerpted from its beginning.
  window ids that do not follow their form, and references that lead nowhere, give an error in place of a unit.
  a unit id that is stored twice means the row with the smallest unit_seq; a missing ordinal leaves a gap.
  ratios over nothing expected are 1, reciprocal ranks over nothing found 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.text import Sql
from quillspark.operators import investigate, reader, search
from quillspark.session import materialize, table

#: Characters of an excerpt, of a candidate, and units around it.
EXCERPT, CANDIDATE, AROUND = 360, 900, 1
#: What a search should reach on average.
THRESHOLDS = {"canonical_recall_at_k": 0.5, "content_type_recall": 0.5, "language_recall": 0.5, "required_fragment_recall": 0.5, "mrr": 0.25}
#: The fields of a pin that a query is looked for in.
FIELDS = ("evidence_id", "document_id", "unit_id", "section_id", "canonical_id", "title", "excerpt", "note", "language", "content_type")


def hits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits of each stated query with their units."""
    queries = search._queries(spark, sf_dir)
    hits = search.top(search.bm25(search._units(spark, sf_dir), queries, "unicode")).select("query_id", "unit_seq", "rank")
    u = table(spark, sf_dir, "text_units").select("unit_seq", "unit_id", "document_id", "canonical_id", "language", "content_type", *(F.coalesce(c, F.lit("")).alias(c) for c in search.COLUMNS))
    return hits.join(u, "unit_seq").join(queries, "query_id")


def excerpt(text: Column, terms: Column) -> Column:
    """The whole cleaned text if it is short, else a piece around the first term that it holds, else its beginning."""
    low = F.lower(text)
    first = F.get(F.filter(terms, lambda t: (t != "") & F.contains(low, t)), F.lit(0))
    start = F.greatest(F.lit(0), F.position(first, low) - 1 - EXCERPT // 2)
    return F.when(F.length(text) <= EXCERPT, text).when(first.isNotNull(), text.substr(start + 1, F.lit(EXCERPT))).otherwise(F.left(text, F.lit(EXCERPT)))


def hit_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit with a piece of its text around the first term, and the terms that its title, speaker or text hold."""
    terms = investigate.query_terms(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "normalized"))).alias("t"))
    rows = hits_of(spark, sf_dir).join(terms.select("query_id", F.transform("t", lambda t: t["normalized"]).alias("terms")), "query_id", "left")
    rows = rows.withColumn("hay", F.lower(F.concat_ws("\n", "title", "speaker", "text"))).withColumn("terms", F.coalesce("terms", F.array().cast("array<string>"))).withColumn("clean", T.clean_text(F.col("text")))
    matched = F.filter("terms", lambda t: (F.length(t) >= 2) & F.contains(F.col("hay"), t))
    return rows.select("query_id", "unit_seq", excerpt(F.col("clean"), F.col("terms")).alias("excerpt"), F.array_join(matched, "|").alias("matched"))


def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit among a query's hits once, as a candidate: excerpt, suggested role, id of the window around it."""
    first = W.partitionBy("query_id", "unit_id").orderBy("rank")
    rows = hits_of(spark, sf_dir).filter("unit_id <> ''").withColumn("r", F.row_number().over(first)).filter("r = 1").withColumn("clean", T.clean_text(F.col("text")))
    hay = F.lower(T.clean_text(F.concat_ws("\n", "query", "clean", "title")))
    role = F.lit("context")
    for name, words in reversed(reader.ROLES):
        said = F.lit(False)
        for word in words:
            said = said | hay.contains(word)
        role = F.when(said, name).otherwise(role)
    return rows.select("query_id", "rank", "unit_id", F.left("clean", F.lit(CANDIDATE)).alias("excerpt"), role.alias("role"), window_id(F.col("unit_id"), AROUND, AROUND).alias("window_id"))


def evidence_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query how many units were found, and the items found in several languages."""
    found = hits_of(spark, sf_dir).groupBy("query_id", "canonical_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("language")).alias("languages"))
    variant = F.when((F.size("languages") >= 2) & F.col("canonical_id").isNotNull(), F.concat("canonical_id", F.lit("="), F.array_join("languages", ",")))
    return found.groupBy("query_id").agg(F.sum("n").alias("n_direct"), F.count(variant).alias("n_variants"), F.array_join(F.array_sort(F.collect_list(variant)), "|").alias("variants"))


def window_id(unit_id: Column, before: int, after: int) -> Column:
    return F.concat(unit_id, F.lit(f":window:{before}:{after}"))


def parsed_window(c: Column) -> Column:
    """(unit_id, before, after, error) of a window id."""
    part = lambda n: F.regexp_extract(c, r"(?s)^(.+):window:(\d{1,9}):(\d{1,9})$", n)
    good = part(1) != ""
    return F.struct(F.when(good, part(1)).alias("unit_id"), F.when(good, part(2).cast("int")).alias("before"), F.when(good, part(3).cast("int")).alias("after"), F.when(~F.coalesce(good, F.lit(False)), "window_id_invalid").alias("error"))


def expand(windows: DataFrame, units: DataFrame) -> DataFrame:
    """(window_id, unit_seq, ordinal, side): the units of windows given by their ids; ordinals wanted are listed, so a long
    document costs no more per window than a short one."""
    asked = windows.select("window_id").distinct().select("window_id", parsed_window(F.col("window_id")).alias("p")).select("window_id", "p.*").filter("error is null")
    units = units.filter("ordinal >= 0")
    heads = units.groupBy("unit_id").agg(F.min_by(F.struct("document_id", "ordinal"), "unit_seq").alias("h"))
    centers = asked.join(heads, "unit_id").select("window_id", F.col("h.document_id").alias("document_id"), F.col("h.ordinal").alias("o"), "before", "after")
    wanted = centers.withColumn("ordinal", F.explode(F.sequence(F.greatest(F.lit(0), F.col("o") - F.col("before")), F.col("o") + F.col("after"))))
    side = F.when(F.col("ordinal") < F.col("o"), "before").when(F.col("ordinal") > F.col("o"), "after").otherwise("center")
    return wanted.join(units.select("document_id", "ordinal", "unit_seq"), ["document_id", "ordinal"]).select("window_id", "unit_seq", "ordinal", side.alias("side"))


def windows_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of the window of every unit id, three before and two after, found through the window's id."""
    u = table(spark, sf_dir, "text_units")
    return expand(u.filter("unit_id is not null").select(window_id(F.col("unit_id"), 3, 2).alias("window_id")), u)


def resolve(references: DataFrame, units: DataFrame) -> DataFrame:
    """(ref, unit_id, found_by, error) of references (ref, unit_id, document_id, ordinal): by unit id, else by document and
    ordinal; an error where a reference has neither, where its ordinal is no integer, or where no unit is there."""
    place = F.expr("try_cast(ordinal as int)")
    places = units.groupBy("document_id", F.col("ordinal").alias("place")).agg(F.min_by("unit_id", "unit_seq").alias("there"))
    rows = references.withColumn("place", place).join(places, ["document_id", "place"], "left")
    own = F.coalesce(F.col("unit_id") != "", F.lit(False))
    missing = F.col("document_id").isNull() | F.col("ordinal").isNull()
    error = F.when(own, None).when(missing, "source_reader_mapping_missing").when(F.col("place").isNull(), "source_reader_invalid_ordinal").when(F.col("there").isNull(), "source_reader_mapping_not_found")
    return rows.select("ref", F.when(own, F.col("unit_id")).when(error.isNull(), F.col("there")).alias("unit_id"), F.when(own, "unit_id").when(error.isNull(), "document_id_ordinal").alias("found_by"), error.alias("error"))


def resolved_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to all units, in turn by id, by document and ordinal, by document alone, beyond the document's end, and by an
    ordinal that is no number."""
    u = table(spark, sf_dir, "text_units").select("unit_seq", "unit_id", "document_id", "ordinal")
    turn = F.col("unit_seq") % 5
    ordinal = F.when(turn == 1, F.col("ordinal").cast("string")).when(turn == 3, (F.col("ordinal") + 1_000_000).cast("string")).when(turn == 4, "last")
    return resolve(u.select(F.col("unit_seq").alias("ref"), F.when(turn == 0, F.col("unit_id")).alias("unit_id"), "document_id", ordinal.alias("ordinal")), u)


def pin_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, unit_seq, role): the pins of all units that hold a stated query in any of their fields.

    Queries and pins meet on the query's rarest pair of characters; texts are joined to those meetings only."""
    names = table(spark, sf_dir, "text_units").select("unit_seq", "unit_id", "section_id", "title", "language", "content_type", F.lit("").alias("note"))
    pins = reader.unit_pins(spark, sf_dir).join(names, "unit_seq")
    hay = F.lower(T.clean_text(F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in FIELDS))))
    pins = materialize(pins.select("unit_seq", "role", hay.alias("hay")).distinct())
    queries = search._queries(spark, sf_dir).select("query_id", F.lower(T.clean_text(F.col("query"))).alias("needle")).filter("needle <> ''")
    pieces = F.filter(search.pairs_of("needle"), lambda x: F.length(x) == F.least(F.lit(2), F.length("needle")))
    wanted = materialize(queries.select("needle").distinct().select("needle", F.explode(pieces).alias("piece")))
    posted = pins.select("unit_seq", F.explode(search.pairs_of("hay")).alias("piece"))
    often = posted.join(wanted.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("df"))
    anchors = wanted.join(often, "piece").groupBy("needle").agg(F.min_by("piece", F.struct("df", "piece")).alias("piece"))
    met = posted.join(anchors, "piece").select("unit_seq", "needle").distinct().join(pins, "unit_seq").filter(F.contains("hay", "needle"))
    return met.select("needle", "unit_seq", "role").join(queries, "needle").select("query_id", "unit_seq", "role")


def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stated query the recall of its item, kind, language and wording among its hits, and the reciprocal rank of its item."""
    hits = hits_of(spark, sf_dir)
    kind = lambda c: F.split_part(c, F.lit(":"), F.lit(2))
    has = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("double"))
    item = F.col("canonical_id") == F.col("expected")
    found = hits.groupBy("query_id").agg(
        has(item).alias("item"), has(F.col("content_type") == kind(F.col("expected"))).alias("kind"), has(F.col("language") == F.col("query_language")).alias("tongue"),
        has(F.contains(F.concat_ws("\n", "title", "text"), F.col("query"))).alias("wording"), F.min(F.when(item, F.col("rank"))).alias("first"),
    )
    rows = search._queries(spark, sf_dir).join(found, "query_id", "left")
    ratio = lambda c, wanted: F.when(wanted, F.coalesce(c, F.lit(0.0))).otherwise(1.0)
    asked = F.col("expected").isNotNull()
    return rows.select(
        "query_id", ratio(F.col("item"), asked).alias("canonical_recall_at_k"), ratio(F.col("kind"), asked).alias("content_type_recall"), ratio(F.col("tongue"), F.col("query_language").isNotNull()).alias("language_recall"),
        ratio(F.col("wording"), F.col("query") != "").alias("required_fragment_recall"), F.coalesce(F.round(1.0 / F.col("first"), 4), F.lit(0.0)).alias("mrr"),
    )


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metric's mean over all stated queries, and whether it reaches its threshold."""
    means = case_metrics(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(m), 4).alias(m) for m in THRESHOLDS)).filter("n > 0")
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(t).alias("threshold")) for m, t in THRESHOLDS.items()))).alias("r")
    return means.select("n", rows).select("n", "r.*").withColumn("reached", F.col("value") >= F.col("threshold"))


QUERIES = {
    "hit_excerpts": hit_excerpts, "candidate_evidence": candidate_evidence, "evidence_packages": evidence_packages, "windows_of_ids": windows_of_ids,
    "resolved_units": resolved_units, "pin_matches": pin_matches, "case_metrics": case_metrics, "metric_summary": metric_summary,
}

_HITS = f"""{search._U}, q AS ({search._Q}), h AS MATERIALIZED (SELECT q.*, s.rank, t.unit_seq, t.unit_id, t.document_id, t.canonical_id, t.language, t.content_type, coalesce(title, '') AS title, coalesce(speaker, '') AS speaker, coalesce(text, '') AS text
  FROM ({search._top_sql('SELECT * FROM u')}) s JOIN text_units t USING (unit_seq) JOIN q USING (query_id))"""
_ROLE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(hay, '{w}')" for w in words) + f" THEN '{name}'" for name, words in reader.ROLES) + " ELSE 'context' END"
_CASES = f"""SELECT query_id, CASE WHEN expected IS NULL THEN 1 ELSE coalesce(item, 0) END AS canonical_recall_at_k, CASE WHEN expected IS NULL THEN 1 ELSE coalesce(kind, 0) END AS content_type_recall,
  CASE WHEN query_language IS NULL THEN 1 ELSE coalesce(tongue, 0) END AS language_recall, CASE WHEN query = '' THEN 1 ELSE coalesce(wording, 0) END AS required_fragment_recall, coalesce(round(1.0::DOUBLE / r, 4), 0) AS mrr
  FROM q LEFT JOIN (SELECT query_id, max(CAST(canonical_id = expected AS DOUBLE)) AS item, max(CAST(content_type = split_part(expected, ':', 2) AS DOUBLE)) AS kind, max(CAST(language = query_language AS DOUBLE)) AS tongue,
    max(CAST(contains(title || chr(10) || text, query) AS DOUBLE)) AS wording, min(rank) FILTER (canonical_id = expected) AS r FROM h GROUP BY query_id) USING (query_id)"""
_FIRST = "[t FOR t IN terms IF t <> '' AND contains(lower(clean), t)]"

ORACLE = {
    "hit_excerpts": f"""WITH {_HITS}, t AS (SELECT query_id, list(normalized ORDER BY place) AS terms FROM ({investigate.ORACLE['query_terms']}) GROUP BY query_id),
      c AS (SELECT query_id, unit_seq, lower(title || chr(10) || speaker || chr(10) || text) AS hay, coalesce(terms, []) AS terms, {Sql.clean('text')} AS clean FROM h LEFT JOIN t USING (query_id)), f AS (SELECT *, {_FIRST} AS found FROM c)
      SELECT query_id, unit_seq, array_to_string([t FOR t IN terms IF length(t) >= 2 AND contains(hay, t)], '|') AS matched, CASE WHEN length(clean) <= {EXCERPT} THEN clean
        WHEN len(found) > 0 THEN substr(clean, greatest(0, instr(lower(clean), found[1]) - 1 - {EXCERPT // 2}) + 1, {EXCERPT}) ELSE left(clean, {EXCERPT}) END AS excerpt FROM f""",
    "candidate_evidence": f"""WITH {_HITS}, c AS (SELECT *, {Sql.clean('text')} AS clean FROM h WHERE unit_id <> '' QUALIFY row_number() OVER (PARTITION BY query_id, unit_id ORDER BY rank) = 1),
      r AS (SELECT *, lower({Sql.clean("concat_ws(chr(10), query, clean, title)")}) AS hay FROM c)
      SELECT query_id, rank, unit_id, left(clean, {CANDIDATE}) AS excerpt, {_ROLE} AS role, unit_id || ':window:{AROUND}:{AROUND}' AS window_id FROM r""",
    "evidence_packages": f"""WITH {_HITS}, f AS (SELECT query_id, canonical_id, count(*) AS n, count(DISTINCT language) AS k, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM h GROUP BY ALL),
      v AS (SELECT *, CASE WHEN k >= 2 THEN canonical_id || '=' || languages END AS variant FROM f)
      SELECT query_id, CAST(sum(n) AS BIGINT) AS n_direct, count(variant) AS n_variants, coalesce(string_agg(variant, '|' ORDER BY variant), '') AS variants FROM v GROUP BY query_id""",
    "windows_of_ids": """WITH c AS (SELECT unit_id, arg_min(document_id, unit_seq) AS d, arg_min(ordinal, unit_seq) AS o FROM text_units GROUP BY unit_id)
      SELECT c.unit_id || ':window:3:2' AS window_id, unit_seq, ordinal, CASE WHEN ordinal < o THEN 'before' WHEN ordinal > o THEN 'after' ELSE 'center' END AS side FROM c JOIN text_units t ON t.document_id = d AND ordinal BETWEEN o - 3 AND o + 2""",
    "resolved_units": """WITH p AS (SELECT document_id, ordinal, arg_min(unit_id, unit_seq) AS there FROM text_units GROUP BY ALL)
      SELECT unit_seq AS ref, CASE unit_seq % 5 WHEN 0 THEN unit_id WHEN 1 THEN there END AS unit_id, CASE unit_seq % 5 WHEN 0 THEN 'unit_id' WHEN 1 THEN 'document_id_ordinal' END AS found_by,
        CASE unit_seq % 5 WHEN 2 THEN 'source_reader_mapping_missing' WHEN 3 THEN 'source_reader_mapping_not_found' WHEN 4 THEN 'source_reader_invalid_ordinal' END AS error FROM text_units JOIN p USING (document_id, ordinal)""",
    "pin_matches": f"""WITH p AS ({reader._PINS}), n AS (SELECT unit_seq, unit_id, section_id, title, language, content_type, '' AS note FROM text_units),
      h AS MATERIALIZED (SELECT unit_seq, role, lower({Sql.clean(" || chr(10) || ".join(f"coalesce({c}, '')" for c in FIELDS))}) AS hay FROM p JOIN n USING (unit_seq)),
      q AS MATERIALIZED (SELECT query_id, lower({Sql.clean('query')}) AS needle FROM ({search._Q}))
      SELECT query_id, unit_seq, role FROM q JOIN h ON contains(hay, needle) WHERE needle <> ''""",
    "case_metrics": f"WITH {_HITS} {_CASES}",
    "metric_summary": f"""WITH {_HITS}, c AS MATERIALIZED ({_CASES}) {' UNION ALL '.join(f"SELECT count(*) AS n, '{m}' AS metric, round(avg({m}), 4) AS value, {t}::DOUBLE AS threshold, round(avg({m}), 4) >= {t}::DOUBLE AS reached FROM c HAVING count(*) > 0" for m, t in THRESHOLDS.items())}""",
}
