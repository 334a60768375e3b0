"""Word index and ranked search for many queries at once.

Two indexes over title, speaker and text of units: words (runs of letters and digits, folded) and trigrams. A query is
the conjunction of its white-space separated parts; a part is a phrase of one or more index terms within one column.
Scores are Okapi BM25 with k1 = 1.2, b = 0.75 and a floor under the idf; statistics always cover all rows, filters come
after them.

The index (``Index``) is built once per set of units and serves any number of query sets: a forward table with each
column as one string of terms, written out, and postings that are formed for the wanted terms only. A phrase is looked up
by its rarest term and verified in the row's strings, so a frequent word in a phrase costs nothing; phrases that several
queries share are evaluated once. The terms of the stated queries are joined by broadcast where Spark finds their table
small enough, else by a shuffle whose hot keys AQE splits.

Defined results: empty queries, and parts without any term, match nothing; units without text have length zero; ties are
broken by unit_seq; repeated units are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.text import Sql
from quillspark.session import materialize, table

K1, B, IDF_FLOOR, LIMIT, PER_CANONICAL = 1.2, 0.75, 1e-6, 10, 2
COLUMNS = ("title", "speaker", "text")
#: Weights of the channels of the combined search and of languages.
CHANNELS = {"unicode": 1.0, "trigram": 0.82, "title": 2.3}
LANGUAGES = {"ko": 1.28, "en": 1.06}


def _joined(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def trigrams(c: Column) -> Column:
    """Every three neighbouring characters. The text is split first: a substring by place would read the text from its
    start for each of them. ``c`` has to be a column of its own."""
    chars = F.split(c, "")
    n = F.length(c)
    return F.when(n >= 3, F.zip_with(F.zip_with(F.slice(chars, F.lit(1), n - 2), F.slice(chars, F.lit(2), n - 2), _joined), F.slice(chars, F.lit(3), n - 2), _joined)).otherwise(F.array().cast("array<string>"))


def words_in(c: Column) -> Column:
    """The words of a column as one string, each between single blanks; without words a single blank."""
    return F.concat(F.lit(" "), F.array_join(F.transform(T.tokens(c), lambda x: F.concat(x, F.lit(" "))), ""))


#: How a column is stored, how a stored string is cut into distinct terms, and how many terms it has.
FORMS = {"unicode": words_in, "trigram": lambda c: F.lower(F.coalesce(c, F.lit("")))}
TERMS = {"unicode": lambda c: F.split(F.trim(c), " "), "trigram": trigrams}
SIZES = {"unicode": lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) - 1, "trigram": lambda c: F.greatest(F.lit(0), F.length(c) - 2)}


def indexed(units: DataFrame, mode: str) -> DataFrame:
    """(unit_seq, canonical_id, language, stored strings s0..s2, d): the forward index."""
    out = units.select("unit_seq", "canonical_id", "language", *(FORMS[mode](F.col(c)).alias(f"s{i}") for i, c in enumerate(COLUMNS)))
    return out.withColumn("d", SIZES[mode](F.col("s0")) + SIZES[mode](F.col("s1")) + SIZES[mode](F.col("s2")))


def postings(index: DataFrame, mode: str = "unicode") -> DataFrame:
    """(term, unit_seq): the inverted index."""
    terms = [F.filter(TERMS[mode](F.col(f"s{i}")), lambda x: x != "") for i in range(3)]
    return index.select("unit_seq", F.explode_outer(F.array_distinct(F.concat(*terms))).alias("term")).filter("term is not null")


class Index:
    """The forward index of one set of units, written once, with what BM25 needs to know of all of them."""

    def __init__(self, units: DataFrame, mode: str) -> None:
        self.mode, self.rows = mode, materialize(indexed(units, mode))
        stats = self.rows.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("d").alias("avgdl")).first()
        self.n, self.mean = (stats["n"] or 0.0), (stats["avgdl"] or 1.0)


def phrases_of(queries: DataFrame, mode: str, whole: bool = False) -> DataFrame:
    """(query_id, phrase_no, phrase) with phrase a stored string. In trigram mode, or if ``whole``, a query is one phrase."""
    text = T.strip(F.col("query"))
    parts = F.split(text, rf"{T.WS}+") if mode == "unicode" and not whole else F.array(text)
    rows = queries.select("query_id", F.posexplode(parts).alias("phrase_no", "part")).filter("part <> ''")
    return rows.select("query_id", "phrase_no", FORMS[mode](F.col("part")).alias("phrase"))


def phrase_hits(index: Index, phrases: DataFrame) -> DataFrame:
    """(phrase, unit_seq, canonical_id, language, d, f): occurrences of each distinct phrase in each unit, overlapping ones
    included."""
    mode, rows = index.mode, index.rows
    distinct = phrases.filter(SIZES[mode](F.col("phrase")) > 0).select("phrase").distinct()
    wanted = materialize(distinct.select("phrase", F.explode_outer(F.array_distinct(TERMS[mode](F.col("phrase")))).alias("term")))
    # Only postings of terms that some phrase has are kept; their table has a known size from here on.
    posted = materialize(postings(rows, mode).join(wanted.select("term").distinct(), "term", "left_semi"))
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # Every term of a phrase has to occur, so the rarest one (absent ones count as zero) finds all candidates.
    anchors = wanted.join(df, "term", "left").groupBy("phrase").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("term"))
    candidates = posted.join(materialize(anchors), "term").select("phrase", "unit_seq")
    joined = candidates.join(rows, "unit_seq")
    # Counted by a pattern that looks ahead, so that occurrences may overlap; words end with the blank the next begins with.
    pattern = F.concat(F.lit("(?=\\Q"), F.replace("phrase", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    found = sum((F.when(F.contains(f"s{i}", "phrase"), F.regexp_count(f"s{i}", pattern)).otherwise(0) for i in range(3)), F.lit(0))
    return joined.select("phrase", "unit_seq", "canonical_id", "language", "d", found.alias("f")).filter("f > 0")


def bm25(units: DataFrame | Index, queries: DataFrame, mode: str, whole: bool = False) -> DataFrame:
    """(query_id, unit_seq, canonical_id, language, score) of all units that have every phrase of the query."""
    index = units if isinstance(units, Index) else Index(units, mode)
    phrases = phrases_of(queries, mode, whole)
    hits = materialize(phrase_hits(index, phrases))
    per = hits.groupBy("phrase").agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = F.log((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    per = per.select("phrase", F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf).alias("idf"))
    sized = hits.join(materialize(per), "phrase")
    f = F.col("f").cast("double")
    sized = sized.withColumn("s", F.col("idf") * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.lit(float(index.mean)))))
    needed = phrases.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
    scored = phrases.join(sized, "phrase").groupBy("query_id", "unit_seq", "canonical_id", "language").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("got"))
    return scored.join(needed, "query_id").filter("got = needed").select("query_id", "unit_seq", "canonical_id", "language", F.round("score", 6).alias("score"))


def top(hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "unit_seq")))
    return ranked.filter(F.col("rank") <= limit)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_units").select("unit_seq", "unit_id", "document_id", "canonical_id", "language", *COLUMNS)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries: every alias whose id is divisible by 100."""
    return table(spark, sf_dir, "aliases").filter("row_id % 100 = 0 and name is not null").select(F.col("row_id").alias("query_id"), F.col("name").alias("query"), F.col("language").alias("query_language"), F.col("canonical_id").alias("expected"))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, terms and mean length of both indexes per language."""
    units = _units(spark, sf_dir)
    out = None
    for mode in TERMS:
        part = indexed(units, mode).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("n_terms"), F.max("d").alias("longest")).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with the number of units that have it."""
    return postings(indexed(_units(spark, sf_dir), "unicode")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(bm25(_units(spark, sf_dir), _queries(spark, sf_dir), "unicode")).select("query_id", "unit_seq", "score", "rank")


def bm25_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(bm25(_units(spark, sf_dir), _queries(spark, sf_dir), "trigram")).select("query_id", "unit_seq", "score", "rank")


def bm25_own_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered by the query's language after the statistics."""
    hits = bm25(_units(spark, sf_dir), _queries(spark, sf_dir), "unicode").join(_queries(spark, sf_dir).select("query_id", "query_language"), "query_id")
    return top(hits.filter("language = query_language")).select("query_id", "unit_seq", "score", "rank")


def pairs_of(c: str) -> Column:
    """The distinct characters and pairs of neighbouring characters of a column."""
    chars = F.split(c, "")
    n = F.length(c)
    two = F.when(n >= 2, F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), _joined)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(chars, two), lambda x: x != ""))


def contained(needles: DataFrame, needle: str, hays: DataFrame, hay: str) -> DataFrame:
    """(needle, hay) of all distinct strings of which the first occurs in the second.

    They meet on the needle's rarest piece (a pair of characters; the character itself if it has only one), so a common
    beginning forms no pairs; then containment is tested."""
    needles = needles.select(F.col(needle).alias("needle")).filter("needle <> ''").distinct()
    hays = hays.select(F.col(hay).alias("hay")).filter("hay <> ''").distinct()
    pieces = F.filter(pairs_of("needle"), lambda x: F.length(x) == F.least(F.lit(2), F.length("needle")))
    wanted = materialize(needles.select("needle", F.explode(pieces).alias("piece")))
    posted = materialize(hays.select("hay", F.explode(pairs_of("hay")).alias("piece")).join(wanted.select("piece").distinct(), "piece", "left_semi"))
    often = posted.groupBy("piece").agg(F.count(F.lit(1)).alias("df"))
    anchors = wanted.join(often, "piece").groupBy("needle").agg(F.min_by("piece", F.struct("df", "piece")).alias("piece"))
    return posted.join(anchors, "piece").filter(F.col("hay").contains(F.col("needle"))).select("needle", "hay")


def title_hits(units: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, unit_seq, score) of units whose title contains the query: 7 if it is the query, else 4."""
    q = queries.select("query_id", F.lower(T.strip(F.col("query"))).alias("needle"), T.normalize_alias(F.col("query")).alias("key"))
    titles = units.filter("title <> ''").select("title").distinct().withColumn("hay", F.lower("title"))
    hits = contained(q, "needle", titles, "hay").join(titles, "hay").join(q, "needle")
    hits = hits.select("query_id", "title", F.when(T.normalize_alias(F.col("title")) == F.col("key"), 7.0).otherwise(4.0).alias("score"))
    return units.join(hits, "title").select("query_id", "unit_seq", "canonical_id", "language", "score")


def title_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(title_hits(_units(spark, sf_dir), _queries(spark, sf_dir))).select("query_id", "unit_seq", "score", "rank")


def combined(units: DataFrame, queries: DataFrame) -> DataFrame:
    """The channels summed per unit with their weights, times the weight of the language."""
    clip = lambda c: F.least(F.lit(25.0), F.greatest(F.lit(0.1), c))
    parts = [top(bm25(units, queries, m), 40).withColumn("score", clip(F.col("score")) * CHANNELS[m]) for m in TERMS]
    parts.append(top(title_hits(units, queries), 40).withColumn("score", F.col("score") * CHANNELS["title"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    weight = F.lit(1.0)
    for language, w in LANGUAGES.items():
        weight = F.when(F.col("language") == language, w).otherwise(weight)
    return out.groupBy("query_id", "unit_seq", "canonical_id", "language").agg(F.sum("score").alias("raw"), F.count(F.lit(1)).alias("channels")).withColumn("score", F.round(F.col("raw") * weight, 5))


def capped(hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """At most two units of an item, then the best ten."""
    place = F.row_number().over(W.partitionBy("query_id", "canonical_id").orderBy(F.desc("score"), "unit_seq"))
    return top(hits.withColumn("place", place).filter(F.col("place") <= PER_CANONICAL), limit)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capped(combined(_units(spark, sf_dir), _queries(spark, sf_dir))).select("query_id", "unit_seq", "channels", "score", "rank")


def _fallback_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth alias with its kind of entity, as people type it: conjunctions that often match nothing."""
    return table(spark, sf_dir, "aliases").filter("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), F.concat_ws(" ", "name", "entity_type").alias("query"))


def component_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without a strict result, word by word: best of the first word, best of the second, ... in turn."""
    units, queries = _units(spark, sf_dir), _fallback_queries(spark, sf_dir)
    index = Index(units, "unicode")
    strict = bm25(index, queries, "unicode").select("query_id").distinct()
    words = F.filter(F.array_distinct(T.tokens(F.col("query"))), lambda x: F.length(x) >= 2)
    parts = queries.join(strict, "query_id", "left_anti").select("query_id", F.posexplode(F.slice(words, 1, 8)).alias("word_no", "word"))
    single = parts.select("word").distinct().select(F.col("word").alias("query_id"), F.col("word").alias("query"))
    ranked = top(bm25(index, single, "unicode")).select(F.col("query_id").alias("word"), "unit_seq", F.col("rank").alias("word_rank"))
    merged = parts.join(ranked, "word").groupBy("query_id", "unit_seq").agg(F.min(F.struct("word_rank", "word_no")).alias("turn"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy("turn", "unit_seq"))
    return merged.withColumn("rank", order).filter(F.col("rank") <= LIMIT).select("query_id", "unit_seq", "rank")


def result_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query: results, different items, diversity and repetition."""
    hits = top(bm25(_units(spark, sf_dir), _queries(spark, sf_dir), "unicode"))
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("canonical_id").alias("n_items"), F.count_distinct("language").alias("n_languages"))
    return per.select("query_id", "n", "n_items", "n_languages", F.round(F.col("n_items") / F.col("n"), 4).alias("diversity"), F.round((F.col("n") - F.col("n_items")) / F.col("n"), 4).alias("repetition"))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall within ten and mean reciprocal rank of the item a name belongs to, per language."""
    queries = _queries(spark, sf_dir)
    hits = top(bm25(_units(spark, sf_dir), queries, "unicode"))
    first = hits.join(queries.select("query_id", "expected"), "query_id").filter("canonical_id = expected").groupBy("query_id").agg(F.min("rank").alias("r"))
    joined = queries.join(first, "query_id", "left")
    return joined.groupBy(F.col("query_language").alias("language")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("r").isNotNull().cast("double")), 4).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 4).alias("mrr"))


QUERIES = {
    "index_stats": index_stats, "document_frequencies": document_frequencies, "bm25_unicode": bm25_unicode, "bm25_trigram": bm25_trigram, "bm25_own_language": bm25_own_language, "title_like": title_like,
    "hybrid_search": hybrid_search, "component_fallback": component_fallback, "result_quality": result_quality, "retrieval_metrics": retrieval_metrics,
}

_Q = "SELECT row_id AS query_id, name AS query, language AS query_language, canonical_id AS expected FROM aliases WHERE row_id % 100 = 0 AND name IS NOT NULL"


def _gram(c: str) -> str:
    return f"[lower(coalesce({c}, ''))[i:i+2] FOR i IN range(1, length(lower(coalesce({c}, ''))) - 1)]"


def _bm25_sql(mode: str, name: str, queries: str, source: str = "text_units", whole: bool = False) -> str:
    terms = Sql.tokens if mode == "unicode" else _gram
    parts = rf"regexp_split_to_array({Sql.strip('query')}, '{T.WS}+')" if mode == "unicode" and not whole else f"[{Sql.strip('query')}]"
    count = " + ".join(f"len([1 FOR i IN range(1, len(t{k}) - len(phrase) + 2) IF t{k}[i:i+len(phrase)-1] = phrase])" for k in range(3))
    return f"""{name}_i AS MATERIALIZED (SELECT unit_seq, canonical_id, language, {', '.join(f"{terms(c)} AS t{i}" for i, c in enumerate(COLUMNS))} FROM {source}),
      {name}_l AS MATERIALIZED (SELECT *, len(t0) + len(t1) + len(t2) AS d FROM {name}_i), {name}_st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(d) AS avgdl FROM {name}_l),
      {name}_p0 AS (SELECT query_id, unnest(p) AS part, generate_subscripts(p, 1) AS phrase_no FROM (SELECT query_id, {parts} AS p FROM ({queries}))),
      {name}_p AS MATERIALIZED (SELECT query_id, phrase_no, {terms('part')} AS phrase FROM {name}_p0 WHERE part <> ''),
      {name}_d AS MATERIALIZED (SELECT DISTINCT phrase FROM {name}_p WHERE len(phrase) > 0),
      {name}_h AS MATERIALIZED (SELECT phrase, unit_seq, {count} AS f FROM {name}_d, {name}_l WHERE list_has_all(list_concat(t0, t1, t2), phrase)),
      {name}_f AS (SELECT phrase, CAST(count(*) AS DOUBLE) AS df FROM {name}_h WHERE f > 0 GROUP BY phrase),
      {name}_w AS (SELECT phrase, CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf FROM {name}_f, {name}_st),
      {name}_n AS (SELECT query_id, count(*) AS needed FROM {name}_p GROUP BY query_id),
      {name} AS MATERIALIZED (SELECT query_id, unit_seq, canonical_id, language, round(sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / avgdl))), 6) AS score
        FROM {name}_p JOIN {name}_n USING (query_id) JOIN {name}_h USING (phrase) JOIN {name}_w USING (phrase) JOIN {name}_l USING (unit_seq), {name}_st WHERE f > 0
        GROUP BY query_id, unit_seq, canonical_id, language HAVING count(*) = min(needed))"""


def _top_sql(source: str, limit: int = LIMIT) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_seq) AS rank FROM ({source}) QUALIFY rank <= {limit}"


_U, _G = _bm25_sql("unicode", "u", _Q), _bm25_sql("trigram", "g", _Q)
_TITLES = f"""SELECT query_id, unit_seq, canonical_id, t.language, CASE WHEN {Sql.alias('title')} = {Sql.alias('query')} THEN 7.0::DOUBLE ELSE 4.0::DOUBLE END AS score
  FROM ({_Q}) q JOIN text_units t ON contains(lower(title), lower({Sql.strip('query')})) WHERE {Sql.strip('query')} <> ''"""
_COLS = "query_id, unit_seq, score, rank"
_FALLBACK = "SELECT row_id AS query_id, concat_ws(' ', name, entity_type) AS query FROM aliases WHERE row_id % 100 = 0"
_WORDS = f"SELECT query_id, unnest(w) AS word, generate_subscripts(w, 1) AS word_no FROM (SELECT query_id, [x FOR x, i IN {Sql.tokens('query')} IF length(x) >= 2 AND list_position({Sql.tokens('query')}, x) = i][1:8] AS w FROM ({_FALLBACK}) WHERE query_id NOT IN (SELECT query_id FROM s))"

ORACLE = {
    "index_stats": f"""WITH i AS (SELECT language, 'unicode' AS mode, {' + '.join(f'len({Sql.tokens(c)})' for c in COLUMNS)} AS d FROM text_units
        UNION ALL SELECT language, 'trigram', {' + '.join(f"greatest(0, length(lower(coalesce({c}, ''))) - 2)" for c in COLUMNS)} FROM text_units)
      SELECT language, mode, count(*) AS n, sum(d) AS n_terms, max(d) AS longest FROM i GROUP BY ALL""",
    "document_frequencies": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT unit_seq, unnest(list_concat({', '.join(Sql.tokens(c) for c in COLUMNS)})) AS term FROM text_units) GROUP BY term",
    "bm25_unicode": f"WITH {_U} SELECT {_COLS} FROM ({_top_sql('SELECT * FROM u')})",
    "bm25_trigram": f"WITH {_G} SELECT {_COLS} FROM ({_top_sql('SELECT * FROM g')})",
    "bm25_own_language": f"WITH {_U} SELECT {_COLS} FROM ({_top_sql(f'SELECT u.* FROM u JOIN ({_Q}) q USING (query_id) WHERE language = query_language')})",
    "title_like": f"SELECT {_COLS} FROM ({_top_sql(_TITLES)})",
    "hybrid_search": f"""WITH {_U}, {_G}, c AS (SELECT * EXCLUDE (score, rank), least(25, greatest(0.1::DOUBLE, score)) * 1.0::DOUBLE AS score FROM ({_top_sql('SELECT * FROM u', 40)})
        UNION ALL SELECT * EXCLUDE (score, rank), least(25, greatest(0.1::DOUBLE, score)) * 0.82::DOUBLE AS score FROM ({_top_sql('SELECT * FROM g', 40)})
        UNION ALL SELECT * EXCLUDE (score, rank), score * 2.3::DOUBLE FROM ({_top_sql(_TITLES, 40)})),
      s AS (SELECT query_id, unit_seq, canonical_id, count(*) AS channels, round(sum(score) * CASE language WHEN 'ko' THEN 1.28::DOUBLE WHEN 'en' THEN 1.06::DOUBLE ELSE 1.0::DOUBLE END, 5) AS score FROM c GROUP BY query_id, unit_seq, canonical_id, language),
      p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, canonical_id ORDER BY score DESC, unit_seq) <= 2)
      SELECT query_id, unit_seq, channels, score, rank FROM ({_top_sql('SELECT * FROM p')})""",
    "component_fallback": f"""WITH {_bm25_sql('unicode', 's', _FALLBACK)}, w AS MATERIALIZED ({_WORDS}), {_bm25_sql('unicode', 'o', 'SELECT DISTINCT word AS query_id, word AS query FROM w')},
      m AS (SELECT w.query_id, unit_seq, min(row(rank, word_no)) AS turn FROM w JOIN ({_top_sql('SELECT * FROM o')}) r ON r.query_id = w.word GROUP BY ALL)
      SELECT query_id, unit_seq, row_number() OVER (PARTITION BY query_id ORDER BY turn, unit_seq) AS rank FROM m QUALIFY rank <= {LIMIT}""",
    "result_quality": f"""WITH {_U}, t AS ({_top_sql('SELECT * FROM u')}), p AS (SELECT query_id, count(*) AS n, count(DISTINCT canonical_id) AS n_items, count(DISTINCT language) AS n_languages FROM t GROUP BY 1)
      SELECT *, round(n_items / n, 4) AS diversity, round((n - n_items) / n, 4) AS repetition FROM p""",
    "retrieval_metrics": f"""WITH {_U}, t AS ({_top_sql('SELECT * FROM u')}), q AS ({_Q}), f AS (SELECT query_id, min(rank) AS r FROM t JOIN q USING (query_id) WHERE canonical_id = expected GROUP BY 1)
      SELECT query_language AS language, count(*) AS n, round(avg(CAST(r IS NOT NULL AS DOUBLE)), 4) AS recall, round(avg(coalesce(1.0::DOUBLE / r, 0)), 4) AS mrr FROM q LEFT JOIN f USING (query_id) GROUP BY 1""",
}
