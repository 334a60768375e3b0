"""Queries expanded by the names of what they mention, searched, and searched again with what the first hits mention.

All stated queries run together: every distinct term is searched once, however many queries have it; per query at most
``MAX_TERMS`` terms count (that cut is the reference's own feature). Containment of names in queries and texts is a join on
the name's rarest pair of characters.

Defined results: queries without text keep their other terms; names shorter than two characters name nothing; equal scores
are ordered by concept and by unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.text import Sql
from quillspark.operators import search
from quillspark.operators.expansion import KOREAN, _stem_sql, stem
from quillspark.session import materialize, table

#: Bounds of the expansion, of the hits that are looked into, least score and weights.
MAX_TERMS, MAX_SEEDS, MAX_ALIASES, MAX_RELATED, RELATED_ALIASES, LOOKED_INTO, LEAST = 48, 14, 18, 12, 8, 25, 12.0
FIRST, SECOND, SHOWN = 80, 160, 40
CANONICAL = (5.5, 2.0)
TONGUES = ("ko", "en", "ja", "zh-Hans", "und")
LANGUAGES = {"ko": 1.28, "en": 1.06, "und": 0.85}
CONTENTS = {"quest": 1.32, "book": 1.22, "avatar": 1.16, "reliquary": 1.1, "weapon": 1.07, "material": 1.04, "food": 0.94, "achievement": 0.92, "monster": 0.88, "namecard": 0.86, "furniture": 0.78, "furnitureSuite": 0.75, "gcg": 0.72, "everything": 0.54, "textmap": 0.46}
STATUS = {"representative": 1.05, "duplicate": 0.72}
STOP_WORDS = "관련 관계 연결 가능성 근거 정체 추측 설정 자료 조작 효과 모든 전부 대해 대한 알려줘 찾아줘 정리 분석".split()
#: Kinds of concepts that are followed up: the reference's, and places, as this corpus calls its nations.
FOLLOWED = ("lore_concept", "nation", "organization", "character_or_entity", "manual_concept", "place")
EDGES = "()[]{}<>\"'`.,;:!?"
TERMS = ("query_id", "term", "normalized", "level", "weight", "concept_id", "canonical_id", "seed", "tongue")


def _weights(column: str, given: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for key, weight in given.items():
        out = F.when(F.col(column) == key, weight).otherwise(out)
    return out


def _tongue(c: str = "language") -> Column:
    out = F.lit(9)
    for i, name in enumerate(TONGUES):
        out = F.when(F.col(c) == name, i).otherwise(out)
    return out


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(concept_id, canonical_id, entity_type, language, name, normalized, weight): each name of each concept once."""
    a = table(spark, sf_dir, "aliases").filter("name is not null and concept_id is not null")
    a = a.select("row_id", "concept_id", "canonical_id", "entity_type", F.coalesce("language", F.lit("und")).alias("language"), "name", T.normalize_alias(F.col("name")).alias("normalized"), F.coalesce("weight", F.lit(0.5)).alias("weight"))
    first = F.min_by(F.struct("name", "canonical_id", "entity_type"), "row_id").alias("f")
    rows = a.filter(F.length("normalized") >= 2).groupBy("concept_id", "language", "normalized").agg(first, F.max("weight").alias("weight"))
    return rows.select("concept_id", "f.canonical_id", "f.entity_type", "language", "f.name", "normalized", "weight")


def tokens_of(queries: DataFrame) -> DataFrame:
    """(query_id, place, token, normalized): words of the query, Korean ones without their particles, no stop words."""
    words = F.split(T.strip(F.translate(T.clean_text(F.col("query")), "/,", "  ")), rf"{T.WS}+")
    bare = F.regexp_replace("w", r"^[()\[\]{}<>\"'`.,;:!?]+|[()\[\]{}<>\"'`.,;:!?]+$", "")
    rows = queries.select("query_id", F.posexplode(words).alias("place", "w")).withColumn("w", bare)
    # Within an array, as the forms of a stem make more code than one generated method may have.
    korean = F.get(F.transform(F.array("w"), lambda x: stem(x, KOREAN)), 0)
    rows = rows.withColumn("token", F.when(F.col("w").rlike("[가-힣]"), korean).otherwise(F.col("w")))
    rows = rows.withColumn("normalized", T.normalize_alias(F.col("token"))).filter((F.length("normalized") >= 2) & ~F.col("normalized").isin(*STOP_WORDS))
    kept = rows.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("place"))).filter("n <= 24")
    return kept.select("query_id", "place", "token", "normalized")


def seeds_of(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, concept_id, seed): the concepts a query names, the best first."""
    q = queries.select("query_id", T.normalize_alias(F.col("query")).alias("hay"))
    inside = search.contained(names, "normalized", q, "hay").join(names.withColumnRenamed("normalized", "needle"), "needle").join(q, "hay")
    inside = inside.select("query_id", "concept_id", (F.col("weight") + F.least(F.length("needle") / 4.0, F.lit(8.0))).alias("s"))
    words = tokens_of(queries).select("query_id", "normalized").distinct().join(names, "normalized").select("query_id", "concept_id", (F.col("weight") + 2.0).alias("s"))
    scores = inside.unionByName(words).groupBy("query_id", "concept_id").agg(F.round(F.sum("s"), 6).alias("s"))
    ranked = scores.withColumn("seed", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("s"), "concept_id")))
    return ranked.filter(F.col("seed") <= MAX_SEEDS).select("query_id", "concept_id", "seed")


def best_names(names: DataFrame, most: int) -> DataFrame:
    order = W.partitionBy("concept_id").orderBy(F.desc("weight"), _tongue(), F.length("name"), "name")
    return names.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r")


def merged_terms(terms: DataFrame, most: int) -> DataFrame:
    """Each term of a query once, with its greatest weight; the first ``most`` by level and weight."""
    best = W.partitionBy("query_id", "normalized").orderBy(F.desc("weight"), "level", "seed", "tongue", "term")
    first = terms.filter(F.length("normalized") >= 2).withColumn("r", F.row_number().over(best)).filter("r = 1")
    order = W.partitionBy("query_id").orderBy("level", F.desc("weight"), F.length("term"), "term", "normalized")
    return first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select(*TERMS, "place")


def expanded(queries: DataFrame, names: DataFrame, seeds: DataFrame) -> DataFrame:
    """The terms of each query: itself, its words, the names of the concepts it names."""
    none = F.lit(None).cast("string")
    own = queries.filter("query is not null").select("query_id", F.col("query").alias("term"), T.normalize_alias(F.col("query")).alias("normalized"), F.lit(0).alias("level"), F.lit(4.0).alias("weight"), none.alias("concept_id"), none.alias("canonical_id"), F.lit(-2).alias("seed"), F.lit(0).alias("tongue"))
    words = tokens_of(queries).select("query_id", F.col("token").alias("term"), "normalized", F.lit(0).alias("level"), F.lit(2.5).alias("weight"), none.alias("concept_id"), none.alias("canonical_id"), F.lit(-1).alias("seed"), F.lit(0).alias("tongue"))
    named = seeds.join(best_names(names, MAX_ALIASES), "concept_id").select("query_id", F.col("name").alias("term"), "normalized", F.lit(1).alias("level"), "weight", "concept_id", "canonical_id", "seed", _tongue().alias("tongue"))
    return merged_terms(own.unionByName(words).unionByName(named), MAX_TERMS)


def retrieved(indexes: dict[str, search.Index], units: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """(query_id, unit_seq, raw, concepts): units found by any term, the channels' scores summed with their weights."""
    single = terms.select(F.col("term").alias("query_id"), F.col("term").alias("query")).distinct()
    clip = lambda c: F.least(F.lit(25.0), F.greatest(F.lit(0.1), c))
    parts = [search.top(search.bm25(index, single, mode, whole=True), limit).select(F.col("query_id").alias("term"), "unit_seq", (clip(F.col("score")) * search.CHANNELS[mode]).alias("s")) for mode, index in indexes.items()]
    parts.append(search.top(search.title_hits(units, single), limit).select(F.col("query_id").alias("term"), "unit_seq", (F.col("score") * search.CHANNELS["title"]).alias("s")))
    found = terms.select("query_id", "term", "concept_id").join(parts[0].unionByName(parts[1]).unionByName(parts[2]), "term")
    order = W.partitionBy("canonical_id").orderBy(F.when(F.col("language") == "ko", 0).otherwise(1), "ordinal", "unit_seq")
    heads = units.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= min(limit, 50)).select("canonical_id", "unit_seq")
    own = terms.filter("canonical_id is not null").select("query_id", "term", "concept_id", "canonical_id").join(heads, "canonical_id").withColumn("s", F.lit(CANONICAL[0] * CANONICAL[1]))
    every = found.unionByName(own.select("query_id", "term", "concept_id", "unit_seq", "s").select(*found.columns))
    return every.groupBy("query_id", "unit_seq").agg(F.sum("s").alias("raw"), F.collect_set("concept_id").alias("concepts"))


def scored(hits: DataFrame, units: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds the score of a hit: its channels times the weights of language, content and status, and what its title and
    text have of each term; short texts count less."""
    asked = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "normalized", "weight"))).alias("terms"))
    rows = hits.join(units, "unit_seq").join(asked, "query_id")
    rows = rows.withColumn("title_key", F.coalesce(T.normalize_alias(F.col("title")), F.lit(""))).withColumn("text_key", F.coalesce(T.normalize_alias(F.col("text")), F.lit("")))
    base = F.col("raw") * _weights("language", LANGUAGES) * _weights("content_type", CONTENTS) * _weights("duplicate_status", STATUS)

    def gain(acc: Column, t: Column) -> Column:
        in_title = F.when(F.col("title_key") == t["normalized"], 6.0).when(F.contains("title_key", t["normalized"]), 2.4).otherwise(0.0)
        in_text = F.when(F.contains("text_key", t["normalized"]), 0.65 + F.least(t["weight"] / 20.0, F.lit(0.6))).otherwise(0.0)
        return acc + in_title + in_text

    whole = F.aggregate("terms", F.lit(0.0), gain) + base
    short = F.when(F.length(F.coalesce("text", F.lit(""))) < 80, 0.72).otherwise(1.0)
    return rows.withColumn("score", F.round(whole * short, 5)).select("query_id", "unit_seq", "canonical_id", "concepts", "score", "title_key", "text_key")


def ranked(rows: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """The order of hits: the best hit of each seed first, in the order of the seeds, then by score; two of each item."""
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "unit_seq")
    placed = rows.withColumn("place", F.row_number().over(by_score))
    # A seed takes its best hit that no seed before it has; so it needs to see no more of its hits than there are seeds.
    mine = placed.select("query_id", "unit_seq", "place", F.explode("concepts").alias("concept_id")).join(seeds, ["query_id", "concept_id"])
    near = mine.withColumn("r", F.row_number().over(W.partitionBy("query_id", "concept_id").orderBy("place"))).filter(F.col("r") <= MAX_SEEDS)
    lists = near.groupBy("query_id", "seed").agg(F.array_sort(F.collect_list(F.struct("place", "unit_seq"))).alias("hits"))
    per = lists.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seed", "hits"))).alias("seeds"))
    take = lambda acc, s: F.concat(acc, F.slice(F.filter(F.transform(s["hits"], lambda h: h["unit_seq"]), lambda u: ~F.array_contains(acc, u)), 1, 1))
    front = per.select("query_id", F.posexplode(F.aggregate("seeds", F.expr("cast(array() as array<bigint>)"), take)).alias("front", "unit_seq"))
    ordered = placed.join(front, ["query_id", "unit_seq"], "left").withColumn("rank0", F.row_number().over(W.partitionBy("query_id").orderBy(F.coalesce("front", F.lit(1_000_000)), "place")))
    few = ordered.withColumn("k", F.row_number().over(W.partitionBy("query_id", "canonical_id").orderBy("rank0"))).filter(F.col("k") <= search.PER_CANONICAL)
    return few.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank0"))).filter(F.col("rank") <= limit).select("query_id", "unit_seq", "score", "rank", "title_key", "text_key")


def related(hits: DataFrame, names: DataFrame, seeds: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, concept_id, found): concepts that the best hits mention and the query does not."""
    near = hits.filter(F.col("rank") <= LOOKED_INTO).select("query_id", "unit_seq", F.concat("title_key", "text_key").alias("hay"))
    follow = names.filter((F.length("normalized") >= 3) & (F.col("concept_id").startswith("manual:") | F.col("entity_type").isin(*FOLLOWED)))
    inside = search.contained(follow, "normalized", near, "hay").join(near, "hay").join(follow.withColumnRenamed("normalized", "needle"), "needle")
    new = inside.join(seeds, ["query_id", "concept_id"], "left_anti").join(terms.select("query_id", F.col("normalized").alias("needle")), ["query_id", "needle"], "left_anti")
    gain = F.col("weight") + F.least(F.length("needle") / 6.0, F.lit(5.0))
    per = new.groupBy("query_id", "concept_id").agg(F.round(F.sum(gain), 6).alias("found"))
    best = per.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("found"), "concept_id")))
    return best.filter((F.col("r") <= MAX_RELATED) & (F.col("found") >= LEAST)).select("query_id", "concept_id", "found", "r")


def widened(terms: DataFrame, more: DataFrame, names: DataFrame) -> DataFrame:
    """The terms of a query with the names of its related concepts."""
    weight = F.least(F.col("weight"), F.lit(6.0)) + F.least(F.col("found") / 20.0, F.lit(3.0))
    new = more.join(best_names(names, RELATED_ALIASES), "concept_id").select("query_id", F.col("name").alias("term"), "normalized", F.lit(2).alias("level"), weight.alias("weight"), "concept_id", "canonical_id", (F.lit(100) + F.col("r")).alias("seed"), _tongue().alias("tongue"))
    return merged_terms(terms.select(*TERMS).unionByName(new), MAX_TERMS)


class _Run:
    """The stated queries with what both passes share; tables that feed several steps are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        status = table(spark, sf_dir, "documents").filter("document_id is not null").groupBy("document_id").agg(F.min("duplicate_status").alias("duplicate_status"))
        units = table(spark, sf_dir, "text_units").select("unit_seq", "document_id", "canonical_id", "language", "content_type", "ordinal", *search.COLUMNS)
        self.units = units.join(status, "document_id", "left").drop("document_id")
        self.queries = search._fallback_queries(spark, sf_dir).filter("query_id is not null")
        self.names = materialize(known_names(spark, sf_dir))
        self.seeds = materialize(seeds_of(self.queries, self.names))
        self.terms = materialize(expanded(self.queries, self.names, self.seeds))

    def first(self) -> DataFrame:
        self.indexes = {mode: search.Index(self.units, mode) for mode in search.TERMS}
        return ranked(scored(retrieved(self.indexes, self.units, self.terms, FIRST), self.units, self.terms), self.seeds, SHOWN)

    def second(self) -> DataFrame:
        more = related(materialize(self.first()), self.names, self.seeds, self.terms)
        self.terms = materialize(widened(self.terms, more, self.names))
        return ranked(scored(retrieved(self.indexes, self.units, self.terms, SECOND), self.units, self.terms), self.seeds, SHOWN)


def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(search._fallback_queries(spark, sf_dir))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that each stated query is searched with."""
    return _Run(spark, sf_dir).terms.select("query_id", "place", "term", "normalized", "level", F.round("weight", 6).alias("weight"), "concept_id")


def expanded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pass: every term of every query through all channels."""
    return _Run(spark, sf_dir).first().select("query_id", "unit_seq", "score", "rank")


def followed_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first hits mention beyond the query."""
    run = _Run(spark, sf_dir)
    return related(materialize(run.first()), run.names, run.seeds, run.terms).select("query_id", "concept_id", F.round("found", 5).alias("found"))


def investigate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both passes: the second with the names of what the first hits mention."""
    return _Run(spark, sf_dir).second().select("query_id", "unit_seq", "score", "rank")


QUERIES = {"query_tokens": query_tokens, "query_terms": query_terms, "expanded_search": expanded_search, "followed_concepts": followed_concepts, "investigate": investigate}

# ---- the same in SQL
_TONGUE = "CASE language " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(TONGUES)) + " ELSE 9 END"
_BARE = r"regexp_replace(w, '^[()\[\]{}<>\"''`.,;:!?]+|[()\[\]{}<>\"''`.,;:!?]+$', '', 'g')"
_WORDS = f"regexp_split_to_array({Sql.strip(f'translate({Sql.clean(chr(113) + chr(117) + chr(101) + chr(114) + chr(121))}, {chr(39)}/,{chr(39)}, {chr(39)}  {chr(39)})')}, '{T.WS}+')"
_EXPAND = f"""q AS MATERIALIZED ({search._FALLBACK}),
  tk0 AS (SELECT query_id, place, {_BARE} AS word FROM (SELECT query_id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) - 1 AS place FROM q)),
  tk1 AS (SELECT query_id, place, CASE WHEN regexp_matches(word, '[가-힣]') THEN {_stem_sql(KOREAN)} ELSE word END AS token FROM tk0),
  tk AS MATERIALIZED (SELECT query_id, place, token, {Sql.alias('token')} AS normalized FROM tk1 WHERE length({Sql.alias('token')}) >= 2 AND {Sql.alias('token')} NOT IN {tuple(STOP_WORDS)} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) <= 24),
  na0 AS (SELECT row_id, concept_id, canonical_id, entity_type, coalesce(language, 'und') AS language, name, {Sql.alias('name')} AS normalized, coalesce(weight, 0.5::DOUBLE) AS weight FROM aliases WHERE name IS NOT NULL AND concept_id IS NOT NULL),
  na AS MATERIALIZED (SELECT concept_id, language, normalized, arg_min(name, row_id) AS name, arg_min(canonical_id, row_id) AS canonical_id, arg_min(entity_type, row_id) AS entity_type, max(weight) AS weight FROM na0 WHERE length(normalized) >= 2 GROUP BY ALL),
  sc AS (SELECT query_id, concept_id, round(sum(s), 6) AS s FROM (
    SELECT query_id, concept_id, weight + least(length(normalized) / 4.0::DOUBLE, 8.0::DOUBLE) AS s FROM q JOIN na ON contains({Sql.alias('query')}, normalized)
    UNION ALL SELECT query_id, concept_id, weight + 2.0::DOUBLE FROM (SELECT DISTINCT query_id, normalized FROM tk) JOIN na USING (normalized)) GROUP BY ALL),
  sd AS MATERIALIZED (SELECT query_id, concept_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, concept_id) AS seed FROM sc QUALIFY seed <= {MAX_SEEDS}),
  bn AS MATERIALIZED (SELECT *, {_TONGUE} AS tongue, row_number() OVER (PARTITION BY concept_id ORDER BY weight DESC, {_TONGUE}, length(name), name) AS r FROM na),
  e0 AS (SELECT query_id, query AS term, {Sql.alias('query')} AS normalized, 0 AS level, 4.0::DOUBLE AS weight, NULL::VARCHAR AS concept_id, NULL::VARCHAR AS canonical_id, -2 AS seed, 0 AS tongue FROM q WHERE query IS NOT NULL
    UNION ALL SELECT query_id, token, normalized, 0, 2.5, NULL, NULL, -1, 0 FROM tk
    UNION ALL SELECT query_id, name, normalized, 1, weight, concept_id, canonical_id, seed, tongue FROM sd JOIN bn USING (concept_id) WHERE r <= {MAX_ALIASES})"""


def _merge_sql(source: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY level, weight DESC, length(term), term, normalized) AS place FROM (SELECT * FROM {source} WHERE length(normalized) >= 2
      QUALIFY row_number() OVER (PARTITION BY query_id, normalized ORDER BY weight DESC, level, seed, tongue, term) = 1) QUALIFY place <= {MAX_TERMS}"""


def _case(column: str, given: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in given.items()) + " ELSE 1.0::DOUBLE END"


def _pass_sql(n: str, terms: str, limit: int) -> str:
    """The CTEs of one pass over the terms; the result is {n}_out."""
    q = f"SELECT DISTINCT term AS query_id, term AS query FROM {terms}"
    titles = f"SELECT query_id, unit_seq, canonical_id, t.language, CASE WHEN {Sql.alias('title')} = {Sql.alias('query')} THEN 7.0::DOUBLE ELSE 4.0::DOUBLE END AS score FROM ({q}) q JOIN text_units t ON contains(lower(title), lower({Sql.strip('query')})) WHERE {Sql.strip('query')} <> ''"
    return f"""{search._bm25_sql('unicode', f'{n}u', q, whole=True)}, {search._bm25_sql('trigram', f'{n}g', q)},
  {n}_f AS (SELECT query_id AS term, unit_seq, least(25, greatest(0.1::DOUBLE, score)) * 1.0::DOUBLE AS s FROM ({search._top_sql(f'SELECT * FROM {n}u', limit)}) UNION ALL SELECT query_id, unit_seq, least(25, greatest(0.1::DOUBLE, score)) * 0.82::DOUBLE FROM ({search._top_sql(f'SELECT * FROM {n}g', limit)})
    UNION ALL SELECT query_id, unit_seq, score * 2.3::DOUBLE FROM ({search._top_sql(titles, limit)})),
  {n}_c AS (SELECT canonical_id, unit_seq FROM text_units QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY CASE WHEN language = 'ko' THEN 0 ELSE 1 END, ordinal, unit_seq) <= {min(limit, 50)}),
  {n}_a AS (SELECT query_id, concept_id, unit_seq, s FROM {terms} JOIN {n}_f USING (term) UNION ALL SELECT query_id, concept_id, unit_seq, {CANONICAL[0] * CANONICAL[1]}::DOUBLE FROM {terms} JOIN {n}_c USING (canonical_id)),
  {n}_h AS MATERIALIZED (SELECT query_id, unit_seq, sum(s) AS raw FROM {n}_a GROUP BY ALL),
  {n}_r AS MATERIALIZED (SELECT h.*, u.canonical_id, u.language, u.content_type, d.duplicate_status, coalesce({Sql.alias('u.title')}, '') AS title_key, coalesce({Sql.alias('u.text')}, '') AS text_key, length(coalesce(u.text, '')) AS size
    FROM {n}_h h JOIN text_units u USING (unit_seq) LEFT JOIN (SELECT document_id, min(duplicate_status) AS duplicate_status FROM documents GROUP BY 1) d USING (document_id)),
  {n}_b AS (SELECT r.query_id, unit_seq, sum(CASE WHEN title_key = normalized THEN 6.0::DOUBLE WHEN contains(title_key, normalized) THEN 2.4::DOUBLE ELSE 0 END + CASE WHEN contains(text_key, normalized) THEN 0.65::DOUBLE + least(weight / 20.0::DOUBLE, 0.6::DOUBLE) ELSE 0 END) AS bonus FROM {n}_r r JOIN {terms} t ON t.query_id = r.query_id GROUP BY ALL),
  {n}_s AS MATERIALIZED (SELECT query_id, unit_seq, canonical_id, title_key, text_key, round((raw * {_case('language', LANGUAGES)} * {_case('content_type', CONTENTS)} * {_case('duplicate_status', STATUS)} + bonus) * CASE WHEN size < 80 THEN 0.72::DOUBLE ELSE 1.0::DOUBLE END, 5) AS score FROM {n}_r JOIN {n}_b USING (query_id, unit_seq)),
  {n}_p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_seq) AS place FROM {n}_s),
  {n}_l AS (SELECT query_id, seed, list(unit_seq ORDER BY place) AS hits FROM (SELECT DISTINCT a.query_id, a.unit_seq, seed, place FROM {n}_a a JOIN sd USING (query_id, concept_id) JOIN {n}_p USING (query_id, unit_seq)) GROUP BY ALL),
  {n}_v AS (SELECT query_id, list_reduce(list_prepend([]::BIGINT[], list(hits ORDER BY seed)), lambda acc, h: list_concat(acc, [x FOR x IN h IF NOT list_contains(acc, x)][1:1])) AS front FROM {n}_l GROUP BY 1),
  {n}_o AS (SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY coalesce(list_position(front, unit_seq), 1000000), place) AS rank0 FROM {n}_p p LEFT JOIN {n}_v v ON v.query_id = p.query_id),
  {n}_k AS (SELECT * FROM {n}_o QUALIFY row_number() OVER (PARTITION BY query_id, canonical_id ORDER BY rank0) <= {search.PER_CANONICAL}),
  {n}_out AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank0) AS rank FROM {n}_k QUALIFY rank <= {SHOWN})"""


_TERMS_SQL = f"{_EXPAND}, tm AS MATERIALIZED ({_merge_sql('e0')})"
_RELATED = f"""fo AS (SELECT * FROM na WHERE length(normalized) >= 3 AND (starts_with(concept_id, 'manual:') OR entity_type IN {FOLLOWED})),
  fs AS (SELECT query_id, concept_id, round(sum(weight + least(length(normalized) / 6.0::DOUBLE, 5.0::DOUBLE)), 6) AS found FROM (SELECT query_id, title_key || text_key AS hay FROM a_out WHERE rank <= {LOOKED_INTO}) h JOIN fo ON contains(hay, normalized)
    WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.query_id = h.query_id AND sd.concept_id = fo.concept_id) AND NOT EXISTS (SELECT 1 FROM tm WHERE tm.query_id = h.query_id AND tm.normalized = fo.normalized) GROUP BY ALL),
  fc AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY found DESC, concept_id) AS r FROM fs QUALIFY r <= {MAX_RELATED} AND found >= {LEAST})"""
_WIDER = f"""w0 AS (SELECT * EXCLUDE (place) FROM tm UNION ALL SELECT query_id, name, normalized, 2, least(weight, 6.0::DOUBLE) + least(found / 20.0::DOUBLE, 3.0::DOUBLE), concept_id, canonical_id, 100 + fc.r, tongue FROM fc JOIN bn USING (concept_id) WHERE bn.r <= {RELATED_ALIASES}),
  tw AS MATERIALIZED ({_merge_sql('w0')})"""

ORACLE = {
    "query_tokens": f"WITH {_EXPAND} SELECT * FROM tk",
    "query_terms": f"WITH {_TERMS_SQL} SELECT query_id, place, term, normalized, level, round(weight, 6) AS weight, concept_id FROM tm",
    "expanded_search": f"WITH {_TERMS_SQL}, {_pass_sql('a', 'tm', FIRST)} SELECT query_id, unit_seq, score, rank FROM a_out",
    "followed_concepts": f"WITH {_TERMS_SQL}, {_pass_sql('a', 'tm', FIRST)}, {_RELATED} SELECT query_id, concept_id, round(found, 5) AS found FROM fc",
    "investigate": f"WITH {_TERMS_SQL}, {_pass_sql('a', 'tm', FIRST)}, {_RELATED}, {_WIDER}, {_pass_sql('z', 'tw', SECOND)} SELECT query_id, unit_seq, score, rank FROM z_out",
}
