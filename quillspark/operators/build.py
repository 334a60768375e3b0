"""From raw records to documents, sections, titles, further targets and the text that search reads.

The walk through a payload runs where the record is read and gives one row per node; everything after it is joins and
aggregates over those rows. A record is one group, as large as its payload.

Defined results: payloads that are no JSON are plain text (only ``deep`` records are read as such); null payloads give
nothing; a record that was crawled twice gives its rows twice, with its own record number; values that are no strings are
no titles; blank titles count as none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.text import Sql
from quillspark.operators import payload
from quillspark.operators.nested import _clean, _Literal, _read
from quillspark.session import table

#: The first part of every item's id.
ORIGIN = "lumen"
NODES = "record_no long, pos int, path string, owner string, name string, kind string, value string"
#: Fields that say nothing; fields whose texts are always kept; parts of names that mark a text; labels left out.
SKIPPED = "icon route source_url content_hash raw_id fetched_at crawler_version raw_format metadata params costItems addProps advancedProps upgrade ascension".split()
TEXTS = "name title chapterTitle chapterNum chapterImageTitle description detail text role native constellation".split()
MARKS = "name title desc story text role".split()
UNLABELLED = ("text", "description", "detail")
GENERIC_SKIPPED = "icon raw_ref metadata".split()
TITLES = ("name", "title", "chapterTitle", "nameFull")
#: The keys of a text in several languages, in order of preference.
TONGUES = {"ko": "KR ko EN en JP ja CHS zh-Hans", "en": "EN en KR ko JP ja CHS zh-Hans", "ja": "JP ja EN en KR ko CHS zh-Hans", "zh-Hans": "CHS zh-Hans EN en KR ko JP ja"}
SLOTS = {"EQUIP_RING": 1, "EQUIP_NECKLACE": 2, "EQUIP_SHOES": 3, "EQUIP_DRESS": 4, "EQUIP_BRACER": 5}


def nodes_of(value: object) -> Iterator[tuple]:
    """(pos, path, owner, name, kind, value) of every node, parents first, in the payload's own order; no recursion."""
    stack: list[tuple] = [("$", None, None, value)]
    pos = 0
    while stack:
        path, owner, name, x = stack.pop()
        if isinstance(x, dict):
            kind, text = "object", None
            stack += [(f"{path}.{k}", path, k, y) for k, y in reversed(x.items())]
        elif isinstance(x, list):
            kind, text = "array", None
            stack += [(f"{path}[{i}]", path, None, y) for i, y in reversed(list(enumerate(x)))]
        elif isinstance(x, bool):
            kind, text = "bool", "true" if x else "false"
        else:
            kind, text = ("null", None) if x is None else ("number" if isinstance(x, _Literal) else "text", _clean(str(x)))
        yield pos, _clean(path), _clean(owner) if owner else None, _clean(name) if name else name, kind, text
        pos += 1


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(n, *node) for n, body in zip(batch["record_no"], batch["body"]) for node in nodes_of(_read(body))]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])


def nodes(bodies: DataFrame) -> DataFrame:
    """Every node of every body (record_no, body)."""
    return bodies.filter("record_no is not null and body is not null").mapInPandas(_nodes, NODES)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_no, language, content_type, kind, item_id, ... , payload): what the metadata of a record say of it."""
    field = lambda name: F.get_json_object("metadata_json", f"$.{name}").alias(name)
    r = table(spark, sf_dir, "raw_records").filter("record_no is not null")
    return r.select("record_no", F.coalesce("language", F.lit("und")).alias("language"), *map(field, ("content_type", "kind", "item_id", "title", "deep_kind", "deep_id", "description", "parent_title", "story_index", "slot_id")), "source_url", "payload")


def canonical_id(content_type: Column | str, item_id: Column | str) -> Column:
    return F.concat_ws(":", F.lit(ORIGIN), content_type, item_id)


def _skipping(names: list[str]) -> Column:
    return F.col("path").rlike(r"\.(?:" + "|".join(names) + r")(?:[.\[]|$)")


def kept_lines(rows: DataFrame) -> DataFrame:
    """(record_no, part, phase, spot, pos, line): the lines of text of nodes (with ``part``, the item a node belongs to, and
    ``content_type``): dialogue lines of quests first, then every text that is worth keeping, with its field's name."""
    texts = rows.filter("kind = 'text'")
    words = F.size(F.split(T.strip(F.col("value")), rf"{T.WS}+"))
    worth = F.col("name").isin(*TEXTS) | F.lower("name").rlike("|".join(MARKS)) | F.col("value").rlike("[ㄱ-힝぀-ヿ㐀-鿿]") | (words >= 4)
    label = F.when(F.col("name").isin(*UNLABELLED), F.col("value")).otherwise(F.concat_ws(": ", "name", "value"))
    generic = texts.filter(F.col("name").isNotNull() & ~_skipping(SKIPPED) & (F.length(T.strip(F.col("value"))) >= 2) & worth)
    generic = generic.select("record_no", "part", F.lit(1).alias("phase"), F.col("pos").alias("spot"), "pos", label.alias("line"))
    quest = rows.filter("content_type = 'quest'")
    roles = quest.filter("kind = 'text' and name = 'role'").select("record_no", "owner", F.col("value").alias("role"))
    places = quest.filter("kind = 'object'").select("record_no", F.col("path").alias("owner"), F.col("pos").alias("spot"))
    said = quest.filter("kind = 'text' and name = 'text'").select("record_no", "part", "owner", "pos", "value")
    choice = r"\.text\[[0-9]+\]$"
    said = said.unionByName(said.filter(F.col("owner").rlike(choice)).withColumn("owner", F.regexp_replace("owner", choice, "")))
    lines = said.join(roles, ["record_no", "owner"]).join(places, ["record_no", "owner"])
    lines = lines.select("record_no", "part", F.lit(0).alias("phase"), "spot", "pos", F.concat_ws(": ", "role", "value").alias("line"))
    return lines.unionByName(generic)


def joined_lines(lines: DataFrame) -> DataFrame:
    """(record_no, part, text): cleaned, the first of equal lines only, in order."""
    cleaned = lines.withColumn("line", T.clean_text(F.col("line"))).filter("line <> ''")
    first = cleaned.groupBy("record_no", "part", "line").agg(F.min(F.struct("phase", "spot", "pos")).alias("place"))
    return first.groupBy("record_no", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.bodies(spark, sf_dir)


def _placed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the part of their record: the item of a list, else the whole."""
    kinds = records(spark, sf_dir).select("record_no", "content_type", "kind").withColumnRenamed("kind", "record_kind")
    part = F.when(F.col("record_kind") == "list", F.regexp_extract("path", r"^\$\.items\.([^.\[]+)", 1)).otherwise("")
    return nodes(_bodies(spark, sf_dir)).join(kinds, "record_no").withColumn("part", part)


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every record, or of every item of a list record."""
    return joined_lines(kept_lines(_placed_nodes(spark, sf_dir)))


def quest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialogue lines of quest records at any depth."""
    return joined_lines(kept_lines(_placed_nodes(spark, sf_dir)).filter("phase = 0")).select("record_no", "text")


def generic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scalar of a record as a line with its path, for records without text worth keeping."""
    rows = nodes(_bodies(spark, sf_dir)).filter(F.col("value").isNotNull() & ~_skipping(GENERIC_SKIPPED))
    label = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"^\$", ""), r"\[([0-9]+)\]", ".$1"), r"^\.", "")
    value = F.when(F.col("kind") == "text", T.clean_text(F.col("value"))).otherwise(F.col("value"))
    rows = rows.withColumn("v", value).filter("v <> ''").select("record_no", F.lit("").alias("part"), F.lit(0).alias("phase"), F.lit(0).alias("spot"), "pos", F.when(label == "", F.col("v")).otherwise(F.concat_ws(": ", label, "v")).alias("line"))
    return joined_lines(rows).select("record_no", "text")


def _raw(path: str) -> Column:
    """A text of the body as it is; null if there is none, if it is blank or no string."""
    is_text = F.expr(f"schema_of_variant(try_variant_get(v, '{path}', 'variant'))") == "STRING"
    value = F.expr(f"try_variant_get(v, '{path}', 'string')")
    return F.when(is_text & (T.strip(value) != ""), value)


def _in_tongues(field: str) -> Column:
    """A text given in several languages: by preference of the record's language, else the first there is."""
    texts = F.from_json(F.get_json_object("body", f"$.{field}"), "map<string,string>")
    order = F.lit(TONGUES["ko"])
    for language, keys in TONGUES.items():
        order = F.when(F.col("language") == language, keys).otherwise(order)
    wanted = F.transform(F.concat(F.split(order, " "), F.map_keys(texts)), lambda k: F.element_at(texts, k))
    return F.get(F.filter(wanted, lambda x: T.strip(x) != ""), 0)


def _title(prefix: str) -> Column:
    chapter = T.clean_text(_raw(f"$.{prefix}info.chapterTitle"))
    number = T.clean_text(_raw(f"$.{prefix}info.chapterNum"))
    names = F.coalesce(_raw(f"$.{prefix}info.route"), *(x for field in TITLES for x in (_raw(f"$.{prefix}{field}"), _in_tongues(prefix + field))))
    return F.coalesce(F.concat(number, F.lit(" - "), chapter), chapter, T.clean_text(names))


def payload_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of every record: chapter, name in the record's language, the same of its detail, route, value, or what the
    metadata say."""
    b = _bodies(spark, sf_dir).withColumn("v", F.expr("try_parse_json(body)")).join(records(spark, sf_dir).select("record_no", "language", "title"), "record_no")
    given = F.when(T.strip(F.col("title")) != "", T.clean_text(F.col("title")))
    chapter = [T.clean_text(_raw(f"$.info.{x}")).alias(y) for x, y in (("type", "quest_type"), ("chapterNum", "chapter_num"), ("chapterTitle", "chapter_title"), ("route", "quest_route"))]
    return b.select("record_no", F.coalesce(_title(""), _title("detail."), T.clean_text(F.coalesce(_raw("$.route"), _raw("$.value"))), given).alias("title"), *chapter)


def title_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(language, content_type, item_id, title): of every item, the first pass that later documents look titles up in. The
    smallest record number wins; a language without a title has the English one."""
    t = payload_titles(spark, sf_dir).select("record_no", "title").join(records(spark, sf_dir).select("record_no", "language", "content_type", "item_id"), "record_no").filter("title is not null and item_id is not null")
    first = t.groupBy("language", "content_type", "item_id").agg(F.min_by("title", "record_no").alias("title"))
    wanted = records(spark, sf_dir).filter("item_id is not null").select("language", "content_type", "item_id").distinct()
    english = first.filter("language = 'en'").select("content_type", "item_id", F.col("title").alias("english"))
    joined = wanted.join(first, ["language", "content_type", "item_id"], "left").join(english, ["content_type", "item_id"], "left")
    return joined.select("language", "content_type", "item_id", F.coalesce("title", "english").alias("title"))


def built_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of detail, list and text records: (record_no, document_id, canonical_id, language, content_type,
    document_kind, title, text, text_hash). Items of lists are left out where the language has a detail of them."""
    r = records(spark, sf_dir)
    index = title_index(spark, sf_dir)
    texts = record_texts(spark, sf_dir)
    own = payload_titles(spark, sf_dir).select("record_no", F.col("title").alias("own_title"))
    detail = r.filter("kind = 'detail'").join(texts.filter("part = ''").select("record_no", "text"), "record_no", "left").join(generic_texts(spark, sf_dir).withColumnRenamed("text", "generic"), "record_no", "left")
    detail = detail.join(own, "record_no", "left").withColumn("text", F.coalesce("text", "generic")).filter("text is not null")
    detail = detail.select("record_no", "language", "content_type", "item_id", F.lit("detail").alias("document_kind"), F.col("own_title").alias("title"), "text", F.lit("detail").alias("rest"))
    there = r.filter("kind = 'detail'").select("language", "content_type", "item_id").distinct()
    items = payload.list_items(spark, sf_dir).select("record_no", F.col("item_key").alias("part"), F.col("name").alias("item_name"))
    lists = r.filter("kind = 'list'").drop("item_id", "title").join(texts.filter("part <> ''"), "record_no").join(items, ["record_no", "part"], "left").withColumnRenamed("part", "item_id")
    lists = lists.join(there, ["language", "content_type", "item_id"], "left_anti")
    name = F.coalesce(F.when(T.strip(F.col("item_name")) != "", T.clean_text(F.col("item_name"))), F.concat_ws("-", "content_type", "item_id"))
    lists = lists.select("record_no", "language", "content_type", "item_id", F.lit("list").alias("document_kind"), name.alias("title"), "text", F.lit("list").alias("rest"))
    plain = r.filter((F.col("kind") == "deep") & F.expr("try_parse_json(payload)").isNull() & F.col("payload").isNotNull()).withColumnRenamed("title", "given").join(index.withColumnRenamed("title", "indexed"), ["language", "content_type", "item_id"], "left")
    title = F.coalesce(F.when(T.strip(F.col("given")) != "", T.clean_text(F.col("given"))), F.col("indexed"))
    parent = F.coalesce(F.when(T.strip(F.col("parent_title")) != "", T.clean_text(F.col("parent_title"))), title)
    series = F.when(T.is_generic_title(parent), F.when(F.col("content_type") == "book", "unnamed_book").otherwise(F.concat_ws("_", F.lit("unnamed"), "content_type"))).otherwise(parent)
    parts = F.array(F.concat(F.lit("parentTitle: "), series), F.concat(F.lit("title: "), title), F.concat(F.lit("description: "), F.when(T.strip(F.col("description")) != "", T.clean_text(F.col("description")))), T.clean_text(F.col("payload")))
    whole = F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x != ""))), "\n")
    kind = F.coalesce("deep_kind", F.lit("deep"))
    plain = plain.select("record_no", "language", "content_type", "item_id", kind.alias("document_kind"), title.alias("title"), whole.alias("text"), F.concat_ws(":", F.lit("deep"), T.safe_id(kind), T.safe_id(F.coalesce("deep_id", kind))).alias("rest"))
    out = detail.unionByName(lists).unionByName(plain).withColumn("text", T.clean_text(F.col("text"))).withColumn("canonical_id", canonical_id("content_type", "item_id"))
    return out.select("record_no", F.concat_ws(":", "canonical_id", "language", "rest").alias("document_id"), "canonical_id", "language", "content_type", "document_kind", "title", "text", F.sha2("text", 256).alias("text_hash"))


def story_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story and quotes documents of characters; a section without any text is its title."""
    b = _bodies(spark, sf_dir).join(records(spark, sf_dir).filter("kind = 'deep' and content_type = 'avatar'").select("record_no", "language", "item_id", "title"), "record_no")
    sections = [b.filter(F.get_json_object("body", f"$.{s}").startswith("{")).select("record_no", "language", "item_id", "title", F.lit(s).alias("section"), F.lit(k).alias("document_kind")) for s, k in (("story", "avatar_stories"), ("quotes", "avatar_quotes"))]
    rows = payload.story_rows(spark, sf_dir).groupBy("record_no", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_sections"))
    d = sections[0].unionByName(sections[1]).join(rows, ["record_no", "section"], "left")
    title = F.concat_ws(" ", T.clean_text(F.col("title")), "section")
    return d.select("record_no", F.concat_ws(":", F.lit(ORIGIN), F.lit("avatar"), "item_id", "language", "document_kind").alias("document_id"), "document_kind", title.alias("title"), F.coalesce("text", F.concat(F.lit("title: "), title)).alias("text"), F.greatest(F.lit(1), F.coalesce("n_sections", F.lit(0))).alias("n_sections"))


def story_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of those documents with their relation to the character."""
    d = story_documents(spark, sf_dir).select("record_no", "document_id", F.when(F.col("document_kind") == "avatar_stories", "story").otherwise("quotes").alias("section"))
    rows = payload.story_rows(spark, sf_dir).withColumn("ordinal", F.row_number().over(W.partitionBy("record_no", "section").orderBy("ordinal")) - 1)
    relation = F.when(F.col("section") == "story", "avatar_has_story").otherwise("avatar_has_quote")
    return d.join(rows, ["record_no", "section"]).select("record_no", F.concat_ws(":", "document_id", F.lit("section"), "ordinal").alias("section_id"), "ordinal", relation.alias("relation_type"), F.sha2(T.clean_text(F.col("text")), 256).alias("text_hash"))


def deep_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be fetched next for each detail record: volumes of books, stories of weapons and materials, pieces of
    sets, the stories and costumes of characters."""
    n = nodes(_bodies(spark, sf_dir)).filter("path rlike '^[$][.](volume|storyId|suit|other|id)'")
    r = records(spark, sf_dir).filter("kind = 'detail' and item_id is not null").select("record_no", "content_type", "item_id")
    scalars = n.filter("value is not null").join(r, "record_no")
    story = F.regexp_extract("path", r"\[([0-9]+)\]", 1)
    number = F.when(story == "", 0).otherwise(story.cast("int"))
    prefix = F.when(F.col("content_type") == "weapon", "Weapon").otherwise("Wings")
    kind = F.when(F.col("content_type") == "weapon", "weapon_story").otherwise("material_story")
    target = lambda rows, kind, deep_id, number: rows.select("record_no", kind.alias("deep_kind"), deep_id.alias("deep_id"), number.alias("n"))
    books = target(scalars.filter("content_type = 'book'").filter(F.col("path").rlike(r"^\$\.volume\[[0-9]+\]\.storyId$")), F.lit("readable"), F.concat(F.lit("Book"), "value"), number)
    stories = target(scalars.filter("content_type in ('weapon', 'material', 'food')").filter(F.col("path").rlike(r"^\$\.storyId(?:\[[0-9]+\])?$")), kind, F.concat(prefix, "value"), number)
    slot = F.element_at(F.create_map(*(F.lit(x) for pair in SLOTS.items() for x in pair)), F.col("name"))
    pieces = n.filter("kind = 'object' and owner = '$.suit'").join(r.filter("content_type = 'reliquary'"), "record_no").withColumn("slot", slot).filter("slot is not null")
    pieces = target(pieces, F.lit("reliquary_story"), F.concat(F.lit("Relic"), "item_id", F.lit("_"), "slot"), F.col("slot"))
    fetters = target(r.filter("content_type = 'avatar'").join(_bodies(spark, sf_dir).select("record_no"), "record_no"), F.lit("avatar_fetter"), F.split_part("item_id", F.lit("-"), F.lit(1)), F.lit(0))
    costumes = target(scalars.filter("content_type = 'avatar'").filter(F.col("path").rlike(r"^\$\.other\.costume\[[0-9]+\]\.storyId$")), F.lit("costume_story"), F.concat(F.lit("Costume"), "value"), number)
    return books.unionByName(stories).unionByName(pieces).unionByName(fetters).unionByName(costumes)


def list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities per payload: details of achievements where there are groups of them, else items."""
    n = nodes(_bodies(spark, sf_dir))
    count = lambda c: F.sum(c.cast("int"))
    items = (F.col("owner") == "$.items") & (F.col("kind") == "object")
    details = F.col("path").rlike(r"^\$\.[0-9]+\.achievementList[.\[][^.\[\]]+\]?\.details\[[0-9]+\]$") & (F.col("kind") == "object")
    per = n.groupBy("record_no").agg(count(F.coalesce(items, F.lit(False))).alias("items"), count(details).alias("details"))
    return per.select("record_no", F.when(F.col("details") > 0, F.col("details")).otherwise(F.col("items")).alias("n_entities")).filter("n_entities > 0")


QUERIES = {
    "record_texts": record_texts, "quest_texts": quest_texts, "generic_texts": generic_texts, "payload_titles": payload_titles, "title_index": title_index, "built_documents": built_documents,
    "story_documents": story_documents, "story_sections": story_sections, "deep_targets": deep_targets, "list_counts": list_counts,
}

# ---- the same in SQL
_REC = "r AS (SELECT record_no, coalesce(language, 'und') AS language, " + ", ".join(f"metadata_json->>'$.{x}' AS {x}" for x in ("content_type", "kind", "item_id", "title", "deep_kind", "deep_id", "description", "parent_title")) + ", payload FROM raw_records WHERE record_no IS NOT NULL)"
_NODES = payload._BODY + f""", {_REC}, t AS MATERIALIZED (SELECT b.record_no, e.rowid AS pos, replace(e.fullkey, '"', '') AS path, e.type, e.atom->>'$' AS value, e.atom AS atom FROM b, json_tree(body) e),
  n AS MATERIALIZED (SELECT t.*, r.content_type, r.kind AS record_kind, regexp_replace(path, '(\\.[^.\\[\\]]+|\\[[0-9]+\\])$', '') AS owner, CASE WHEN path LIKE '%]' OR path = '$' THEN NULL ELSE regexp_extract(path, '\\.([^.\\[\\]]+)$', 1) END AS name,
    CASE WHEN r.kind = 'list' THEN regexp_extract(path, '^\\$\\.items\\.([^.\\[]+)', 1) ELSE '' END AS part FROM t JOIN r USING (record_no))"""
_KEPT = rf"""g AS (SELECT record_no, part, 1 AS phase, pos AS spot, pos, CASE WHEN name IN {UNLABELLED} THEN value ELSE name || ': ' || value END AS line FROM n
    WHERE type = 'VARCHAR' AND name IS NOT NULL AND NOT regexp_matches(path, '\.(?:{'|'.join(SKIPPED)})(?:[.\[]|$)') AND length({Sql.strip('value')}) >= 2
      AND (name IN {tuple(TEXTS)} OR regexp_matches(lower(name), '{'|'.join(MARKS)}') OR regexp_matches(value, '[ㄱ-{chr(0xD79D)}぀-ヿ㐀-鿿]') OR len(regexp_split_to_array({Sql.strip('value')}, '{T.WS}+')) >= 4)),
  s AS (SELECT record_no, part, owner, pos, value FROM n WHERE content_type = 'quest' AND type = 'VARCHAR' AND name = 'text'),
  s2 AS (SELECT * FROM s UNION ALL SELECT record_no, part, regexp_replace(owner, '\.text\[[0-9]+\]$', ''), pos, value FROM s WHERE regexp_matches(owner, '\.text\[[0-9]+\]$')),
  q AS (SELECT s2.record_no, s2.part, 0 AS phase, o.pos AS spot, s2.pos, x.value || ': ' || s2.value AS line FROM s2 JOIN n x ON x.record_no = s2.record_no AND x.owner = s2.owner AND x.name = 'role' AND x.type = 'VARCHAR' JOIN n o ON o.record_no = s2.record_no AND o.path = s2.owner AND o.type = 'OBJECT')"""


def _lines_sql(source: str) -> str:
    return f"""SELECT record_no, part, string_agg(line, chr(10) ORDER BY place) AS text FROM (SELECT record_no, part, line, min(row(phase, spot, pos)) AS place
      FROM (SELECT * EXCLUDE (line), {Sql.clean('line')} AS line FROM ({source})) WHERE line <> '' GROUP BY ALL) GROUP BY ALL"""


_RECORD_TEXTS = _lines_sql("SELECT * FROM g UNION ALL SELECT * FROM q")
_LABEL = r"ltrim(regexp_replace(regexp_replace(path, '^\$', ''), '\[([0-9]+)\]', '.\1', 'g'), '.')"
_GENERIC = rf"""SELECT record_no, '' AS part, 0 AS phase, 0 AS spot, pos, CASE WHEN {_LABEL} = '' THEN v ELSE {_LABEL} || ': ' || v END AS line
  FROM (SELECT *, CASE WHEN type = 'VARCHAR' THEN {Sql.clean('value')} ELSE value END AS v FROM n WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL') AND NOT regexp_matches(path, '\.(?:{'|'.join(GENERIC_SKIPPED)})(?:[.\[]|$)')) WHERE v <> ''"""


def _at_sql(path: str) -> str:
    return f"CASE WHEN json_type(body, '{path}') = 'VARCHAR' AND {Sql.strip(f'(body->>{chr(39)}{path}{chr(39)})')} <> '' THEN {Sql.clean(f'(body->>{chr(39)}{path}{chr(39)})')} END"


def _tongues_sql(field: str) -> str:
    each = lambda order: "[" + ", ".join(f"""body->>'$.{field}."{k}"'""" for k in order.split()) + "]"
    order = "CASE language " + " ".join(f"WHEN '{x}' THEN {each(o)}" for x, o in TONGUES.items()) + f" ELSE {each(TONGUES['ko'])} END"
    found = f"[x FOR x IN list_concat({order}, body->>'$.{field}.*') IF x IS NOT NULL AND {Sql.strip('x')} <> ''][1]"
    return f"CASE WHEN json_type(body, '$.{field}') = 'OBJECT' THEN {Sql.clean(found)} END"


def _title_sql(prefix: str) -> str:
    at = lambda p: f"({_at_sql(f'$.{prefix}{p}')})"
    return f"coalesce({at('info.chapterNum')} || ' - ' || {at('info.chapterTitle')}, {at('info.chapterTitle')}, {at('info.route')}, " + ", ".join(f"{at(f)}, {_tongues_sql(prefix + f)}" for f in TITLES) + ")"


_GIVEN = f"CASE WHEN {Sql.strip('title')} <> '' THEN {Sql.clean('title')} END"
_PAYLOAD_TITLES = f"""SELECT record_no, coalesce({_title_sql('')}, {_title_sql('detail.')}, {_at_sql('$.route')}, {_at_sql('$.value')}, {_GIVEN}) AS title, {_at_sql('$.info.type')} AS quest_type, {_at_sql('$.info.chapterNum')} AS chapter_num,
  {_at_sql('$.info.chapterTitle')} AS chapter_title, {_at_sql('$.info.route')} AS quest_route FROM b JOIN r USING (record_no)"""
_TITLE_INDEX = """SELECT w.language, w.content_type, w.item_id, coalesce(f.title, e.title) AS title FROM (SELECT DISTINCT language, content_type, item_id FROM r WHERE item_id IS NOT NULL) w
  LEFT JOIN first f ON f.language = w.language AND f.content_type = w.content_type AND f.item_id = w.item_id LEFT JOIN first e ON e.language = 'en' AND e.content_type = w.content_type AND e.item_id = w.item_id"""
_FIRST = f"pt AS MATERIALIZED ({_PAYLOAD_TITLES}), first AS MATERIALIZED (SELECT language, content_type, item_id, arg_min(pt.title, record_no) AS title FROM pt JOIN r USING (record_no) WHERE pt.title IS NOT NULL AND item_id IS NOT NULL GROUP BY ALL)"
_CLEANED = lambda c: f"CASE WHEN {Sql.strip(c)} <> '' THEN {Sql.clean(c)} END"
_PLAIN = f"""p0 AS (SELECT r.* EXCLUDE (title), coalesce({_CLEANED('r.title')}, x.title) AS title FROM r LEFT JOIN ix x USING (language, content_type, item_id) WHERE kind = 'deep' AND NOT json_valid(payload)),
  p1 AS (SELECT *, coalesce({_CLEANED('parent_title')}, title) AS parent, coalesce(deep_kind, 'deep') AS k FROM p0),
  p2 AS (SELECT *, CASE WHEN parent IS NULL OR {Sql.strip('parent')} IN {T.GENERIC_TITLES} THEN CASE WHEN content_type = 'book' THEN 'unnamed_book' ELSE 'unnamed_' || content_type END ELSE parent END AS series FROM p1),
  p3 AS (SELECT *, ['parentTitle: ' || series, 'title: ' || title, 'description: ' || ({_CLEANED('description')}), {Sql.clean('payload')}] AS parts FROM p2),
  pl AS (SELECT record_no, language, content_type, item_id, k AS document_kind, title, array_to_string([y FOR y, i IN parts IF y IS NOT NULL AND y <> '' AND list_position(parts, y) = i], chr(10)) AS text, 'deep:' || k || ':' || coalesce(deep_id, k) AS rest FROM p3)"""
_STORY_DOCS = f"""SELECT b.record_no, '{ORIGIN}:avatar:' || item_id || ':' || language || ':' || k AS document_id, k AS document_kind, {Sql.clean('title')} || ' ' || s AS title, coalesce(text, 'title: ' || {Sql.clean('title')} || ' ' || s) AS text, greatest(1, coalesce(n, 0)) AS n_sections
  FROM b JOIN r USING (record_no) CROSS JOIN (VALUES ('story', 'avatar_stories'), ('quotes', 'avatar_quotes')) v(s, k)
  LEFT JOIN (SELECT record_no, section, string_agg(text, chr(10) ORDER BY ordinal) AS text, count(*) AS n FROM ({payload.ORACLE['story_rows']}) GROUP BY ALL) x ON x.record_no = b.record_no AND x.section = s
  WHERE kind = 'deep' AND content_type = 'avatar' AND json_type(body, '$.' || s) = 'OBJECT'"""

ORACLE = {
    "record_texts": f"{_NODES}, {_KEPT} {_RECORD_TEXTS}",
    "quest_texts": f"{_NODES}, {_KEPT} SELECT record_no, text FROM ({_lines_sql('SELECT * FROM q')})",
    "generic_texts": f"{_NODES} SELECT record_no, text FROM ({_lines_sql(_GENERIC)})",
    "payload_titles": f"{payload._BODY}, {_REC} {_PAYLOAD_TITLES}",
    "title_index": f"{payload._BODY}, {_REC}, {_FIRST} {_TITLE_INDEX}",
    "built_documents": f"""{_NODES}, {_KEPT}, rt AS MATERIALIZED ({_RECORD_TEXTS}), gt AS MATERIALIZED ({_lines_sql(_GENERIC)}), {_FIRST}, ix AS MATERIALIZED ({_TITLE_INDEX}), {_PLAIN},
      d AS (SELECT record_no, language, content_type, item_id, 'detail' AS document_kind, pt.title, coalesce(rt.text, gt.text) AS text, 'detail' AS rest FROM r LEFT JOIN (SELECT * FROM rt WHERE part = '') rt USING (record_no) LEFT JOIN gt USING (record_no) LEFT JOIN pt USING (record_no) WHERE kind = 'detail' AND coalesce(rt.text, gt.text) IS NOT NULL),
      li AS ({payload.ORACLE['list_items'].removeprefix(payload._BODY)}),
      l AS (SELECT record_no, language, content_type, rt.part AS item_id, 'list' AS document_kind, coalesce({_CLEANED('li.name')}, content_type || '-' || rt.part) AS title, rt.text, 'list' AS rest FROM r JOIN rt USING (record_no) LEFT JOIN li ON li.record_no = r.record_no AND li.item_key = rt.part
        WHERE kind = 'list' AND rt.part <> '' AND NOT EXISTS (SELECT 1 FROM r e WHERE e.kind = 'detail' AND e.language = r.language AND e.content_type = r.content_type AND e.item_id = rt.part)),
      a AS (SELECT * EXCLUDE (text), {Sql.clean('text')} AS text FROM (SELECT * FROM d UNION ALL SELECT * FROM l UNION ALL SELECT * FROM pl))
      SELECT record_no, '{ORIGIN}:' || content_type || ':' || item_id || ':' || language || ':' || rest AS document_id, '{ORIGIN}:' || content_type || ':' || item_id AS canonical_id, language, content_type, document_kind, title, text, sha256(text) AS text_hash FROM a""",
    "story_documents": f"{payload._BODY}, {_REC} {_STORY_DOCS}",
    "story_sections": f"""{payload._BODY}, {_REC}, d AS ({_STORY_DOCS}), x AS (SELECT *, row_number() OVER (PARTITION BY record_no, section ORDER BY ordinal) - 1 AS o FROM ({payload.ORACLE['story_rows']}))
      SELECT record_no, document_id || ':section:' || o AS section_id, o AS ordinal, CASE section WHEN 'story' THEN 'avatar_has_story' ELSE 'avatar_has_quote' END AS relation_type, sha256({Sql.clean('x.text')}) AS text_hash
      FROM d JOIN x USING (record_no) WHERE (section = 'story') = (document_kind = 'avatar_stories')""",
    "deep_targets": rf"""{_NODES}, c AS (SELECT n.*, item_id FROM n JOIN r USING (record_no) WHERE record_kind = 'detail' AND item_id IS NOT NULL)
      SELECT record_no, CASE WHEN content_type = 'book' THEN 'readable' WHEN content_type = 'weapon' THEN 'weapon_story' ELSE 'material_story' END AS deep_kind, CASE WHEN content_type = 'book' THEN 'Book' WHEN content_type = 'weapon' THEN 'Weapon' ELSE 'Wings' END || value AS deep_id, coalesce(TRY_CAST(regexp_extract(path, '\[([0-9]+)\]', 1) AS INT), 0) AS n
        FROM c WHERE value IS NOT NULL AND ((content_type = 'book' AND regexp_matches(path, '^\$\.volume\[[0-9]+\]\.storyId$')) OR (content_type IN ('weapon', 'material', 'food') AND regexp_matches(path, '^\$\.storyId(?:\[[0-9]+\])?$')))
      UNION ALL SELECT record_no, 'reliquary_story', 'Relic' || item_id || '_' || k, k FROM c JOIN (VALUES {', '.join(f"('{a}', {b})" for a, b in SLOTS.items())}) v(slot, k) ON name = slot WHERE content_type = 'reliquary' AND type = 'OBJECT' AND owner = '$.suit'
      UNION ALL SELECT record_no, 'avatar_fetter', split_part(item_id, '-', 1), 0 FROM r JOIN b USING (record_no) WHERE kind = 'detail' AND content_type = 'avatar' AND item_id IS NOT NULL
      UNION ALL SELECT record_no, 'costume_story', 'Costume' || value, CAST(regexp_extract(path, '\[([0-9]+)\]', 1) AS INT) FROM c WHERE content_type = 'avatar' AND value IS NOT NULL AND regexp_matches(path, '^\$\.other\.costume\[[0-9]+\]\.storyId$')""",
    "list_counts": rf"""{_NODES}, c AS (SELECT record_no, count(*) FILTER (owner = '$.items' AND type = 'OBJECT') AS i, count(*) FILTER (type = 'OBJECT' AND regexp_matches(path, '^\$\.[0-9]+\.achievementList[.\[][^.\[\]]+\]?\.details\[[0-9]+\]$')) AS d FROM n GROUP BY 1)
      SELECT record_no, CASE WHEN d > 0 THEN d ELSE i END AS n_entities FROM c WHERE d > 0 OR i > 0""",
}
