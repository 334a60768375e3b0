"""Raw payloads: unwrapping and flattening of lists, stories, quests, sets and achievements.

Defined results: null, cut-off and plain text payloads give no row; a payload that is a JSON string holding JSON is read
as the inner JSON; the response envelope is taken off; optional fields are null; values that change their shape (a text
or a list of texts, a map or a list) give the same rows either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.text import Sql
from quillspark.session import table

SLOTS = ("flower", "plume", "sands", "goblet", "circlet")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_no, body): the payload's JSON without string encoding and envelope."""
    r = table(spark, sf_dir, "raw_records").select("record_no", "payload").filter(F.expr("try_parse_json(payload)").isNotNull())
    inner = F.when(F.col("payload").startswith('"'), F.get_json_object("payload", "$")).otherwise(F.col("payload"))
    r = r.select("record_no", inner.alias("body")).filter(F.expr("try_parse_json(body)").isNotNull())
    data = F.when(F.get_json_object("body", "$.response") == "200", F.get_json_object("body", "$.data"))
    return r.select("record_no", F.coalesce(data, F.col("body")).alias("body"))


def _map(c: Column | str, kind: str = "map<string,string>") -> Column:
    return F.from_json(c, kind)


def payload_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array_join(F.array_sort(F.map_keys(_map("body"))), ",")
    return bodies(spark, sf_dir).select(keys.alias("fields")).filter("fields is not null").groupBy("fields").agg(F.count(F.lit(1)).alias("n"))


def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of list payloads."""
    items = bodies(spark, sf_dir).select("record_no", F.explode(_map(F.get_json_object("body", "$.items"))).alias("item_key", "item"))
    return items.select("record_no", "item_key", F.get_json_object("item", "$.name").alias("name"), F.get_json_object("item", "$.rank").alias("item_rank"), F.get_json_object("item", "$.route").alias("route"))


def story_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the story and quotes sections; ordinals follow the numeric keys."""
    b = bodies(spark, sf_dir)
    section = lambda name: b.select("record_no", F.lit(name).alias("section"), F.explode(_map(F.get_json_object("body", f"$.{name}"))).alias("k", "row"))
    rows = section("story").unionByName(section("quotes")).filter("k rlike '^[0-9]+$'")
    parts = F.array(*(F.get_json_object("row", f"$.{f}") for f in ("title", "tips", "text", "title2", "text2")))
    text = F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x != ""))), "\n")
    return rows.select("record_no", "section", F.col("k").cast("int").alias("ordinal"), text.alias("text")).filter("text <> ''")


QUEST = "map<string,struct<title:string,story:array<struct<taskList:array<struct<role:string,text:string>>>>>>"


def quest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialogue lines of quests, one per choice where a text is a list."""
    b = bodies(spark, sf_dir).select("record_no", F.explode(_map(F.get_json_object("body", "$.storyList"), QUEST)).alias("story_key", "s"))
    b = b.select("record_no", "story_key", F.posexplode("s.story").alias("story_no", "t"))
    b = b.select("record_no", "story_key", "story_no", F.posexplode("t.taskList").alias("task_no", "task"))
    choices = F.when(F.col("task.text").startswith("["), F.from_json("task.text", "array<struct<text:string>>")["text"]).otherwise(F.array("task.text"))
    rows = b.select("record_no", "story_key", "story_no", "task_no", F.col("task.role").alias("role"), F.posexplode(choices).alias("choice_no", "text"))
    return rows.filter("text is not null and text <> ''").select("record_no", "story_key", "story_no", "task_no", "choice_no", "role", "text")


def set_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of sets by slot, in the slots' own order."""
    slots = F.explode(F.array(*(F.struct(F.lit(i).alias("slot_no"), F.lit(s).alias("slot")) for i, s in enumerate(SLOTS)))).alias("s")
    b = bodies(spark, sf_dir).withColumn("suit", _map(F.get_json_object("body", "$.suit"))).filter("suit is not null")
    rows = b.select("record_no", "suit", slots).select("record_no", "s.slot_no", "s.slot", F.col("suit")[F.col("s.slot")].alias("piece")).filter("piece is not null")
    return rows.select("record_no", "slot_no", "slot", F.get_json_object("piece", "$.name").alias("name"), F.get_json_object("piece", "$.description").alias("description"))


def set_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effects of sets, ordered by their keys as numbers: the first needs two pieces, the second four."""
    b = bodies(spark, sf_dir).withColumn("effects", F.map_entries(_map(F.get_json_object("body", "$.affixList"))))
    ordered = F.array_sort(F.transform("effects", lambda e: F.struct(e["key"].cast("int").alias("k"), e["value"].alias("effect"))))
    rows = b.select("record_no", F.posexplode(ordered).alias("n", "e"))
    return rows.select("record_no", ((F.col("n") + 1) * 2).alias("pieces"), F.col("e.effect").alias("effect"))


def achievements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, achievement and detail of achievement payloads; the list of achievements may be a map or an array."""
    groups = bodies(spark, sf_dir).select("record_no", F.explode(_map("body")).alias("group_key", "g")).filter("group_key rlike '^[0-9]+$'")
    groups = groups.select("record_no", "group_key", F.get_json_object("g", "$.name").alias("group_name"), F.get_json_object("g", "$.achievementList").alias("list")).filter("list is not null")
    rows = F.when(F.col("list").startswith("["), F.from_json("list", "array<string>")).otherwise(F.map_values(_map("list")))
    one = groups.select("record_no", "group_key", "group_name", F.explode(rows).alias("a"))
    detail = F.from_json(F.get_json_object("a", "$.details"), "array<struct<id:string,title:string,description:string>>")
    return one.select("record_no", "group_key", "group_name", F.get_json_object("a", "$.id").alias("achievement_id"), F.explode_outer(detail).alias("d")).select("record_no", "group_key", "group_name", "achievement_id", F.col("d.id").alias("detail_id"), F.col("d.title").alias("title"))


def base_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties that a page starts from, in their order."""
    b = bodies(spark, sf_dir).select("record_no", F.posexplode(F.from_json(F.get_json_object("body", "$.upgrade.prop"), "array<struct<propType:string,initValue:string>>")).alias("n", "p"))
    return b.select("record_no", "n", F.col("p.propType").alias("prop"), F.col("p.initValue").alias("initial_value"))


def refinements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effects of a page by their keys, with the text of each level; keys that are numbers count levels from one."""
    b = bodies(spark, sf_dir).select("record_no", F.explode(_map(F.get_json_object("body", "$.affix"))).alias("affix_key", "a"))
    b = b.select("record_no", "affix_key", T.clean_text(F.coalesce(F.get_json_object("a", "$.name"), F.lit(""))).alias("name"), F.explode(_map(F.get_json_object("a", "$.upgrade"))).alias("k", "text"))
    level = F.when(F.col("k").rlike("^[0-9]+$"), (F.expr("try_cast(k as bigint)") + 1).cast("string")).otherwise(F.col("k"))
    return b.select("record_no", "affix_key", "name", level.alias("level"), T.clean_text(F.col("text")).alias("text"))


QUERIES = {"base_props": base_props, "refinements": refinements, "payload_shapes": payload_shapes, "list_items": list_items, "story_rows": story_rows, "quest_lines": quest_lines, "set_pieces": set_pieces, "set_effects": set_effects, "achievements": achievements}

_BODY = """WITH p AS (SELECT record_no, CASE WHEN json_valid(payload) THEN CASE WHEN left(payload, 1) = '"' THEN payload->>'$' ELSE payload END END AS inner_text FROM raw_records),
  v AS MATERIALIZED (SELECT record_no, CAST(inner_text AS JSON) AS j FROM p WHERE json_valid(inner_text)),
  b AS MATERIALIZED (SELECT record_no, CASE WHEN j->>'$.response' = '200' THEN j->'$.data' ELSE j END AS body FROM v)"""

ORACLE = {
    "base_props": f"{_BODY} SELECT record_no, CAST(e.key AS INT) AS n, e.value->>'$.propType' AS prop, e.value->>'$.initValue' AS initial_value FROM b, json_each(body, '$.upgrade.prop') e",
    "refinements": f"""{_BODY}, a AS (SELECT record_no, e.key AS affix_key, e.value AS a FROM b, json_each(body, '$.affix') e), r AS (SELECT record_no, affix_key, coalesce(a->>'$.name', '') AS name, e.key AS k, e.value->>'$' AS text FROM a, json_each(a, '$.upgrade') e)
      SELECT record_no, affix_key, {Sql.clean('name')} AS name, CASE WHEN regexp_full_match(k, '[0-9]+') THEN CAST(CAST(k AS BIGINT) + 1 AS VARCHAR) ELSE k END AS level, {Sql.clean('text')} AS text FROM r""",
    "payload_shapes": f"{_BODY} SELECT array_to_string(list_sort(json_keys(body)), ',') AS fields, count(*) AS n FROM b GROUP BY 1",
    "list_items": f"{_BODY} SELECT record_no, e.key AS item_key, e.value->>'$.name' AS name, e.value->>'$.rank' AS item_rank, e.value->>'$.route' AS route FROM b, json_each(body, '$.items') e",
    "story_rows": f"""{_BODY}, r AS (SELECT record_no, 'story' AS section, e.key AS k, e.value AS row FROM b, json_each(body, '$.story') e UNION ALL SELECT record_no, 'quotes', e.key, e.value FROM b, json_each(body, '$.quotes') e),
      t AS (SELECT record_no, section, CAST(k AS INT) AS ordinal, [row->>'$.title', row->>'$.tips', row->>'$.text', row->>'$.title2', row->>'$.text2'] AS parts FROM r WHERE regexp_matches(k, '^[0-9]+$')),
      x AS (SELECT record_no, section, ordinal, array_to_string([p FOR p, i IN parts IF p IS NOT NULL AND p <> '' AND list_position(parts, p) = i], chr(10)) AS text FROM t)
      SELECT * FROM x WHERE text <> ''""",
    "quest_lines": f"""{_BODY}, s AS (SELECT record_no, e.key AS story_key, e.value AS s FROM b, json_each(body, '$.storyList') e),
      t AS (SELECT record_no, story_key, CAST(e.key AS INT) AS story_no, e.value AS t FROM s, json_each(s, '$.story') e), k AS (SELECT record_no, story_key, story_no, CAST(e.key AS INT) AS task_no, e.value AS task FROM t, json_each(t, '$.taskList') e),
      c AS (SELECT record_no, story_key, story_no, task_no, task->>'$.role' AS role, CASE WHEN json_type(task, '$.text') = 'ARRAY' THEN task->>'$.text[*].text' ELSE [task->>'$.text'] END AS texts FROM k),
      u AS (SELECT record_no, story_key, story_no, task_no, role, unnest(texts) AS text, generate_subscripts(texts, 1) - 1 AS choice_no FROM c)
      SELECT * FROM u WHERE text IS NOT NULL AND text <> ''""",
    "set_pieces": f"""{_BODY}, s AS (SELECT unnest({list(SLOTS)}) AS slot, unnest(range(5)) AS slot_no)
      SELECT record_no, slot_no, slot, body->'$.suit'->slot->>'$.name' AS name, body->'$.suit'->slot->>'$.description' AS description FROM b, s WHERE json_exists(body, '$.suit.' || slot)""",
    "set_effects": f"""{_BODY}, e AS (SELECT record_no, CAST(x.key AS INT) AS k, x.value->>'$' AS effect FROM b, json_each(body, '$.affixList') x)
      SELECT record_no, row_number() OVER (PARTITION BY record_no ORDER BY k, effect) * 2 AS pieces, effect FROM e""",
    "achievements": f"""{_BODY}, g AS (SELECT record_no, x.key AS group_key, x.value AS g FROM b, json_each(body) x WHERE json_type(body) = 'OBJECT' AND regexp_matches(x.key, '^[0-9]+$')),
      a AS (SELECT record_no, group_key, g->>'$.name' AS group_name, x.value AS a FROM g, json_each(g, '$.achievementList') x)
      SELECT record_no, group_key, group_name, a->>'$.id' AS achievement_id, d.value->>'$.id' AS detail_id, d.value->>'$.title' AS title FROM a LEFT JOIN LATERAL (SELECT * FROM json_each(a, '$.details')) d ON true""",
}
