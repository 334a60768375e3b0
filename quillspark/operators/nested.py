"""Nested JSON records as related flat tables.

Every JSON object gets a Merkle identity: its own fields in canonical form, with each nested object replaced by
that object's digest, hashed bottom-up. Identical objects are stored once (``object_table``) and every occurrence is
kept as a bridge row with its parent and its ordinal (``bridge_table``).

Defined results
  null, empty or cut-off text, text that is no JSON: no row.
  text that is a JSON string holding JSON (to any depth): read as the inner JSON.
  repeated rows: each occurrence keeps its bridge rows; the object itself is stored once.
  a field that occurs twice in one object: the last one counts, as in most JSON readers.
  numbers keep their literal form, so no precision is lost; NaN and Infinity are no JSON.
  an outermost array: its elements have ``$`` as their parent.
  nesting of any depth is read: what is too deep for the reader of the standard library goes through a slower one without
  a limit, and nothing here recurses. A path is as long as its object is deep, so rows are handed on as they come.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import table

BRIDGE = "table_name string, row_key long, node_path string, parent_path string, ordinal int, depth int, digest string, parent_digest string, content string"

#: The JSON columns of the data set and the key of their rows.
JSON_COLUMNS = (("raw_records", "record_no", "payload"), ("documents", "doc_id", "metadata_json"), ("items", "ingest_seq", "metadata_json"))


class _Literal(str):
    """A number in its literal form."""


def _no_json(constant: str) -> None:
    raise ValueError(constant)


def _read(text: str | None) -> object:
    """The JSON value of a text; None if there is none."""
    value: object = text
    while isinstance(value, str) and not isinstance(value, _Literal):
        try:
            value = json.loads(value, parse_int=_Literal, parse_float=_Literal, parse_constant=_no_json)
        except RecursionError:
            value = _read_deep(value)
        except ValueError:
            return None
    return value


_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null")
_WORDS = {"true": True, "false": False, "null": None}
_BLANK = re.compile(r"[ \t\n\r]*")


def _read_deep(text: str) -> object:
    """The same without a limit of depth: one loop over the text, open arrays and objects on a stack."""
    whole: list = []
    stack: list[tuple[object, str | None]] = []  # the open containers; an object with the key that waits for its value
    into: object = whole
    key, at, due = None, 0, "value"  # what may come next: a value, a value or the end, a key, a key or the end, a comma or the end

    def put(value: object) -> None:
        into.__setitem__(key, value) if isinstance(into, dict) else into.append(value)

    while True:
        at = _BLANK.match(text, at).end()
        c = text[at : at + 1]
        if not stack and whole and due == "next":
            return whole[0] if not c else None
        if due == "next" and c == ",":
            due, at = ("key" if isinstance(into, dict) else "value"), at + 1
        elif (c == "}" and isinstance(into, dict) and due in ("next", "key or end")) or (c == "]" and stack and isinstance(into, list) and due in ("next", "value or end")):
            (into, key), due, at = stack.pop(), "next", at + 1
        elif due in ("key", "key or end") and c == '"':
            try:
                key, at = json.decoder.scanstring(text, at + 1, True)
            except ValueError:
                return None
            at = _BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                return None
            due, at = "value", at + 1
        elif due in ("value", "value or end") and c in ("{", "["):
            made: object = {} if c == "{" else []
            put(made)
            stack.append((into, key))
            into, due, at = made, "key or end" if c == "{" else "value or end", at + 1
        elif due in ("value", "value or end") and c == '"':
            try:
                value, at = json.decoder.scanstring(text, at + 1, True)
            except ValueError:
                return None
            put(value)
            due = "next"
        elif due in ("value", "value or end") and (m := _SCALAR.match(text, at)):
            put(_WORDS[m[0]] if m[0] in _WORDS else _Literal(m[0]))
            due, at = "next", m.end()
        else:
            return None


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8") if not text.isascii() else text


def _scalar(x: object) -> str:
    return str(x) if isinstance(x, _Literal) else json.dumps(x, ensure_ascii=False)


def _objects(value: object) -> list[list]:
    """[own path segment, number of the parent, ordinal, depth, digest, content] of every object, parents before children.

    Bottom-up: an object is digested when its last child is, with ``{"@": digest}`` in the place of each child."""
    found: list[list] = []
    # A frame is an open container: [kind, entries, texts so far, path since the object, number of the object, its own key].
    top: list[str] = []
    stack: list[list] = []

    def open_(x: object, key: str | None, ordinal: int) -> None:
        if isinstance(x, dict):
            parent = stack[-1][4] if stack else -1
            found.append([stack[-1][3] + (f".{key}" if key is not None else f"[{ordinal}]") if stack else "$", parent, ordinal, found[parent][3] + 1 if parent >= 0 else 0, None, None])
            stack.append(["{", enumerate(x.items()), [], "", len(found) - 1, key])
        else:
            path = (stack[-1][3] + (f".{key}" if key is not None else f"[{ordinal}]")) if stack else "$"
            stack.append(["[", enumerate(x), [], path, stack[-1][4] if stack else -1, key])

    def give(text: str, key: str | None) -> None:
        (stack[-1][2] if stack else top).append(text if key is None else (key, text))

    open_(value, None, 0)
    while stack:
        kind, entries, texts, _, number, own = stack[-1]
        opened = False
        for i, entry in entries:
            key, x = entry if kind == "{" else (None, entry)
            if isinstance(x, (dict, list)):
                open_(x, key, i)
                opened = True
                break
            texts.append((key, _scalar(x)) if kind == "{" else _scalar(x))
        if opened:
            continue
        stack.pop()
        if kind == "[":
            give("[" + ",".join(texts) + "]", own)
        else:
            content = "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in sorted(texts)) + "}"
            digest = hashlib.sha256(content.encode("utf-8", "replace")).hexdigest()
            found[number][4:] = [digest, content]
            give(f'{{"@":"{digest}"}}', own)
    return found


def _occurrences(value: object) -> Iterator[tuple]:
    """(path, parent path, ordinal, depth, digest, parent's digest, content) of every object, parents before children."""
    objects = _objects(value)
    # The path to the current object is kept once, as its segments' ends; each row gets its own copy when it is handed on.
    path, ends = "", []
    for segment, parent, ordinal, depth, digest, content in objects:
        del ends[depth:]
        above = path[: ends[-1]] if ends else ""
        path = above + segment
        ends.append(len(path))
        yield _clean(path), _clean(above) or "$", ordinal, depth, digest, objects[parent][4] if parent >= 0 else None, _clean(content)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in BRIDGE.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for name, key, text in zip(batch["table_name"], batch["row_key"], batch["text"]):
            value = _read(text)
            if isinstance(value, (dict, list)):
                for row in _occurrences(value):
                    out.append((name, key, *row))
                    held += len(row[0]) + len(row[1]) + len(row[6])
                    if held > 16_000_000 or len(out) > 20_000:
                        yield pd.DataFrame(out, columns=columns)
                        out, held = [], 0
        yield pd.DataFrame(out, columns=columns)


def bridge_table(texts: DataFrame) -> DataFrame:
    """Every occurrence of every JSON object of (table_name, row_key, text), outermost ones included."""
    # A record is walked where it is read: no shuffle, and no more than one record in memory per task besides the output.
    wanted = texts.select("table_name", F.col("row_key").cast("long").alias("row_key"), "text").filter(F.col("text").rlike(r'[\[{]'))
    return wanted.mapInPandas(_walk, BRIDGE)


def object_table(bridge: DataFrame) -> DataFrame:
    """Each distinct object once, with the number of its occurrences; the count is combined before the shuffle, so a
    digest that a third of all rows share costs no more than any other."""
    return bridge.groupBy("digest").agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n_occurrences"))


FIELDS = "digest string, path string, ordinal int, kind string, value string"


def _scalars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: list[tuple] = []
        for digest, content in zip(batch["digest"], batch["content"]):
            pending = [(_clean(k), v) for k, v in reversed(_read(content).items())]
            n = 0
            while pending:
                path, x = pending.pop()
                if isinstance(x, list):
                    pending += [(f"{path}[{i}]", y) for i, y in reversed(list(enumerate(x)))]
                    continue
                kind = "object" if isinstance(x, dict) else "null" if x is None else "bool" if isinstance(x, bool) else "number" if isinstance(x, _Literal) else "text"
                out.append((digest, path, n, kind, x["@"] if kind == "object" else None if x is None else _clean(x) if kind == "text" else _scalar(x)))
                n += 1
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FIELDS.split(", ")])


def field_table(objects: DataFrame) -> DataFrame:
    """(digest, path, ordinal, kind, value): the fields of each distinct object as flat rows, once however often it occurs.

    Array elements have rows of their own (path ``name[0]``); a nested object is the digest of its row; null has no value."""
    return objects.select("digest", "content").mapInPandas(_scalars, FIELDS)


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_key, text) of all JSON columns."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), F.col(key).alias("row_key"), F.col(column).alias("text")) for t, key, column in JSON_COLUMNS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each JSON object but the outermost: (table_name, row_key, node_path, parent_path)."""
    bridge = bridge_table(json_texts(spark, sf_dir))
    return bridge.filter(F.col("node_path") != "$").select("table_name", "row_key", "node_path", "parent_path")


def p4_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct object, stored once."""
    return object_table(bridge_table(json_texts(spark, sf_dir)))


def p4_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent-child links of all occurrences by digest, with ordinals."""
    return bridge_table(json_texts(spark, sf_dir)).drop("content")


def p4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of each distinct object."""
    return field_table(p4_objects(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_objects": p4_objects, "p4_bridge": p4_bridge, "p4_fields": p4_fields}

_TEXTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {k} AS row_key, {c} AS x FROM {t}" for t, k, c in JSON_COLUMNS)
# The encoded text is read as often as it was encoded; the data of the checks holds no more than two rounds.
_INNER = "CASE WHEN json_valid(x) THEN CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' ELSE x END END"
_TREE = f"""WITH t AS ({_TEXTS}), i AS (SELECT table_name, row_key, {_INNER} AS x FROM t), j AS (SELECT table_name, row_key, {_INNER} AS x FROM i),
  n AS (SELECT table_name, row_key, replace(e.fullkey, '"', '') AS node_path FROM j, json_tree(x) e WHERE json_valid(x) AND e.type = 'OBJECT')"""

ORACLE = {
    "p4_found": f"{_TREE} SELECT table_name, row_key, node_path, regexp_replace(regexp_replace(node_path, '(\\[[0-9]+\\])+$', ''), '(\\.[^.]*)?(\\[[0-9]+\\])*$', '') AS parent_path FROM n WHERE node_path <> '$'",
}
