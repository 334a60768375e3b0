"""Nested JSON against a plain recursive walk, and its edge cases."""

from __future__ import annotations

import json

from conftest import GIVEN
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import nested


def walk(value, path="$", parent="$"):
    if isinstance(value, dict):
        if path != "$":
            yield path, parent
        for k, v in value.items():
            yield from walk(v, f"{path}.{k}", path)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]", parent)


def bridge(spark, *texts):
    return nested.bridge_table(spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "table_name string, row_key long, text string"))


def test_all_objects(spark):
    rows = {tuple(r) for r in nested.p4_found(spark, GIVEN).collect()}
    want = set()
    for name, key, column in nested.JSON_COLUMNS:
        for r in spark.read.parquet(f"{GIVEN}/{name}.parquet").select(key, column).collect():
            value = r[1]
            try:
                while isinstance(value, str):
                    value = json.loads(value)
            except ValueError:
                continue
            want |= {(name, r[0], path, parent) for path, parent in walk(value)}
    assert rows == want and want


def test_edges(spark):
    texts = (None, "", " ", "{", '{"a": {}} x', "NaN", '{"a": NaN}', '"text"', "[1, {}]", json.dumps(json.dumps({"a": {"b": {}}})), '{"a": 1e999, "b": {"c": 123456789012345678901234567890}}')
    rows = {(r.row_key, r.node_path, r.parent_path) for r in bridge(spark, *texts).filter("node_path <> '$'").collect()}
    assert rows == {(8, "$[1]", "$"), (9, "$.a", "$"), (9, "$.a.b", "$.a"), (10, "$.b", "$")}


def test_identical_objects_once(spark):
    rows = bridge(spark, '{"x": {"p": 1, "q": [true]}}', '{"y": {"q": [ true ], "p": 1}, "z": [{"q": [true], "p": 1}]}')
    objects = {r.content: r.n_occurrences for r in nested.object_table(rows).collect()}
    assert objects['{"p":1,"q":[true]}'] == 3
    links = rows.filter("node_path <> '$'").alias("c").join(rows.alias("p"), (F.col("c.row_key") == F.col("p.row_key")) & (F.col("c.parent_path") == F.col("p.node_path")))
    assert all(r["pd"] == r["d"] for r in links.select(F.col("c.parent_digest").alias("pd"), F.col("p.digest").alias("d")).collect())


def test_deep(spark):
    depth = 400
    text = '{"a":' * depth + "{}" + "}" * depth
    assert bridge(spark, text).count() == depth + 1


leaves = st.none() | st.booleans() | st.integers() | st.text(max_size=5)
values = st.recursive(leaves, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(values)
def test_walk_property(value):
    mine = sorted((r[0], r[1]) for r in nested._occurrences(value) if r[0] != "$") if isinstance(value, (dict, list)) else []
    clean = lambda s: s.encode("utf-8", "replace").decode("utf-8")
    assert mine == sorted((clean(a), clean(b)) for a, b in walk(value))


def test_very_deep(spark):
    """Deeper than any reader's limit: all rows through Spark, and the bare digests of a far deeper one."""
    for depth, text in ((20_000, '{"a":' * 20_000 + "{}" + "}" * 20_000), (5_000, '[{"b":' * 5_000 + "1" + "}]" * 5_000)):
        rows = bridge(spark, text).selectExpr("max(depth)", "count(*)", "count(distinct digest)").first()
        assert tuple(rows) == (depth, depth + 1, depth + 1) if text[0] == "{" else tuple(rows) == (depth - 1, depth, depth)
    assert len(nested._objects(nested._read('{"a":' * 200_000 + "{}" + "}" * 200_000))) == 200_001


@settings(max_examples=200, deadline=None)
@given(values, st.text("[]{},:\"1-+e. \\u0", max_size=12))
def test_reader_without_limit(value, noise):
    for text in (json.dumps(value), json.dumps(value, indent=1), json.dumps(value) + noise, noise):
        try:
            want = json.loads(text, parse_int=nested._Literal, parse_float=nested._Literal, parse_constant=nested._no_json)
        except ValueError:
            want = None
        got = nested._read_deep(text)
        assert got == want and json.dumps(got) == json.dumps(want)


def test_fields(spark):
    rows = nested.field_table(nested.object_table(bridge(spark, '{"x": {"p": 1.0, "q": [true, ["z", null]]}, "y": "t"}'))).collect()
    inner = {(r.path, r.ordinal, r.kind, r.value) for r in rows if r.path != "x" and r.path != "y"}
    assert inner == {("p", 0, "number", "1.0"), ("q[0]", 1, "bool", "true"), ("q[1][0]", 2, "text", "z"), ("q[1][1]", 3, "null", None)}
    assert {(r.path, r.kind) for r in rows if r.path in "xy"} == {("x", "object"), ("y", "text")}
    assert [r.value for r in rows if r.path == "x"][0] in {r.digest for r in rows if r.path == "p"}
