"""Copies against a plain grouping, and edge cases."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

import compare
from conftest import GIVEN

from quillspark.llm import copies, queries

SCHEMA = "doc_id long, language string, document_kind string, text string, n string"


def plain(rows):
    groups = defaultdict(set)
    for doc, language, kind, text, *_ in rows:
        if text is None:
            continue
        lines = re.split(r"\r\n|[\n\x0b\x0c\r\x85  ]", text) if kind == "list" else [text]
        leaves = ["".join(c for c in x if unicodedata.category(c)[0] in "LMN").upper().lower() for x in lines]
        leaves = [x for x in leaves if x]
        if leaves:
            groups[(language or "", kind == "list", tuple(sorted(leaves) if kind == "list" else leaves))].add(doc)
    return {(min(g), d) for g in groups.values() for d in g if d != min(g)}


ROWS = [
    (1, "en", "page", "A b, C!"), (2, "en", "page", "a  B\nc"), (3, "ko", "page", "abc"), (4, "en", "list", "a: 1\nb: 2"), (5, "en", "list", "B 2\r\n\r\nA 1"), (6, "en", "list", "a: 2\nb: 1"),
    (7, "en", "page", "a: 1\nb: 2"), (8, "en", None, "a1b2"), (9, None, None, "a1b2"), (10, None, "page", "A1-B2"), (11, "en", "page", None), (12, "en", "page", ""), (13, "en", "page", "!!! ..."), (14, "en", "page", "?"),
    (15, "en", "page", "é"), (16, "en", "page", "e"), (17, "en", "page", "STRASSE"), (18, "en", "page", "straße"), (1, "en", "page", "A b, C!"),
]


def found(spark, rows):
    groups = copies.copy_groups(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))
    return {(r.first_doc_id, r.doc_id) for r in groups.filter("doc_id <> first_doc_id").collect()}


def test_edges(spark):
    assert found(spark, ROWS) == plain(ROWS) and (17, 18) in plain(ROWS)


def test_hot_group(spark):
    rows = [(i, "en", "page", "The same text." if i % 3 else f"text {i}") for i in range(3000)]
    assert found(spark, rows) == plain(rows)


def test_collision(spark, monkeypatch):
    """Different structures under one digest are told apart."""
    real = copies.with_root_digest
    monkeypatch.setattr(copies, "with_root_digest", lambda d: real(d).withColumn("root", copies.F.lit("same")))
    assert found(spark, ROWS) == plain(ROWS)


def test_sql(spark):
    con = compare.connect(GIVEN)
    for name in ("p5_found", "p5_records"):
        assert compare.spark_rows(queries.QUERIES[name](spark, GIVEN)) == compare.sql_rows(con, queries.ORACLE[name])
