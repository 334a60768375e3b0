"""The reader: whole documents, windows and pins of all units."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from conftest import GIVEN

from quillspark.plans import catalog
from quillspark.session import table

QUERIES = catalog.core_queries()


def test_every_unit_is_read(spark):
    units = table(spark, GIVEN, "text_units").join(table(spark, GIVEN, "documents").select("document_id", "doc_id"), "document_id")
    texts: dict = {}
    for r in units.orderBy("ordinal", "unit_seq").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    read: dict = {}
    for r in QUERIES["document_units"](spark, GIVEN).orderBy("place").collect():
        read.setdefault(r["doc_id"], []).append(r["text"])
    assert max(map(len, texts.values())) > 3
    assert read == texts


def _pin_id(document_id, unit_id, text, role):
    """As the reference makes it."""
    payload = {"document_id": document_id, "unit_id": unit_id, "start_char": 0, "end_char": len(text), "role": role, "source_level": "L0", "excerpt": text, "hypothesis_ids": []}
    return "E-" + hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode("utf-8")).hexdigest()[:12]


def test_every_unit_is_pinned_whole(spark):
    units = {r["unit_seq"]: r for r in table(spark, GIVEN, "text_units").collect()}
    pins = QUERIES["unit_pins"](spark, GIVEN).collect()
    assert {p["unit_seq"] for p in pins} == {n for n, u in units.items() if u["text"]}
    for p in pins:
        u = units[p["unit_seq"]]
        assert p["excerpt"] == u["text"] and p["evidence_id"] == _pin_id(u["document_id"], u["unit_id"], u["text"], p["role"])


def test_pin_ids_of_odd_characters(spark, tmp_path):
    texts = ['a "quoted" \\ back\\\\slash', "line\nfeed\ttab\r\x0b\x1f\x7f\b\f", "\U0001f600 새 however", "번역", "x" * 50, ""]
    rows = [{"unit_seq": i, "unit_id": f"u{i}", "document_id": None if i == 4 else 'd"1', "canonical_id": "c", "title": None, "text": t} for i, t in enumerate(texts)]
    pq.write_table(pa.Table.from_pylist(rows), Path(tmp_path) / "text_units.parquet")
    pins = {p["unit_seq"]: p for p in QUERIES["unit_pins"](spark, str(tmp_path)).collect()}
    assert [pins[i]["role"] for i in range(5)] == ["context", "context", "counter", "translation_note", "context"] and 5 not in pins
    for i, p in pins.items():
        assert p["evidence_id"] == _pin_id(rows[i]["document_id"], f"u{i}", texts[i], p["role"])


def test_appended_pins_are_those_not_stored(spark):
    pins = QUERIES["unit_pins"](spark, GIVEN).collect()
    stored = {p["evidence_id"] for p in pins if p["unit_seq"] % 2 == 0}
    assert {r["evidence_id"] for r in QUERIES["unit_pins_appended"](spark, GIVEN).collect()} == {p["evidence_id"] for p in pins} - stored


def test_windows_of_hits(spark):
    units = {r["unit_seq"]: (r["document_id"], r["ordinal"]) for r in table(spark, GIVEN, "text_units").collect()}
    got = {(r["center"], r["unit_seq"]) for r in QUERIES["hit_windows"](spark, GIVEN).collect()}
    assert got
    for center in {c for c, _ in got}:
        d, o = units[center]
        assert {u for c, u in got if c == center} == {u for u, (e, p) in units.items() if e == d and abs(p - o) <= 3}
