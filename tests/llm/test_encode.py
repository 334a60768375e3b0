"""Encoding: equal to the tokenizer itself, an exact round trip, and the edge cases."""

from __future__ import annotations

import random

from conftest import GIVEN
from tokenizers import Tokenizer

from quillspark.llm import encode

FILE = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken"


def reference():
    t = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def encoded(spark, rows):
    return {r.doc_id: r.ids for r in encode.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), FILE).collect()}


def test_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "text").collect()}
    ids = {r.doc_id: r.ids for r in encode.p6_ids(spark, GIVEN).collect()}
    t = reference()
    assert ids == {k: (t.encode(x, add_special_tokens=False).ids if x else []) for k, x in texts.items()}


def test_edges(spark):
    rng = random.Random(3)
    alphabet = "ab'sS 19\n\t 　​\x0b\x85é漢가😀<|endoftext|>½²٣́ "
    rows = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|>"), (5, "don't  'stop'\n\n x"), (6, "a" * 20000), (7, " " * 5000 + "x")] + [(10 + i, "".join(rng.choice(alphabet) for _ in range(40))) for i in range(300)]
    t = reference()
    got = encoded(spark, rows + rows[:5])
    bad = {k: x for k, x in rows if got[k] != (t.encode(x, add_special_tokens=False).ids if x else [])}
    assert not bad


def test_round_trip_and_counts(spark):
    rows = [(1, "ab ab ab"), (2, "漢字 漢字"), (3, None), (4, "")]
    df = spark.createDataFrame(rows + rows, "doc_id long, text string")
    ids = encode.encode_documents(df, FILE)
    assert {r.doc_id: r.text for r in encode.decode_documents(ids, FILE).collect()} == {k: x or "" for k, x in rows}
    counts = {r.doc_id: r.n_tokens for r in encode.token_counts(df, FILE).collect()}
    assert counts == {r.doc_id: len(r.ids) for r in ids.collect()}


def test_cold_words(spark, monkeypatch):
    monkeypatch.setattr(encode, "HOT_WORDS", 2)
    t = reference()
    rows = [(i, f"the the word{i} zebra{i % 3}, the") for i in range(40)]
    assert encoded(spark, rows) == {k: t.encode(x, add_special_tokens=False).ids for k, x in rows}


def test_long_frequent_words(spark, monkeypatch):
    """Separator lines and words too long for the broadcast, in a third of all texts."""
    monkeypatch.setattr(encode, "HEAVY", 20)
    t = reference()
    rows = [(i, ("=" * 80 + "\n" + "x" * 600 + " a") if i % 3 else f"word{i}") for i in range(90)]
    assert encoded(spark, rows) == {k: t.encode(x, add_special_tokens=False).ids for k, x in rows}
