"""Text kernel and search against plain Python and against SQLite's own full-text index."""

from __future__ import annotations

import sqlite3

import pytest
from conftest import GIVEN
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import corpus, search


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_clean(spark):
    rows = [None, "", " a\t\tb \r\nc\r", "<color=#FF00aa>x</color> <i>y</i>", "a\n\n\n\nb", "　z\xa0", "a\\nb"]
    assert values(spark, rows, T.clean_text) == [None, "", "a b \nc", "x y", "a\n\nb", "z", "a\nb"]
    assert values(spark, values(spark, rows, T.clean_text), T.clean_text) == values(spark, rows, T.clean_text)


def test_units(spark):
    rows = ["a\nb\n\nc", "x" * 300 + "\ny", "", "A: hello\n\ntips: no", None]
    units = values(spark, rows, T.split_units)
    assert units == [["a", "b", "c"], ["x" * 300 + "\ny"], [], ["A: hello", "tips: no"], None]
    assert values(spark, ["A: hello", "tips: no", "plain"], T.speaker_of) == ["A", None, None]
    assert values(spark, ["A: hello", "tips: no", " plain "], T.speech_of) == ["hello", "tips: no", "plain"]


@pytest.mark.parametrize("longest", [5, 20, 1600])
def test_chunks_lose_nothing(spark, longest):
    docs = spark.createDataFrame([("a", "one\ntwo\n\nthree"), ("b", "x" * 47 + "\ny"), ("c", ""), ("d", None)], "document_id string, text string")
    chunks = sorted(corpus.chunk_rows(docs, longest).collect())
    assert all(len(c.text) <= longest for c in chunks)
    for name, text in (("a", "onetwothree"), ("b", "x" * 47 + "y")):
        assert "".join(c.text for c in chunks if c.document_id == name).replace("\n", "") == text
        assert [c.ordinal for c in chunks if c.document_id == name] == list(range(sum(c.document_id == name for c in chunks)))


@pytest.mark.parametrize("mode,tokenizer", [("unicode", "unicode61 remove_diacritics 2"), ("trigram", "trigram")])
def test_bm25_like_sqlite(spark, mode, tokenizer):
    units = spark.read.parquet(f"{GIVEN}/text_units.parquet")
    rows = units.select("unit_seq", "title", "speaker", "text").collect()
    db = sqlite3.connect(":memory:")
    try:
        db.execute(f"create virtual table f using fts5(title, speaker, text, tokenize='{tokenizer}')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index here")
    db.executemany("insert into f(rowid, title, speaker, text) values (?, ?, ?, ?)", [tuple(r) for r in rows])
    words = ["guards", "the golden", "waited days", "항구", "Port", "zzz", "Every spring"]
    queries = spark.createDataFrame(list(enumerate(words)), "query_id int, query string")
    mine = {(r.query_id, r.unit_seq): r.score for r in search.bm25(units, queries, mode).collect()}
    theirs = {}
    for i, w in enumerate(words):
        match = f'"{w}"' if mode == "trigram" else " AND ".join(f'"{x}"' for x in w.split())
        theirs |= {(i, seq): -rank for seq, rank in db.execute("select rowid, bm25(f) from f where f match ?", [match])}
    assert mine.keys() == theirs.keys() and mine
    assert all(abs(mine[k] - theirs[k]) < 2e-6 for k in mine)


def test_chunks_of_very_many_lines(spark):
    """The greedy rule over 60,000 lines, against a plain loop."""
    lines = ["x" * (1 + n * 7 % 90) for n in range(60_000)]
    got = {r["ordinal"]: r["text"] for r in corpus.chunk_rows(spark.createDataFrame([("a", "\n".join(lines))], "document_id string, text string"), 200).collect()}
    want, used = [[]], 0
    for line in lines:
        if want[-1] and used + len(line) + 1 > 200:
            want.append([])
            used = 0
        want[-1].append(line)
        used += len(line) + 1
    assert [got[k] for k in range(len(got))] == ["\n".join(c) for c in want]
