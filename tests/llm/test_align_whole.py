"""Alignment: nothing is lost to a number of translations or of repeats."""

from __future__ import annotations

import random

from test_align import NOUNS, SCHEMA

from quillspark.llm import align


def test_all_renderings_of_a_word(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        lines = [[rng.choice(NOUNS) for _ in range(5)] for _ in range(20)]
        other = [[w[::-1] + "x" for w in line] for line in lines]
        if k < 40:
            lines[k % 20].append("alpha")
            other[k % 20].append(f"render{'abcd'[k % 4]}")
        rows += [(2 * k, f"s:t:{k}:en:story", "en", "\n".join(map(" ".join, lines)), ""), (2 * k + 1, f"s:t:{k}:xx:story", "xx", "\n".join(map(" ".join, other)), "")]
    lines = align.line_table(spark.createDataFrame(rows, SCHEMA))
    words = align.lexicon(align.pair_table(lines), lines)
    assert {r["y"] for r in words.filter("x = 'alpha'").collect()} >= {"rendera", "renderb", "renderc", "renderd"}


def test_words_in_every_line_of_long_texts(spark):
    n = 40
    lines = spark.createDataFrame([(d, i, n, [w]) for d, w in ((1, "name"), (2, "eman")) for i in range(n)], "doc_id long, line int, n_lines int, words array<string>")
    pairs = spark.createDataFrame([(1, 2, "en|xx", n, n)], "doc_x long, doc_y long, tongues string, n_x int, n_y int")
    words = spark.createDataFrame([("en|xx", "name", "eman", 0.5, 1.0)], "tongues string, x string, y string, s double, rarity double")
    got = align.cells(pairs, lines, words).collect()
    assert len(got) == n * n and all(abs(r["a"] - 1) < 1e-9 and abs(r["b"] - 1) < 1e-9 for r in got)


def test_moved_merged_and_enclosed_lines():
    """A moved line that merges two, and a weak line between aligned neighbours, from their cells."""
    import pandas as pd

    from quillspark.llm import align

    cells = [(k, k, 0.9, 0.9) for k in range(6)] + [(7, 7, 0.9, 0.9), (6, 6, 0.3, 0.28)]
    # Lines 8 and 9 of x are one line of y, which was moved to the front of its text (line 20 here stands far off).
    cells += [(8, 20, 0.9, 0.5), (9, 20, 0.9, 0.5)]
    points = pd.DataFrame(cells, columns=["i", "j", "a", "b"]).assign(doc_x=1, doc_y=2, n_x=10, n_y=21)
    got = {tuple(r) for r in align._blocks(points)[["line_a", "line_b"]].itertuples(index=False)}
    assert got == {(k, k) for k in range(8)} | {(8, 20), (9, 20)}


def test_cells_do_not_depend_on_the_rounds(monkeypatch):
    """Long texts are laid out in rounds of whole lines; the cells equal a plain double loop over all words."""
    import pyarrow as pa
    import pytest

    rng = random.Random(5)
    told = {f"x{k}": [(f"y{m}", rng.random(), rng.random()) for m in rng.sample(range(12), 3)] for k in range(12)}
    xs = [(i, w, rng.random()) for i in range(30) for w in rng.sample(sorted(told), 4)]
    ys = [(j, f"y{m}", rng.random()) for j in range(25) for m in rng.sample(range(12), 4)]
    rng.shuffle(xs)
    entry = pa.list_(pa.struct([("y", pa.string()), ("rx", pa.float64()), ("ry", pa.float64())]))
    heads = {c: [n] * len(xs) for c, n in (("doc_x", 1), ("doc_y", 2), ("n_x", 30), ("n_y", 25))}
    x = pa.table(heads | {"i": [r[0] for r in xs], "weight": [r[2] for r in xs], "told": pa.array([[dict(zip(("y", "rx", "ry"), t)) for t in told[r[1]]] for r in xs], entry)})
    y = pa.table({"j": [r[0] for r in ys], "w": [r[1] for r in ys], "weight": [r[2] for r in ys]})
    want: dict = {}
    for i in range(30):
        for j in range(25):
            links = [((w, v), (u, z), rx, ry) for a, w, v in xs if a == i for u, rx, ry in told[w] for b, t, z in ys if b == j and t == u]
            if links:
                gx = sum(max(rx for p, _, rx, _ in links if p == word) * word[1] for word in {p for p, *_ in links})
                gy = sum(max(ry for _, q, _, ry in links if q == word) * word[1] for word in {q for _, q, *_ in links})
                want[i, j] = (gx / sum(v for a, _, v in xs if a == i), gy / sum(z for b, _, z in ys if b == j))
    for most in (10, 50, 2_000_000):
        monkeypatch.setattr(align, "LINKS", most)
        got = align._cells(x, y)
        mine = {(int(i), int(j)): (a, b) for i, j, a, b in zip(got["i"], got["j"], got["a"], got["b"])}
        assert mine.keys() == want.keys() and all(mine[k] == pytest.approx(want[k]) for k in want)
