"""Alignment: planted translations with omissions, merges and moves; unrelated texts; edge cases."""

from __future__ import annotations

import random

import pytest

from quillspark.llm import align

NOUNS = [f"{a}{b}" for a in ("ka", "mo", "ri", "su", "te", "na", "wo", "pe") for b in ("lin", "dor", "gan", "bit", "mes", "fur")]
SCHEMA = "doc_id long, document_id string, language string, text string, line string"


def corpus(n_pairs: int = 60, lines: int = 10):
    """Pairs of texts over an invented vocabulary: word w becomes w reversed, in upper-case letters turned to lower."""
    rng = random.Random(5)
    rows, truth = [], set()
    for k in range(n_pairs):
        source = [[rng.choice(NOUNS) for _ in range(6)] + ([str(rng.randint(100, 9999))] if rng.random() < 0.5 else []) for _ in range(lines)]
        target = [([w[::-1] + "x" if not w.isdigit() else w for w in s], {i}) for i, s in enumerate(source)]
        if k % 10 == 9:
            target = [([rng.choice(NOUNS)[::-1] + "x" for _ in range(6)], set()) for _ in range(lines)]
        else:
            del target[rng.randrange(len(target))]
            m = rng.randrange(len(target) - 1)
            target[m : m + 2] = [(target[m][0] + target[m + 1][0], target[m][1] | target[m + 1][1])]
        a, b = 2 * k, 2 * k + 1
        rows.append((a, f"s:t:{k}:en:story", "en", "\n".join(" ".join(s) for s in source), "x"))
        rows.append((b, f"s:t:{k}:xx:story", "xx", "\r\n\r\n".join(" ".join(t) for t, _ in target), "x"))
        truth |= {(a, i, b, j) for j, (_, came) in enumerate(target) for i in came}
    return rows, truth


@pytest.fixture(scope="module")
def found(spark):
    rows, truth = corpus()
    return {tuple(r) for r in align.align(spark.createDataFrame(rows, SCHEMA)).collect()}, truth


def test_recall_and_precision(found):
    got, truth = found
    assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.9 * len(got)


def test_unrelated_give_nothing(found):
    got, truth = found
    related = {(a, b) for a, _, b, _ in truth}
    assert sum((a, b) not in related for a, _, b, _ in got) <= 0.02 * len(got)


def test_edges(spark):
    rows = [(1, "a:b:1:en:x", "en", None, ""), (2, "a:b:1:ko:x", "ko", "가", ""), (3, "a:b:2:en:x", "en", "", ""), (4, "a:b:2:ko:x", "ko", " \n", ""), (5, None, "en", "x", ""), (6, "odd", "en", "y", ""), (7, "a:b:3:en:x", "en", "1 2", ""), (7, "a:b:3:en:x", "en", "1 2", ""), (8, "a:b:3:en:y", "en", "1 2", "")]
    assert align.align(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert align.align(spark.createDataFrame([], SCHEMA)).count() == 0


def test_numbers_alone_align(spark):
    rows = [(1, "a:b:1:en:x", "en", "one 1,234 two\nthree 567\nfour 89 end", ""), (2, "a:b:1:ko:x", "ko", "하나 1234\n셋 567 넷\n끝 89", "")]
    assert {tuple(r) for r in align.align(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, 0, 2, 0), (1, 1, 2, 1), (1, 2, 2, 2)}
