"""Visually identical names against a plain version built on the character database."""

from __future__ import annotations

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import unify

ALIKE = {x: k for k, group in unify.LOOKALIKES.items() for x in group if x not in unify.NOT_ALIKE}


def plain(name: str, alike: bool = True) -> str:
    shown = "".join("" if unify._shows_not(c) else " " if c.isspace() else c for c in name)
    parts = "".join(unify._decompose(c) for c in shown)
    if alike:
        parts = "".join(unify._decompose(ALIKE.get(c, c)) for c in parts)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", parts)).strip(" ")


NAMES = [
    "Muborora", "Mub‍͏orora", "ｍuborora", "Núbe", "Núbe", "Nübe", "Tudadοmi", "Ᏼlade", "", "​", " 　", "a b", "a b", "a  b",
    "ガ", "ガ", "ｶﾞ", "力゙", "각", "각", "각", "á̧", "á̧", "ᾂ", "ΐ", "ﬄ", "Ⅲ", "⽊", "木", "x²", "①", "é́́", "́a", "𝒳", "😀️", "z" * 3000,
]


def test_forms(spark):
    df = spark.createDataFrame([(n,) for n in NAMES] + [(None,)], "name string")
    rows = {r.name: r for r in unify.unified(df).collect()}
    assert rows.keys() == set(NAMES)
    assert {n: rows[n].skeleton for n in NAMES} == {n: plain(n) for n in NAMES}
    assert {n: rows[n].form for n in NAMES} == {n: plain(n, False) for n in NAMES}


def test_distinct_marks_stay_distinct():
    assert plain("Nube") != plain("Núbe") and plain("a") != plain("A") and plain("x²") != plain("x2")


def test_random_names(spark):
    letters = st.text(alphabet="aAéоеⅢ ﾊﾟガガᄀ각ᅡᆨ゙̧̣́​­ト卜口ロ", min_size=1, max_size=8)
    names: set[str] = set()

    @settings(max_examples=400, deadline=None)
    @given(letters)
    def gather(x):
        names.add(x)

    gather()
    rows = unify.unified(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert all(r.skeleton == plain(r.name) for r in rows), [(r.name, r.skeleton, plain(r.name)) for r in rows if r.skeleton != plain(r.name)][:3]


def test_pairs(spark):
    schema = "id long, language string, name string, is_alias boolean, normalized string"
    rows = [
        (1, "en", "Rose", True, "rose"), (2, "en", "Rоse", True, "rose"), (3, "en", "Rose", True, "rosé"), (4, "en", "Rose", True, "rose"), (5, "ko", "Rose", True, "rose"),
        (6, "en", "Rose ", False, None), (7, "en", "rose", False, None), (8, "en", None, True, "x"), (9, "en", "Rose", True, None), (10, "", "Ⅲ", False, None), (11, "", "III", False, None), (6, "en", "Rose ", False, None),
    ]
    got = {tuple(r) for r in unify.alike_pairs(spark.createDataFrame(rows, schema)).collect()}
    alive = [r for r in rows if r[2] is not None]
    want = set()
    for a in alive:
        for b in alive:
            same = a[1] == b[1] and plain(a[2]) == plain(b[2])
            if a[0] < b[0] and same and (a[2] != b[2] or (a[3] and b[3] and a[4] != b[4])):
                want.add((a[0], b[0]))
    assert got == want
