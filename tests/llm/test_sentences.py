"""Sentence boundaries: expected cuts in four languages, lossless restoring, edge cases."""

from __future__ import annotations

import pytest
from conftest import GIVEN

from quillspark.llm import sentences

# One list per text: its sentences in order. Joined by what separates them in the text.
CASES = [
    ("en", ["Dr. Kadeno met St. Mora at 9 a.m. near the gate.", "It cost 3.50 coins.", "See lore.example/v2.8 for more."], " "),
    ("en", ["“Run, Mora! The ring burns!”", "In the winter, nobody came."], " "),
    ("en", ["“Run! It burns!” cried Mora.", "\"Stop! Who goes there?\" asked the guard.", "The end"], " "),
    ("en", ["They left at 8 p.m.", "The road is long.", "At 5.30 a.m. Mora rang the bell."], " "),
    ("en", ["(The bell is in the ruins.)", "Mora... no, Kade broke it!", "J. R. Mora signed page No. 4 of it?!"], " "),
    ("en", ["The gate fell.", "Nobody saw it!", "\"Wait.\""], ""),
    ("ko", ["누베는 “왜?”라는 말만 남겼다.", "“멈춰! 누구냐?”라고 경비병이 물었다.", "“어서! 타고 있어!”", "미키는 걸었다."], " "),
    ("ko", ["‘누가 갔지?’ 하고 누베는 생각했다.", "“그만해. 내려놔.” 누베가 말했다.", "(지금 여기 있다.)", "No.3 문이다."], " "),
    ("ja", ["「止まれ！誰だ？」と衛兵が尋ねた。", "「急げ！燃えている！」", "ヌベは歩いた。", "『ヌベの剣。上巻』には話がある。", "本当か！？"], ""),
    ("ja", ["「置け。今だ。」ヌベはそう命じた。", "（今、ここにある。）", "Dr.ヌベはNo.2を選んだ｡", "ヌベ……いや、彼だ"], ""),
    ("zh-Hans", ["“等等。我听见了，”努贝说。", "“站住！是谁？”守卫问道。", "“快跑！着火了！”", "努贝只留下了“为什么？”这句话。", "到港口约3.5公里（步行2小时。雨天加倍）。"], ""),
    ("zh-Hans", ["努贝低声说：“不见了。”", "《谁偷了它？》是努贝写的书。", "你见过吗？！", "详情请看 lore.example/v3 的记录。"], ""),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_cuts(spark, case):
    language, parts, gap = CASES[case]
    text = gap.join(parts)
    df = spark.createDataFrame([(1, language, text)], "doc_id long, language string, text string")
    spans = sentences.with_ends(df).first()["spans"]
    assert [text[s.start : s.end] for s in spans] == parts


def test_edges(spark):
    rows = [(1, "en", ""), (2, "en", " \n　"), (3, None, "One. Two."), (4, "en", "Heading\r\nA: b. C.\n\nlast…  \n"), (5, "xx", "你好。再见。"), (6, "en", "x. Y."), (7, "en", "😀 Hi. 😀 Yes."), (8, "en", "“open. Never closed. (So"), (9, "en", "A. " * 3000), (9, "en", "A. " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, language string, text string")
    got: dict = {}
    for r in sentences.with_ends(df).collect():
        got.setdefault(r.doc_id, [r.text[s.start : s.end] for s in r.spans])
    assert got[1] == [] and got[2] == [] and got[3] == ["One.", "Two."] and got[5] == ["你好。", "再见。"]
    assert got[4] == ["Heading", "A: b.", "C.", "last…"]
    assert got[6] == ["x.", "Y."] and got[7] == ["😀 Hi.", "😀 Yes."]
    assert got[8] and len(got[9]) >= 1


def test_nothing_lost(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "text").collect()}
    pieces: dict = {}
    for r in sentences.p3_sentences(spark, GIVEN).collect():
        assert texts[r.doc_id][r.start_char : r.end_char] == r.sentence and r.sentence == r.sentence.strip()
        pieces.setdefault(r.doc_id, []).append((r.start_char, r.sentence))
    for doc, text in texts.items():
        kept = "".join(s for _, s in sorted(pieces.get(doc, [])))
        assert "".join(kept.split()) == "".join(c for c in (text or "").replace("\x1c", "") if not c.isspace()) or any(ord(c) < 32 for c in text)


SCRIPTS = [
    ("hi", ["यह पहला वाक्य है।", "दूसरा यहाँ है।", "तीसरा कौन सा है?"], " "),
    ("ur", ["یہ پہلا جملہ ہے۔", "کیا یہ دوسرا ہے؟"], " "),
    ("ar", ["هذه جملة أولى.", "هل هذه ثانية؟", "نعم."], " "),
    ("am", ["ሰላም ነው።", "ደህና ነኝ።"], " "),
    ("hy", ["Առաջին նախադասություն։", "Երկրորդը։"], " "),
    ("my", ["ပထမ။", "ဒုတိယ။"], " "),
    ("th", ["วันนี้อากาศดี", "เราไปตลาดกัน"], " "),
    ("de", ["Am 3. Mai kam z.B. Herr Dr. Kade.", "Das 19. Jahrhundert war lang.", "Er ging usw. weiter."], " "),
    ("fr", ["M. Kade est venu av. J.-C. ou plus tard.", "Il est parti."], " "),
    ("es", ["El Sr. Kade llegó ayer.", "La Sra. Mora no."], " "),
]


@pytest.mark.parametrize("case", range(len(SCRIPTS)))
def test_scripts(spark, case):
    language, parts, gap = SCRIPTS[case]
    text = gap.join(parts)
    df = spark.createDataFrame([(1, language, text)], "doc_id long, language string, text string")
    assert [text[s.start : s.end] for s in sentences.with_ends(df).first()["spans"]] == parts


def test_long_texts(spark):
    n = 1_000_000
    spans = ["「" + "あ" * n + "」", "‘" + "a b " * (n // 4) + "’", "‘" + "don’t " * (n // 6) + "’", "“" + "Ab. " * (n // 4) + "”", '"' + "ab. " * (n // 4) + '"', "『" + "あ。" * (n // 2) + "』", "（" + "あ。" * (n // 2) + "）", "(" + "!" * n + ")", "[" + "x. " * (n // 3) + "]", "「" + "「あ。」い" * (n // 5) + "」"]
    runs = ["A" + " " * n + "b", "!" * n + "a", "！" * n + "a", "." + ")" * n + "x", "漢" * n, "ab." * (n // 3), "😀a" * (n // 2)]
    texts = spans + runs
    df = spark.createDataFrame([(i, language, x) for i, x in enumerate(texts) for language in ("en", "ja")], "doc_id long, language string, text string").repartition(8)
    got = sentences.sentences_of(df, "doc_id", "language").groupBy("doc_id", "language").count().collect()
    assert len(got) == 2 * len(texts) and all(r["count"] == 1 for r in got if r.doc_id < len(spans))
    many = spark.createDataFrame([(1, "en", "Ab cd. " * 100_000)], "doc_id long, language string, text string")
    assert sentences.with_ends(many).selectExpr("size(spans) as k").first().k == sentences.sentences_of(many, "doc_id").count() == 100_000
