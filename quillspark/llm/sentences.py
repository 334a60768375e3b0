"""Sentence boundaries across languages and scripts (problem 3), all in SQL expressions.

Dots of decimals, addresses, initials and abbreviations, ellipses and every mark inside quotation marks or brackets
are replaced by private-use placeholders of the same length; the text is cut after the terminators that remain; the
sentences are taken from the original text by position, which restores it.

Defined results
  null, empty or blank text: no sentence.
  private-use characters in the text itself stay in the sentences; they never count as marks.
  a document that occurs twice gives its sentences twice.
  languages without rules of their own are read like English, with the terminators of all scripts.
  Thai, which has no mark at the end of a sentence, is cut at spaces between Thai letters.
  texts, lines and quotations of any length: every pattern is possessive or starts at the head of its run only, so the
  work grows with the text (sums of lengths with its power 1.5) and no pattern recurses per character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import table

KINDS = ("detail", "volume", "story", "avatar_stories", "avatar_quotes")

# Placeholders. MASK: a mark that ends nothing; INNER: a mark inside quotation marks or brackets; CUT: a boundary;
# OPEN: a straight quotation mark that opens; SPARE: what stands for these characters if the text has them.
MASK, INNER, CUT, SPARE, OPEN = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"
#: Marks that end a sentence wherever they stand: East Asian, Indic dandas, Arabic and Urdu, Ethiopic, Armenian, Burmese, Khmer.
WIDE = "。．！？｡⁉‼⁇⁈।॥؟۔።፧։။។៕"
TERMINATORS = "!?" + WIDE
CLOSERS = r"”’\"」』》〉）)\]】〕"
#: Quoted and bracketed spans within a line; an apostrophe inside a word closes nothing, unless nothing else does.
SPANS = (
    r"“[^“”\n\r]*”", r"‘(?:[^‘’\n\r]++|’(?=\p{L}))*+’", r"‘[^‘\n\r]*’", r'"[^"\n\r]*"', r"「(?:[^「」\n\r]++|「[^「」\n\r]*+」)*+」", r"『[^『』\n\r]*』",
    r"《[^《》\n\r]*》", r"〈[^〈〉\n\r]*〉", r"（[^（）\n\r]*）", r"\([^()\n\r]*\)", r"\[[^\[\]\n\r]*\]", r"【[^【】\n\r]*】", r"〔[^〔〕\n\r]*〕",
)
OPENERS = "“‘\"「『《〈（([【〔"

# Abbreviations that never end a sentence, and those that do not before a number.
TITLES = "Dr|Mr|Mrs|Ms|Prof|St|Gen|Brig|Sgt|Capt|Lt|Col|Maj|Adm|Cmdr|Rev|Hon|Mt|Ft|Messrs|Pres|Gov|Sen|Rep|Jr|Sr|approx|ca|cf|vs|viz|ret|al|esp|incl|resp|Ver|ver"
BEFORE_NUMBER = "No|Nos|no|nos|Vol|Vols|vol|vols|p|pp|P|Pp|Fig|Figs|fig|figs|Ch|ch|Sec|sec|Art|art|Eq|eq|Pt|pt|c|v|Nr|nr"
#: Further abbreviations by language; those of dates and counts only where a number or name goes on.
ABBREVIATIONS = {
    "de": "z|B|d|h|u|a|bzw|usw|etc|ggf|evtl|vgl|Nr|Abb|Str|Hr|Fr|Dr|Prof|sog|ca|inkl|exkl|bspw|zzgl|geb|gest|Jh|Chr|Mio|Mrd|Bd|Hrsg",
    "fr": "M|MM|Mme|Mlle|Mgr|Me|av|apr|env|ex|fig|vol|chap|cf|art|éd|boul|tél",
    "es": "Sr|Sra|Srta|Dr|Dra|Ud|Uds|D|Dña|pág|págs|núm|Av|ej|aprox|tel|vol|cap|art",
    "it": "Sig|Sigg|Dott|Prof|Ing|Avv|ecc|pag|cap|art|es|tel|vol",
    "pt": "Sr|Sra|Dr|Dra|Exmo|pág|núm|Av|ex|aprox|tel|vol|cap|art",
    "ru": "г|гг|в|вв|т|д|п|н|э|см|рис|стр|ул|им|др|пр|тыс|млн|млрд|проф|акад",
}
#: What follows a German ordinal with its dot.
AFTER_ORDINAL = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|Jahrtausend|Kapitel|Auflage|Stock|Klasse|Platz|Mal|Weltkrieg"

SAID_KO = r"(?:말했|물었|외쳤|대답했|속삭였|중얼거렸|명령했|명했|생각했|소리쳤|되물었|덧붙였)(?:다|습니다|어요|지)"
SAID_JA = r"(?:命じた|言った|尋ねた|叫んだ|答えた|つぶやいた|呟いた|ささやいた|囁いた|思った|問うた|問いかけた|言いました|尋ねました)"
SAID_ZH = r"(?:说|问|喊|想|回答|(?<!知)道)"
SAID_EN = r"(?:said|asked|cried|answered|whispered|muttered|shouted|replied|added|called|exclaimed|murmured)"


def _mask_dots(text: Column) -> Column:
    """Dots, and runs of dots, that end no sentence."""
    out = F.translate(text, MASK + INNER + CUT + OPEN, SPARE * 4)
    out = F.regexp_replace(out, r"(?<=\.)\.|\.(?=\.)|…", MASK)  # ellipses
    out = F.regexp_replace(out, r"(?<=\d)\.(?=\d)", MASK)  # decimals, versions
    out = F.regexp_replace(out, r"(?<=[\p{L}\p{N}])\.(?=\p{Ll})", MASK)  # addresses, inner dots of e.g., a.m.
    out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}])({TITLES}|i{MASK}e|e{MASK}g)\.", "$1" + MASK)
    out = F.regexp_replace(out, rf"(?U)(?<![\p{{L}}\p{{N}}])({BEFORE_NUMBER})\.(?=\s?\d)", "$1" + MASK)
    out = F.regexp_replace(out, r"(?U)(?<![\p{L}\p{N}'’])(\p{Lu})\.(?=\s?(?:<[^<>\n]*>)?\p{Lu})", "$1" + MASK)  # initials
    return F.regexp_replace(out, rf"(?U)(\b(?:At|By|Around|Before|After|Until|Since|From)\s[\d:{MASK}]+\s?[ap]{MASK}m)\.", "$1" + MASK)


def _mask_own(dots: Column, language: Column) -> Column:
    """The abbreviations and ordinals of a language of its own. ``dots`` has to be a column of its own."""
    tongue, own = F.lower(F.split_part(language, F.lit("-"), F.lit(1))), dots
    for name, words in ABBREVIATIONS.items():
        short = F.regexp_replace(dots, rf"(?U)(?<![\p{{L}}\p{{N}}])({words})\.(?!\s*$|\s*\R)", "$1" + MASK)
        if name == "de":
            short = F.regexp_replace(short, rf"(?U)(?<![\p{{L}}\p{{N}}])(\d{{1,3}})\.(?=\s?(?:{AFTER_ORDINAL})\b)", "$1" + MASK)
        own = F.when(tongue == name, short).otherwise(own)
    return own


#: What the span masks run over: quoted and bracketed spans, what lies between them, and openers without an end.
_OPENERS = "".join("\\" + c if c in "[(" else c for c in OPENERS)
SEGMENTS = "|".join(SPANS) + rf"|[^{_OPENERS}]+|[{_OPENERS}]"


def _mask_spans(segments: Column, language: Column) -> Column:
    """Marks inside quotation marks and brackets. One that closes the span is kept apart as INNER. ``segments`` has to be
    a column of its own: each element looks at the one before it."""
    marks = "." + TERMINATORS

    def masked(x: Column, i: Column) -> Column:
        body = F.regexp_replace(F.translate(x, marks, MASK * len(marks)), '^"', OPEN)
        ends = F.rlike(F.right(x, F.lit(2)), F.lit(rf"[.{TERMINATORS}][{CLOSERS}]$"))
        before = F.coalesce(F.get(segments, i - 1), F.lit("\n"))
        # Titles never end a sentence; nor, in Chinese, a quotation that continues the words before it.
        inside = F.rlike(x, F.lit(r"^[『《〈]")) | ((language == "zh-Hans") & F.rlike(x, F.lit(r"^[“‘「]")) & F.rlike(before, F.lit(rf"[^\s:：.{TERMINATORS}{CLOSERS}]\z")))
        kept = F.concat(body.substr(F.lit(1), F.length(body) - 2), F.lit(INNER), F.right(body, F.lit(1)))
        return F.when(F.rlike(x, F.lit(rf"^[{_OPENERS}]")) & (F.length(x) > 1), F.when(ends & ~inside, kept).otherwise(body)).otherwise(x)

    return F.array_join(F.transform(segments, masked), "")


def _cut(masked: Column, language: Column) -> Column:
    """The masked text with a CUT after every sentence."""
    wide = WIDE
    out = F.regexp_replace(masked, r"\R", "$0" + CUT)
    # Wide terminators end a sentence wherever they stand.
    # Every run of marks is tried from its head only: a later start could not end elsewhere.
    out = F.regexp_replace(out, rf"(?<![{wide}!?])[{wide}!?]*[{wide}][{wide}!?{MASK}]*[{CLOSERS}]*", "$0" + CUT)
    # Narrow ones need something that can begin a sentence after them.
    begin = rf"(?=\s*$|\s*\R|\s+[^\s\p{{Ll}}]|[\p{{Lu}}\p{{Lo}}{OPEN}{OPENERS.replace('[', '').replace('(', '')}(\[<])"
    dots = F.regexp_replace(out, rf"(?U)(?<![.!?])[.!?]+(?:{MASK}(?=\s))?[{CLOSERS}]*{begin}", "$0" + CUT)
    dots = F.regexp_replace(dots, r"[!?][" + CLOSERS + r"]*(?=\d)|(?<=\p{Ll})\.(?=\d)", "$0" + CUT)
    marks = F.regexp_replace(out, rf"(?<![!?])[!?]+[{CLOSERS}]*(?![!?{CLOSERS}])", "$0" + CUT)
    thai = F.regexp_replace(dots, r"(?<=[\u0e01-\u0e45\u0e47-\u0e4e]) +(?=[\u0e01-\u0e45])", "$0" + CUT)
    out = F.when(language.isin("ja", "zh-Hans"), marks).when(language == "th", thai).otherwise(dots)
    # A closing mark after a closed sentence, unless its clause of saying or asking, or a particle, follows.
    closed = rf"{INNER}[{CLOSERS}]+(?![{CLOSERS}.{TERMINATORS}、，,;；:：{CUT}])"
    stop = rf"[.{TERMINATORS}{MASK}{CUT}\n\r]|$"
    en = rf"(?U){closed}(?=\s+[^\s\p{{Ll}}]|[\p{{Lu}}{OPEN}“‘\"(\[<])(?!\s+(?:\p{{Lu}}\S*\s+){{1,3}}{SAID_EN}(?!\s+that)\b)"
    ko = rf"(?U){closed}(?!이?라[고는며면]|하고|하며)(?!\s+하고\s)(?!\s*[^\s“”‘’\"]+(?:이|가|은|는)\s[^“”‘’\"{TERMINATORS}.\n]{{0,20}}?{SAID_KO}(?:{stop}))"
    ja = rf"{closed}(?!と|って|は(?!い)|が|を|に|の|も(?!う)|で(?!も)|から|まで)(?![^「」『』{TERMINATORS}\n]{{1,30}}{SAID_JA}(?:{stop}))"
    zh = rf"{closed}(?![^“”‘’「」{TERMINATORS}\n]{{1,30}}{SAID_ZH}(?:{stop}))"
    cut = lambda rule: F.regexp_replace(out, rule, "$0" + CUT)
    return F.when(language == "ko", cut(ko)).when(language == "ja", cut(ja)).when(language == "zh-Hans", cut(zh)).otherwise(cut(en))


def _blocked(sizes: str) -> Column:
    """Sentences in blocks: start and length of each block, its first ordinal, and the start and end of its sentences.

    A running sum kept in an array copies it at every step; over blocks of about as many pieces as there are blocks the
    copies stay small."""
    step = F.expr(f"greatest(1, cast(ceil(sqrt(size({sizes}))) as int))")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(sizes) - 1), step), lambda i: F.slice(sizes, i + 1, step))
    spans = F.array().cast("array<struct<start:int,end:int>>")
    blank = F.struct(F.lit(0).alias("size"), spans.alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        span = F.struct((acc["size"] + x["l"]).alias("start"), (acc["size"] + x["t"]).alias("end"))
        return F.struct((acc["size"] + x["w"]).alias("size"), F.when(x["t"] > 0, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.transform(parts, lambda part: F.aggregate(part, blank, add))


def _placed(blocks: str) -> Column:
    """The blocks with where each begins: (at, first, size, spans)."""
    start = F.expr("struct(0 as at, 0 as first, cast(array() as array<struct<at:int,first:int>>) as heads)")

    def add(acc: Column, b: Column) -> Column:
        head = F.struct(acc["at"].alias("at"), acc["first"].alias("first"))
        return F.struct((acc["at"] + b["size"]).alias("at"), (acc["first"] + F.size(b["spans"])).alias("first"), F.concat(acc["heads"], F.array(head)).alias("heads"))

    heads = F.aggregate(blocks, start, add, lambda acc: acc["heads"])
    return F.zip_with(blocks, heads, lambda b, h: F.struct(h["at"].alias("at"), h["first"].alias("first"), b["size"].alias("size"), b["spans"].alias("spans")))


def with_blocks(documents: DataFrame) -> DataFrame:
    """Adds ``blocks``: runs of neighbouring sentences, placed in code points of the text (spans count from their block)."""
    language = F.coalesce(F.col("language"), F.lit(""))
    # A column per step: what a later step uses more than once is then evaluated once.
    out = documents.withColumn("_dots", _mask_dots(F.col("text")))
    out = out.withColumn("_segments", F.regexp_extract_all(_mask_own(F.col("_dots"), language), F.lit(SEGMENTS), F.lit(0)))
    out = out.withColumn("_masked", _mask_spans(F.col("_segments"), language))
    out = out.withColumn("_pieces", F.split(_cut(F.col("_masked"), language), CUT, -1))
    pieces = F.col("_pieces")
    whole = F.transform(pieces, F.length)
    trimmed = F.transform(pieces, lambda p: F.length(F.regexp_replace(p, r"(?U)(?<![\s\x00-\x1f])[\s\x00-\x1f]+$", "")))
    led = F.transform(pieces, lambda p: F.length(p) - F.length(F.regexp_replace(p, r"(?U)^[\s\x00-\x1f]+", "")))
    out = out.withColumn("_sizes", F.arrays_zip(whole.alias("w"), trimmed.alias("t"), led.alias("l")))
    out = out.withColumn("_blocks", _blocked("_sizes"))
    return out.withColumn("blocks", _placed("_blocks")).drop("_dots", "_segments", "_masked", "_pieces", "_sizes", "_blocks")


def with_ends(documents: DataFrame) -> DataFrame:
    """Adds ``spans``: start and end of every sentence, in code points of the text."""
    spans = F.transform("blocks", lambda b: F.transform(b["spans"], lambda s: F.struct((b["at"] + s["start"]).alias("start"), (b["at"] + s["end"]).alias("end"))))
    return with_blocks(documents).withColumn("spans", F.flatten(spans)).drop("blocks")


def sentences_of(texts: DataFrame, *keys: str) -> DataFrame:
    """(*keys, ordinal, start_char, end_char, sentence) of every sentence of (*keys, language, text).

    A sentence is taken from its block and the block from the text, so long texts are not read again for each."""
    rows = with_blocks(texts.filter("text is not null")).select(*keys, "text", F.explode_outer("blocks").alias("b")).filter("b is not null")
    rows = rows.select(*keys, "b.at", "b.first", "b.spans", F.expr("substring(text, b.at + 1, b.size)").alias("part"))
    rows = rows.select(*keys, "at", "first", "part", F.posexplode_outer("spans").alias("k", "s")).filter("k is not null")
    return rows.select(*keys, (F.col("first") + F.col("k")).alias("ordinal"), (F.col("at") + F.col("s.start")).alias("start_char"), (F.col("at") + F.col("s.end")).alias("end_char"), F.expr("substring(part, s.start + 1, s.end - s.start)").alias("sentence"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.col("document_kind").isin(*KINDS)).select("doc_id", "language", "text").filter("text is not null")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, end_char) of every sentence of the prose kinds."""
    # explode() would make the optimizer test the array before it, and evaluate all of it again for that.
    return with_ends(_documents(spark, sf_dir)).select("doc_id", F.explode_outer(F.col("spans.end")).alias("end_char")).filter("end_char is not null")


def p3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document of every kind: (doc_id, ordinal, start_char, end_char, sentence)."""
    return sentences_of(table(spark, sf_dir, "documents").select("doc_id", "language", "text"), "doc_id")


def p3_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every text unit: (unit_seq, ordinal, start_char, end_char, sentence)."""
    return sentences_of(table(spark, sf_dir, "text_units").select("unit_seq", "language", "text"), "unit_seq")
