"""Visually identical text stored with different characters (problem 1).

Names that hold a character which can change are exploded to positioned code points (all others are their own form); a
broadcast mapping removes what does not show, unifies spaces, decomposes, and (for the comparison form) replaces
look-alike letters; combining marks are ordered by class, marks and Hangul letters are recomposed, and the strings are
rebuilt. All of it runs where the distinct name lies: after the names are made distinct nothing is shuffled.

Two forms come out: ``form`` keeps the letters that were meant (only writing variants are unified), ``skeleton`` also
maps letters of the same shape in other scripts to one of them and is what comparisons use.

Defined results
  null names are left out; names of which nothing shows have the empty form and skeleton, and so equal one another.
  repeated rows are compared by their ids; equal ids never form a pair.
  null languages compare equal to null languages only.
  order of combining marks of different classes, spaces at the ends and the kind of a space do not matter; letter
  case, accents, and the number of spaces between words do.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.session import materialize, table

#: Letters of the same shape, each group with the letter that stands for it.
LOOKALIKES = {
    # Latin <- Cyrillic, Greek, Armenian, Cherokee, others
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟⅭꓚ", "D": "ᎠⅮꓓ", "E": "ЕΕᎬꓰ", "F": "ϜꓝҒ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧ", "I": "ІΙӀᏆꓲ", "J": "ЈͿᎫꓙ",
    "K": "КΚᏦꓗ", "L": "ᏞⅬꓡ", "M": "МΜϺᎷꓟ", "N": "ΝꓠԠ", "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ",
    "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫ", "Y": "ҮΥꓬ", "Z": "ΖᏃꓜ",
    "a": "аα", "b": "Ьᖯ", "c": "сϲ", "d": "ԁժ", "e": "еҽ", "f": "ք", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "k": "κк", "l": "ӏ", "m": "м", "n": "ոп",
    "o": "оοօ", "p": "рρ", "q": "ԛզ", "r": "г", "s": "ѕ", "u": "υսц", "v": "ѵν", "w": "ԝѡա", "x": "хχ", "y": "уγү", "z": "ᴢ",
    # Katakana <- ideographs and Hiragana
    "カ": "力", "タ": "夕", "ト": "卜", "ニ": "二", "ハ": "八", "ロ": "口囗", "エ": "工", "オ": "才", "ミ": "三", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ", "リ": "り", "ノ": "丿", "チ": "千", "メ": "乄", "ー": "一",
    # Marks
    "-": "‐‑⁃−˗",
}
#: Letters that only seem to be the same: left alone although tables of confusable characters list them.
NOT_ALIKE = set("αкмпгцᖯҒԠԳҽքցυսκЬνᴢ")
#: Kinds of compatibility decomposition that keep the look.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>"}


def _shows_not(c: str) -> bool:
    """Default-ignorable and control characters."""
    n = ord(c)
    if c in "\t\n\x0b\x0c\r\x85":
        return False
    return unicodedata.category(c) in ("Cf", "Cc") or n in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x2065) or 0x180B <= n <= 0x180F or 0xFE00 <= n <= 0xFE0F or 0xE0000 <= n <= 0xE0FFF


def _decompose(c: str) -> str:
    """Full decomposition that keeps the look; Hangul syllables stay whole."""
    if "가" <= c <= "힣":
        return c
    parts = unicodedata.decomposition(c).split()
    if not parts or (parts[0][0] == "<" and parts[0] not in SAME_LOOK):
        return c
    return "".join(_decompose(chr(int(x, 16))) for x in parts if x[0] != "<")


@cache
def mapping_rows() -> tuple[tuple[int, int, int, int, int], ...]:
    """(code, n, target, skeleton target, class): one row per character that a code point becomes (n counts them; a
    code point that does not show has none). Built from the character database; about 10,000 rows."""
    alike = {x: k for k, group in LOOKALIKES.items() for x in group if x not in NOT_ALIKE}
    rows = []
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        if _shows_not(c):
            rows.append((code, -1, 0, 0, 0))
            continue
        target = " " if c.isspace() or unicodedata.category(c) == "Zs" else _decompose(c)
        skeleton = "".join(_decompose(alike.get(x, x)) for x in target)
        if target != c or skeleton != c or unicodedata.combining(c):
            rows += [(code, n, ord(x), ord(y), unicodedata.combining(x)) for n, (x, y) in enumerate(zip(target, skeleton))]
    return tuple(rows)


@cache
def composition_rows() -> tuple[tuple[int, int, int], ...]:
    """(first, mark, composed): the canonical compositions, about 1,000."""
    rows = []
    for code in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(code)) == chr(code):
            rows.append((int(parts[0], 16), int(parts[1], 16), code))
    return tuple(rows)


@cache
def changing() -> tuple[str, str]:
    """The characters that the mapping changes or whose place matters (marks, Hangul letters), and those whose look-alike
    differs: a name without the first is its own form, one without the second has its form as its skeleton."""
    rows = mapping_rows()
    return "".join(map(chr, sorted({r[0] for r in rows} | set(range(0x1100, 0x1200))))), "".join(map(chr, sorted({r[0] for r in rows if r[2] != r[3]})))


def _recompose(runs: DataFrame, compositions: DataFrame) -> DataFrame:
    """One step of composing: the first unblocked mark of each run that composes with its starter is taken in.

    No canonical composition takes in more than three marks, so three steps reach the end. Marks are ordered by class, so
    a mark is unblocked if the one before it is of another class."""
    keys = ["name", "kind", "run"]
    numbered = F.expr("transform(marks, (m, i) -> struct(i as k, m.ccc as ccc, m.cp as cp, i = 0 or marks[greatest(0, i - 1)].ccc <> m.ccc as free))")
    marks = runs.select(*keys, "starter", F.explode_outer(numbered).alias("m"))
    hits = marks.join(F.broadcast(compositions), (F.col("starter") == F.col("first")) & (F.col("m.cp") == F.col("mark")) & F.col("m.free"), "left")
    taken = F.min_by(F.struct("composed", "m.k"), F.when(F.col("composed").isNotNull(), F.col("m.k")))
    kept = F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("m.k", "m.ccc", "m.cp"))))
    done = hits.groupBy(*keys).agg(F.first("starter").alias("starter"), taken.alias("hit"), kept.alias("marks"))
    rest = F.expr("transform(filter(marks, m -> hit is null or m.k <> hit.k), m -> struct(m.ccc as ccc, m.cp as cp))")
    return done.select(*keys, F.coalesce("hit.composed", "starter").alias("starter"), rest.alias("marks"))


def _rebuilt(points: DataFrame) -> DataFrame:
    """(name, kind, text) from positioned code points: marks ordered by class, recomposed, joined to strings."""
    spark = points.sparkSession
    compositions = spark.createDataFrame(composition_rows(), "first int, mark int, composed int")
    by_place = W.partitionBy("name", "kind").orderBy("pos", "n")
    numbered = points.withColumn("run", F.sum((F.col("ccc") == 0).cast("int")).over(by_place))
    ordered = F.array_sort(F.collect_list(F.when(F.col("ccc") > 0, F.struct("ccc", "pos", "n", "cp"))))
    runs = numbered.groupBy("name", "kind", "run").agg(F.max(F.when(F.col("ccc") == 0, F.col("cp"))).alias("starter"), ordered.alias("marks"))
    runs = runs.withColumn("marks", F.transform("marks", lambda m: F.struct(m["ccc"].alias("ccc"), m["cp"].alias("cp"))))
    for _ in range(3):
        runs = _recompose(runs, compositions)
    tail = F.array_join(F.transform("marks", lambda m: _char(m["cp"])), "")
    # Hangul: leading and vowel letters (and a trailing one) become a syllable, unless a mark stands between them.
    at = F.struct("run", F.col("starter").alias("cp"), (F.size("marks") == 0).alias("bare"), tail.alias("tail"))
    names = runs.groupBy("name", "kind").agg(F.array_sort(F.collect_list(at)).alias("runs"))
    return names.select("name", "kind", F.trim(F.array_join(F.transform("runs", _piece), "")).alias("text"))


def _piece(at: Column, i: Column) -> Column:
    """What a run becomes, with an eye on its neighbours: its character and marks, a syllable, or nothing."""
    near = lambda step: F.get("runs", i + step)
    lead = lambda x: x["cp"].between(0x1100, 0x1112)
    vowel = lambda x: x["cp"].between(0x1161, 0x1175)
    trail = lambda x: x["cp"].between(0x11A8, 0x11C2)
    open_ = lambda x: x["cp"].between(0xAC00, 0xD7A3) & ((x["cp"] - 0xAC00) % 28 == 0)
    a1, a2, b1, b2 = near(1), near(2), near(-1), near(-2)
    plain = F.concat(F.coalesce(_char(at["cp"]), F.lit("")), at["tail"])
    opens, closes = lead(at) & at["bare"] & vowel(a1), a1["bare"] & trail(a2)
    syllable = F.lit(0xAC00) + ((at["cp"] - 0x1100) * 21 + (a1["cp"] - 0x1161)) * 28
    built = F.when(opens & closes, F.concat(_char(syllable + a2["cp"] - 0x11A7), a2["tail"])).when(opens, F.concat(_char(syllable), a1["tail"]))
    built = built.when(open_(at) & at["bare"] & trail(a1), F.concat(_char(at["cp"] + a1["cp"] - 0x11A7), a1["tail"]))
    before = b1["bare"] & ((vowel(at) & lead(b1)) | (trail(at) & (open_(b1) | (vowel(b1) & lead(b2) & b2["bare"]))))
    # Only Hangul letters and open syllables look around.
    hangul = at["cp"].between(0x1100, 0x11FF) | open_(at)
    return F.when(~F.coalesce(hangul, F.lit(False)), plain).otherwise(F.coalesce(F.when(before, "").otherwise(built), plain))


def _char(code) -> Column:
    """The character of a code point (SQL's char() knows Latin-1 only)."""
    code = F.col(code) if isinstance(code, str) else code
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def unified(names: DataFrame) -> DataFrame:
    """(name, form, skeleton) of each distinct name of column ``name``."""
    spark = names.sparkSession
    mapping = spark.createDataFrame(mapping_rows(), "code int, n int, target int, skel int, ccc int")
    distinct = names.select("name").filter("name is not null").distinct()
    any_change, alike = (F.translate("name", x, "") != F.col("name") for x in changing())
    touched = distinct.select("name", any_change.alias("changes"), alike.alias("alike"))
    own = touched.filter("not changes").select("name", F.trim("name").alias("form"), F.trim("name").alias("skeleton"))
    code = F.conv(F.hex(F.encode("c", "UTF-32")), 16, 10).cast("int")
    points = touched.filter("changes").select("name", "alike", F.posexplode(F.split("name", "")).alias("pos", "c")).filter("c <> ''").select("name", "alike", "pos", code.alias("code"))
    mapped = points.join(F.broadcast(mapping), "code", "left").filter("n is null or n >= 0")
    both = F.expr("explode(if(alike, array(struct(0 as kind, coalesce(target, code) as cp), struct(1 as kind, coalesce(skel, code) as cp)), array(struct(0 as kind, coalesce(target, code) as cp)))) as k")
    shown = mapped.select("name", "pos", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ccc", F.lit(0)).alias("ccc"), both)
    texts = _rebuilt(shown.select("name", "k.kind", "pos", "n", "k.cp", "ccc"))
    built = texts.groupBy("name").agg(F.max(F.when(F.col("kind") == 0, F.col("text"))).alias("form"), F.max(F.when(F.col("kind") == 1, F.col("text"))).alias("skeleton"))
    # Names of which nothing shows have no code point left.
    forms = touched.filter("changes").select("name").join(built, "name", "left")
    return own.unionByName(forms.select("name", F.coalesce("form", F.lit("")).alias("form"), F.coalesce("skeleton", "form", F.lit("")).alias("skeleton")))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = table(spark, sf_dir, "aliases").select(F.col("row_id").alias("id"), F.coalesce("language", F.lit("")).alias("language"), "name", F.lit(True).alias("is_alias"), "normalized")
    titles = table(spark, sf_dir, "localizations").select(F.col("loc_id").alias("id"), F.coalesce("language", F.lit("")).alias("language"), F.col("title").alias("name"), F.lit(False).alias("is_alias"), F.lit(None).cast("string").alias("normalized"))
    return aliases.unionByName(titles).filter("name is not null")


def alike_pairs(rows: DataFrame) -> DataFrame:
    """(id_a, id_b) of rows (id, language, name, is_alias, normalized) that look the same but differ as stored.

    Writings, not rows, are paired: exact copies share one writing, so a hot name costs one row per writing until the
    wanted pairs themselves are written."""
    looks = materialize(unified(rows))
    rows = rows.withColumn("normalized", F.when(F.col("is_alias"), F.coalesce("normalized", F.lit("\u0000")))).join(looks.select("name", "skeleton"), "name")
    rows = materialize(rows.withColumn("writing", F.sha2(F.concat_ws("\u0001", "language", "name", F.col("is_alias").cast("string"), F.coalesce("normalized", F.lit("\u0002"))), 256)))
    writings = rows.groupBy("writing").agg(*(F.first(c).alias(c) for c in ("language", "skeleton", "name", "is_alias", "normalized")))
    several = writings.groupBy("language", "skeleton").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("language", "skeleton")
    writings = materialize(writings.join(several, ["language", "skeleton"], "left_semi"))
    a, b = writings.alias("a"), writings.alias("b")
    differ = (F.col("a.name") != F.col("b.name")) | (F.col("a.is_alias") & F.col("b.is_alias") & (F.col("a.normalized") != F.col("b.normalized")))
    pairs = a.join(b, (F.col("a.language") == F.col("b.language")) & (F.col("a.skeleton") == F.col("b.skeleton")) & (F.col("a.writing") < F.col("b.writing")) & differ)
    pairs = pairs.select(F.col("a.writing").alias("wa"), F.col("b.writing").alias("wb"))
    ids = rows.select("id", "writing")
    out = pairs.join(ids.select(F.col("id").alias("x"), F.col("writing").alias("wa")), "wa").join(ids.select(F.col("id").alias("y"), F.col("writing").alias("wb")), "wb")
    return out.filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b) of names that look the same but differ in their characters."""
    return alike_pairs(_names(spark, sf_dir))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct name of all three columns with its consistent form and its skeleton."""
    names = _names(spark, sf_dir)
    return unified(names.select("name").union(names.filter("normalized is not null").select("normalized")))
