"""Text kernel: cleaning, keys, units, identifiers. Column expressions only, so they stay in generated code.

``casefold`` is written as ``lower`` here; the two differ for a few letters (the German sharp s, final sigma).
White space at the ends means Unicode white space, as far as one class can name it in both SQL dialects.
Null gives null in every function unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
#: Labels that are no speaker, titles that say nothing.
NO_SPEAKER = ("title", "description", "parentTitle", "role", "tips")
GENERIC_TITLES = ("", "Other Undefined", "undefined", "none", "null")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def clean_text(c: Column) -> Column:
    """Without markup, with unified line ends, runs of blanks and of empty lines shortened, stripped."""
    c = F.regexp_replace(c, r"<color=#[0-9A-Fa-f]+>|</color>|</?i>", "")
    c = F.replace(c, F.lit("\\n"), F.lit("\n"))
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def normalize_alias(c: Column) -> Column:
    """The key under which names are compared: cleaned, lower case, no white space at all."""
    return F.regexp_replace(F.lower(clean_text(c)), rf"{WS}+", "")


def compact(c: Column) -> Column:
    """Cleaned, with no white space at all, letter case kept."""
    return F.regexp_replace(clean_text(c), rf"{WS}+", "")


def safe_int(c: Column, default: int) -> Column:
    """The whole number that a text is, else the default (also for null)."""
    bare = strip(c)
    return F.coalesce(F.when(bare.rlike(r"^[+-]?[0-9]{1,18}$"), bare.cast("bigint")), F.lit(default).cast("bigint"))


def without_nulls(c: Column) -> Column:
    """A map without the entries whose value is null."""
    return F.map_filter(c, lambda _, v: v.isNotNull())


def normalize_for_hash(c: Column) -> Column:
    return F.lower(strip(F.regexp_replace(clean_text(c), rf"{WS}+", " ")))


def clean_alias(c: Column) -> Column:
    """A usable alias or null: no placeholder, 2 to 140 characters, not only digits."""
    text, key = clean_text(c), normalize_alias(c)
    bad = text.contains("$UNRELEASED") | F.lower(text).isin("unknown", "none", "null") | (F.length(text) > 140) | (F.length(key) < 2) | key.rlike(r"^\p{Nd}+$")
    return F.when(~bad, text)


def split_units(c: Column) -> Column:
    """Array of units: the lines of a block if it has several and none is long, else the block."""
    blocks = F.filter(F.transform(F.split(clean_text(c), rf"\n{WS}*\n"), strip), lambda b: b != "")

    def lines_of(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, r"\n"), strip), lambda x: x != "")
        return F.when((F.size(lines) > 1) & F.forall(lines, lambda x: F.length(x) <= 260), lines).otherwise(F.array(F.array_join(lines, "\n")))

    return F.flatten(F.transform(blocks, lines_of))


def speaker_of(c: Column) -> Column:
    """The speaker label before a colon; null if there is none."""
    name = strip(F.regexp_extract(c, r"(?s)^([^:\n]{1,60}):\s+(.+)$", 1))
    return F.when((name != "") & ~name.isin(*NO_SPEAKER), name)


def speech_of(c: Column) -> Column:
    """The text without its speaker label."""
    return F.when(speaker_of(c).isNotNull(), strip(F.regexp_extract(c, r"(?s)^([^:\n]{1,60}):\s+(.+)$", 2))).otherwise(strip(c))


def numbers_of(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?%?"), F.lit(0)))


def quoted_of(c: Column) -> Column:
    corner = F.regexp_extract_all(c, F.lit("「([^」]{1,40})」"), F.lit(1))
    return F.concat(corner, F.regexp_extract_all(c, F.lit('"([^"]{1,40})"'), F.lit(1)))


def safe_id(c: Column) -> Column:
    part = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}_.\-:]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(part == "", "unknown").otherwise(part)


def safe_path(c: Column, longest: int = 120) -> Column:
    text = F.regexp_replace(F.regexp_replace(clean_text(c), r'[<>:"/\\|?*\n]', " "), rf"{WS}+", " ")
    text = F.regexp_replace(strip(text), r"[ .]+$", "")
    text = F.regexp_replace(F.left(text, F.lit(longest)), r"[ .]+$", "")
    return F.when(text == "", "unknown").otherwise(text)


def slices(c: Column, size: int) -> Column:
    """Fixed-width pieces of a long text."""
    n = F.greatest(F.lit(1), F.ceil(F.length(c) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: c.substr(i * size + 1, F.lit(size)))


def is_generic_title(c: Column) -> Column:
    return c.isNull() | strip(c).isin(*GENERIC_TITLES)


#: The Latin letters with marks that the word index folds, and what they become.
_FOLD = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēĕėęěğĩīĭįńňōŏőŕřśšťũūŭůűźżž"
_BASE = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeeegiiiinnooorrsstuuuuuzzz"


def fold(c: Column) -> Column:
    return F.translate(F.lower(c), _FOLD, _BASE)


def tokens(c: Column) -> Column:
    """Words of the word index: runs of letters and digits, folded. Null has no words."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


class Sql:
    """The same kernel as SQL text, for the checks."""

    @staticmethod
    def strip(c: str) -> str:
        return rf"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"

    @classmethod
    def clean(cls, c: str) -> str:
        c = rf"regexp_replace({c}, '<color=#[0-9A-Fa-f]+>|</color>|</?i>', '', 'g')"
        c = rf"replace({c}, '\n', chr(10))"
        c = rf"regexp_replace({c}, '\r\n?', chr(10), 'g')"
        c = rf"regexp_replace({c}, '[ \t]+', ' ', 'g')"
        return cls.strip(rf"regexp_replace({c}, '\n{{3,}}', chr(10) || chr(10), 'g')")

    @classmethod
    def alias(cls, c: str) -> str:
        return rf"regexp_replace(lower({cls.clean(c)}), '{WS}+', '', 'g')"

    @classmethod
    def for_hash(cls, c: str) -> str:
        return "lower(" + cls.strip(rf"regexp_replace({cls.clean(c)}, '{WS}+', ' ', 'g')") + ")"

    @classmethod
    def units(cls, c: str) -> str:
        blocks = rf"[b FOR b IN [{cls.strip('b')} FOR b IN regexp_split_to_array({cls.clean(c)}, '\n{WS}*\n')] IF b <> '']"
        lines = f"[l FOR l IN [{cls.strip('l')} FOR l IN string_split(b, chr(10))] IF l <> '']"
        fits = f"len({lines}) > 1 AND len([m FOR m IN {lines} IF length(m) > 260]) = 0"
        return f"flatten([CASE WHEN {fits} THEN {lines} ELSE [array_to_string({lines}, chr(10))] END FOR b IN {blocks}])"

    @classmethod
    def speaker(cls, c: str) -> str:
        name = cls.strip(rf"regexp_extract({c}, '(?s)^([^:\n]{{1,60}}):\s+(.+)$', 1)")
        return f"CASE WHEN {name} <> '' AND {name} NOT IN {NO_SPEAKER} THEN {name} END"

    @classmethod
    def speech(cls, c: str) -> str:
        rest = cls.strip(rf"regexp_extract({c}, '(?s)^([^:\n]{{1,60}}):\s+(.+)$', 2)")
        return f"CASE WHEN ({cls.speaker(c)}) IS NOT NULL THEN {rest} ELSE {cls.strip(c)} END"

    @staticmethod
    def tokens(c: str) -> str:
        return rf"regexp_extract_all(translate(lower(coalesce({c}, '')), '{_FOLD}', '{_BASE}'), '[\p{{L}}\p{{N}}]+')"
