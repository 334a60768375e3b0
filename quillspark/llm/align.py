"""Sentence alignment in bilingual documents (problem 2).

Documents whose document_id differs only in the language part are counterparts. Their lines are points of a bitext
space: two lines are linked where words of one are translations of words of the other. The word translations come from
the corpus itself (which words meet in lines at the same relative height, over all counterparts). In that space chains
of points with a consistent slope are searched, each point looking for its predecessor in a rectangle that grows until
it holds one that is worth following; noisy points off the chain are filtered. Further chains are searched in what the
first leaves (moved passages), strong single points are inversions (moved lines), and chains become blocks of lines: points
that share a line, and the lines that two neighbouring points of the chain enclose.

Defined results
  null, empty or blank texts: no lines, no row.
  documents with more than one counterpart: every pair of two languages is aligned.
  rows repeated with the same doc_id and text: one document; document ids without a language part have no counterpart.
  counterparts that share too few links are unrelated texts: no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.session import materialize, table

#: Lines at the same relative height, give or take so many, are where translations are learned from.
BAND = 1
#: Least meetings of two words, least gain over chance. All translations that reach them count, by their score.
MEETINGS, GAIN = 3, 0.12
#: Least share of a line's weight that must be translated; least share of a text's lines that must be linked.
LINKED, MOVED, RELATED = 0.38, 0.6, 0.3
#: The same of a line that its neighbours enclose.
ENCLOSED = 0.25
#: Least mean share of translated weight over a pair's links; real translations stay well above it.
SURE = 0.58


def _words(text: Column, language: Column) -> Column:
    """Distinct features of a line: numbers; words; for scripts without spaces, runs and pairs of characters."""
    low = F.lower(text)
    found = lambda pattern: F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(text, r"(?<=\d)[,，](?=\d{3})", ""), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: F.concat(F.lit("#"), x))
    pairs = lambda c: F.flatten(F.transform(c, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x) - 1)), lambda i: x.substr(i, F.lit(2)))))
    korean = found(r"[\p{IsHangul}]+")
    stems = F.concat(F.transform(korean, lambda x: F.left(x, F.lit(2))), F.transform(F.filter(korean, lambda x: F.length(x) > 2), lambda x: F.left(x, F.lit(3))), F.transform(F.filter(korean, lambda x: F.length(x) == 2), lambda x: F.concat(F.left(x, F.lit(1)), F.lit("_"))))
    kana = found(r"[\p{IsKatakana}ー]+|[\p{IsHiragana}]{3,}")
    han = found(r"[\p{IsHan}]+")
    words = F.when(language == "ko", F.concat(stems, found(r"[a-z]+"))).when(language == "ja", F.concat(kana, han, pairs(F.filter(han, lambda x: F.length(x) > 2)))).when(language == "zh-Hans", pairs(han))
    return F.array_distinct(F.concat(numbers, words.otherwise(found(r"\p{L}+"))))


def line_table(documents: DataFrame) -> DataFrame:
    """(pair_key, language, doc_id, line, n_lines, words) of the non-blank lines of documents that have counterparts."""
    key = F.regexp_replace("document_id", r"^((?:[^:]*:){3})([^:]*)(.*)$", "$1*$3")
    keyed = documents.filter(F.col("document_id").rlike(r"^(?:[^:]*:){3}[^:]+") & F.col("text").rlike(r"\S")).select(key.alias("pair_key"), "language", "doc_id", "text")
    # One row per language and key is the rule; only keys and languages are shuffled to find counterparts.
    shared = keyed.groupBy("pair_key").agg(F.count_distinct("language").alias("k")).filter("k > 1").select("pair_key")
    texts = keyed.join(shared, "pair_key", "left_semi").dropDuplicates(["doc_id"])
    lines = F.filter(F.split("text", r"\R"), lambda x: F.rlike(x, F.lit(r"(?U)[^\s]")))
    rows = texts.select("pair_key", "language", "doc_id", lines.alias("lines")).withColumn("n_lines", F.size("lines"))
    rows = rows.select("pair_key", "language", "doc_id", "n_lines", F.posexplode("lines").alias("line", "text"))
    return materialize(rows.select("pair_key", "language", "doc_id", "n_lines", "line", _words(F.col("text"), F.col("language")).alias("words")))


def pair_table(lines: DataFrame) -> DataFrame:
    """(doc_x, doc_y, tongues, n_x, n_y): counterparts, the language that sorts first as x."""
    heads = lines.filter("line = 0").select("pair_key", "language", "doc_id", "n_lines")
    x, y = heads.alias("x"), heads.alias("y")
    joined = x.join(y, (F.col("x.pair_key") == F.col("y.pair_key")) & (F.col("x.language") < F.col("y.language")))
    return joined.select(F.col("x.doc_id").alias("doc_x"), F.col("y.doc_id").alias("doc_y"), F.concat_ws("|", "x.language", "y.language").alias("tongues"), F.col("x.n_lines").alias("n_x"), F.col("y.n_lines").alias("n_y"))


def lexicon(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(tongues, x, y, s): how much likelier y is in the band of a line with x than in any band; numbers are left out,
    they translate themselves."""
    no_numbers = lambda c: F.filter(c, lambda w: ~w.startswith("#"))
    xs = pairs.join(lines.select(F.col("doc_id").alias("doc_x"), F.col("line").alias("i"), no_numbers("words").alias("xw")), "doc_x")
    centre = F.round((F.col("i") + 0.5) * F.col("n_y") / F.col("n_x") - 0.5).cast("int")
    banded = xs.select("tongues", "doc_x", "doc_y", "i", "xw", F.explode(F.sequence(F.greatest(F.lit(0), centre - BAND), F.least(F.col("n_y") - 1, centre + BAND))).alias("j"))
    met = banded.join(lines.select(F.col("doc_id").alias("doc_y"), F.col("line").alias("j"), no_numbers("words").alias("yw")), ["doc_y", "j"])
    met = materialize(met.groupBy("tongues", "doc_x", "doc_y", "i").agg(F.first("xw").alias("xw"), F.array_distinct(F.flatten(F.collect_list("yw"))).alias("yw")))
    total = met.groupBy("tongues").agg(F.count(F.lit(1)).alias("n"))
    n_x = met.select("tongues", F.explode("xw").alias("x")).groupBy("tongues", "x").agg(F.count(F.lit(1)).alias("n_x")).filter(F.col("n_x") >= MEETINGS)
    n_y = met.select("tongues", F.explode("yw").alias("y")).groupBy("tongues", "y").agg(F.count(F.lit(1)).alias("n_y")).filter(F.col("n_y") >= MEETINGS)
    both = met.select("tongues", F.explode("xw").alias("x"), "yw").select("tongues", "x", F.explode("yw").alias("y")).groupBy("tongues", "x", "y").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= MEETINGS)
    scored = both.join(n_x, ["tongues", "x"]).join(n_y, ["tongues", "y"]).join(F.broadcast(total), "tongues")
    s = F.col("c") / F.col("n_x") - F.col("n_y") / F.col("n")
    # Few meetings prove little: the gain is lowered by its own uncertainty.
    s = s - F.sqrt(F.col("n_y") / F.col("n") / F.col("n_x"))
    scored = scored.select("tongues", "x", "y", "n_x", "n", s.alias("s"), (F.col("c") / F.col("n_y") - F.col("n_x") / F.col("n")).alias("back")).filter((F.col("s") >= GAIN) & (F.col("back") > 0))
    return scored.select("tongues", "x", "y", "s", F.log(F.col("n") / F.col("n_x")).alias("rarity"))


def sides(pairs: DataFrame, lines: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words of both texts of every pair of counterparts that are translated at all: (doc_x, doc_y, n_x, n_y, i, weight, told)
    and (doc_x, doc_y, j, w, weight).

    ``told`` lists the translations of the word with their scores against the best of either word. A word's weight is its
    rarity and how well it is translated at all; numbers translate themselves."""
    best_x = words.groupBy("tongues", "x").agg(F.max("s").alias("top"), F.max("rarity").alias("rarity"))
    best_y = words.groupBy("tongues", "y").agg(F.max("s").alias("top"), F.max("rarity").alias("rarity"))
    told = words.join(best_x.select("tongues", "x", F.col("top").alias("tx")), ["tongues", "x"]).join(best_y.select("tongues", "y", F.col("top").alias("ty")), ["tongues", "y"])
    entry = F.struct("y", F.least(F.lit(1.0), F.col("s") / F.col("tx")).alias("rx"), F.least(F.lit(1.0), F.col("s") / F.col("ty")).alias("ry"))
    told = told.groupBy("tongues", F.col("x").alias("w")).agg(F.max("tx").alias("top"), F.max("rarity").alias("rarity"), F.collect_list(entry).alias("told"))
    number = F.col("w").startswith("#")

    def weighted(doc: str, line: str, known: DataFrame) -> DataFrame:
        # Lines travel whole to their pairs; only there they become words.
        rows = pairs.join(lines.select(F.col("doc_id").alias(doc), F.col("line").alias(line), "words"), doc)
        rows = rows.select("tongues", "doc_x", "doc_y", "n_x", "n_y", line, F.explode("words").alias("w"))
        # A word in many lines of this very text says little about which line is meant.
        rows = rows.withColumn("here", F.count(F.lit(1)).over(W.partitionBy("doc_x", "doc_y", "w")))
        rows = rows.join(known, ["tongues", "w"], "left").filter(number | F.col("top").isNotNull())
        return rows.withColumn("weight", F.when(number, F.lit(2.0)).otherwise(F.col("top") * (0.3 + F.col("rarity"))) / F.sqrt("here"))

    itself = F.array(F.struct(F.col("w").alias("y"), F.lit(1.0).alias("rx"), F.lit(1.0).alias("ry")))
    x = weighted("doc_x", "i", told).select("doc_x", "doc_y", "n_x", "n_y", "i", "weight", F.when(number, itself).otherwise(F.col("told")).alias("told"))
    y = weighted("doc_y", "j", best_y.withColumnRenamed("y", "w")).select(*(F.col(c).alias(c) for c in ("doc_x", "doc_y", "j", "w", "weight")))
    return x, y


CELLS = pa.schema([(c, pa.int64()) for c in ("doc_x", "doc_y", "n_x", "n_y", "i", "j")] + [("a", pa.float64()), ("b", pa.float64())])
#: Word links of one pair of texts that are laid out at once; long texts take several rounds.
LINKS = 2_000_000


def _sums(part: np.ndarray, cell: np.ndarray, value: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Per cell the sum, over the words of one side, of the best value of each word."""
    order = np.lexsort((value, cell, part))
    part, cell, value = part[order], cell[order], value[order]
    last = np.append((part[1:] != part[:-1]) | (cell[1:] != cell[:-1]), True)
    return np.bincount(np.searchsorted(cells, cell[last]), weights=value[last], minlength=len(cells))


def _cells(x: pa.Table, y: pa.Table) -> dict[str, np.ndarray]:
    """The linked lines i and j of one pair of texts; a is the share of the weight of line i that j translates, b that of line j
    in i. Words common in both texts link much, but with little weight; none is left out."""
    if not x.num_rows or not y.num_rows:
        return {c: np.zeros(0, "int64") for c in CELLS.names}
    pair = {c: x[c][0].as_py() for c in ("doc_x", "doc_y", "n_x", "n_y")}
    n_y = pair["n_y"]
    i, vx = x["i"].to_numpy().astype("int64"), x["weight"].to_numpy()
    j, vy = y["j"].to_numpy().astype("int64"), y["weight"].to_numpy()
    told = x["told"].combine_chunks()
    mine = np.repeat(np.arange(len(i)), pc.list_value_length(told).to_numpy())
    told = told.flatten()
    coded = y["w"].combine_chunks().dictionary_encode()
    at = pc.fill_null(pc.index_in(told.field("y"), value_set=coded.dictionary), -1).to_numpy()
    rx, ry = told.field("rx").to_numpy(), told.field("ry").to_numpy()
    hit = np.flatnonzero(at >= 0)
    hit = hit[np.argsort(i[mine[hit]], kind="stable")]
    mine, at, rx, ry = mine[hit], at[hit], rx[hit], ry[hit]
    code = coded.indices.to_numpy()
    by_word = np.argsort(code, kind="stable")
    count = np.bincount(code, minlength=len(coded.dictionary))
    begin = np.cumsum(count) - count
    out = []
    # Rounds hold whole lines of x, so each cell is complete in its round.
    rounds = np.cumsum(count[at]) // LINKS
    edges = np.flatnonzero(np.diff(rounds) > 0) + 1
    edges = np.unique(np.searchsorted(i[mine], i[mine[edges]])) if len(edges) else edges
    for part in np.split(np.arange(len(at)), edges):
        n = count[at[part]]
        link = np.repeat(part, n)
        if not len(link):
            continue
        other = by_word[begin[at[link]] + np.arange(len(link)) - np.repeat(np.cumsum(n) - n, n)]
        row = mine[link]
        cell = i[row] * n_y + j[other]
        found = np.unique(cell)
        out.append((found, _sums(row, cell, rx[link] * vx[row], found), _sums(other, cell, ry[link] * vy[other], found)))
    if not out:
        return {c: np.zeros(0, "int64") for c in CELLS.names}
    found, gx, gy = (np.concatenate(c) for c in zip(*out))
    at_i, at_j = found // n_y, found % n_y
    one = np.ones(len(found), "int64")
    return {c: v * one for c, v in pair.items()} | {"i": at_i, "j": at_j, "a": gx / np.bincount(i, weights=vx)[at_i], "b": gy / np.bincount(j, weights=vy)[at_j]}


def cells(pairs: DataFrame, lines: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_x, doc_y, n_x, n_y, i, j, a, b): the linked lines of all pairs of counterparts."""
    x, y = sides(pairs, lines, words)
    rows = x.groupBy("doc_x", "doc_y").cogroup(y.groupBy("doc_x", "doc_y"))
    return rows.applyInArrow(lambda a, b: pa.table(_cells(a, b), schema=CELLS), "doc_x long, doc_y long, n_x long, n_y long, i long, j long, a double, b double")


def _chain(i: np.ndarray, j: np.ndarray, score: np.ndarray, slope: float) -> np.ndarray:
    """The heaviest chain of points with a consistent slope, as a mask. Each point looks for its predecessor in a
    rectangle before it that grows until it holds some."""
    order = np.lexsort((j, i))
    i, j, score = i[order], j[order], score[order]
    best, back = score.copy(), np.full(len(i), -1)
    for k in range(len(i)):
        size = 4
        while k:
            low = np.searchsorted(i[:k], i[k] - size)
            inside = low + np.flatnonzero((j[low:k] <= j[k]) & (j[low:k] >= j[k] - size * max(1.0, slope)) & ((i[low:k] < i[k]) | (j[low:k] < j[k])))
            if len(inside):
                step = np.abs((i[k] - i[inside]) * slope - (j[k] - j[inside]))
                value = best[inside] - 0.15 * step
                at = int(np.argmax(value))
                if value[at] > 0:
                    best[k], back[k] = score[k] + value[at], inside[at]
                    break
            if size > i[k]:
                break
            size *= 2
    on = np.zeros(len(i), dtype=bool)
    k = int(np.argmax(best)) if len(i) else -1
    while k >= 0:
        on[k] = True
        k = back[k]
    mask = np.zeros(len(i), dtype=bool)
    mask[order] = on
    return mask


def _greatest(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The greatest value of each element's group, at each element."""
    out = np.full(group.max() + 1, -np.inf)
    np.maximum.at(out, group, value)
    return out[group]


RESULT = pa.schema([("doc_a", pa.int64()), ("line_a", pa.int32()), ("doc_b", pa.int64()), ("line_b", pa.int32())])
NOTHING = RESULT.empty_table().to_pandas()


def _blocks(points: pd.DataFrame | dict[str, np.ndarray]) -> pd.DataFrame:
    """The aligned lines of one pair of counterparts from its cells."""
    n_x, n_y, x, y = (int(np.asarray(points[c])[0]) for c in ("n_x", "n_y", "doc_x", "doc_y"))
    i, j, a, b = (np.asarray(points[c]) for c in ("i", "j", "a", "b"))
    order = np.lexsort((j, i))
    i, j, a, b = i[order], j[order], a[order], b[order]
    score = (a + b) / 2
    top_i, top_j, top_a, top_b = _greatest(i, score), _greatest(j, score), _greatest(i, a), _greatest(j, b)
    leads = ((score >= 0.95 * top_i) | (score >= 0.95 * top_j) | (a >= 0.97 * top_a) | (b >= 0.97 * top_b)) & (np.maximum(a, b) >= LINKED)
    keep = np.flatnonzero(leads)
    if not len(keep):
        return NOTHING
    on = np.zeros(len(i), dtype=bool)
    on[keep] = _chain(i[keep], j[keep], score[keep], n_y / n_x)
    # Height of the chain at every line of x, between its points.
    lines, place = np.unique(i[on], return_inverse=True)
    height = np.interp(i, lines, np.bincount(place, weights=j[on]) / np.bincount(place))
    near = np.abs(height - j) <= 1.6
    mutual = (score >= 0.999 * top_i) & (score >= 0.999 * top_j)
    covered = np.maximum(a, b)
    # On or beside the chain: a whole line, or the part of a line that merges several.
    accept = leads & ((on & (covered >= LINKED)) | (near & (covered >= LINKED + 0.12) & (score >= 0.36)))
    # Off the chain: moved lines only if both sides agree.
    accept |= leads & ~near & mutual & (np.minimum(a, b) >= MOVED)
    # Moved passages: further chains among strong points of lines that nothing has linked yet.
    spare = np.flatnonzero(leads & ~near & (covered >= MOVED) & ~np.isin(i, i[accept]) & ~np.isin(j, j[accept]))
    while len(spare) > 1:
        chain = spare[_chain(i[spare], j[spare], score[spare], n_y / n_x)]
        if len(chain) < 2 or score[chain].mean() < SURE:
            break
        accept[chain] = True
        spare = spare[~np.isin(i[spare], i[chain]) & ~np.isin(j[spare], j[chain])]
    # A block also takes in the one line of each text that two neighbouring points of the chain enclose, if their words meet.
    main = np.flatnonzero(on & accept)
    ends = {(i[k], j[k]) for k in main}
    free = ~np.isin(i, i[accept]) & ~np.isin(j, j[accept]) & (covered >= ENCLOSED)
    accept[[k for k in np.flatnonzero(free) if (i[k] - 1, j[k] - 1) in ends and (i[k] + 1, j[k] + 1) in ends]] = True
    linked = min(len(np.unique(i[accept])) / n_x, len(np.unique(j[accept])) / n_y) if accept.any() else 0.0
    if linked < RELATED or (on & accept).sum() < min(2, n_x, n_y) or score[accept & leads].mean() < SURE:
        return NOTHING
    left, right = (x, y) if x < y else (y, x)
    li, rj = (i[accept], j[accept]) if x < y else (j[accept], i[accept])
    return pd.DataFrame({"doc_a": left, "line_a": li.astype("int32"), "doc_b": right, "line_b": rj.astype("int32")})


def _aligned(x: pa.Table, y: pa.Table) -> pa.Table:
    """The aligned lines of one pair of counterparts from its weighted words."""
    points = _cells(x, y)
    found = _blocks(points) if len(points["i"]) else NOTHING
    return pa.table({c: found[c].to_numpy() for c in RESULT.names}, schema=RESULT)


def align(documents: DataFrame) -> DataFrame:
    """(doc_a, line_a, doc_b, line_b) of all lines of counterparts that translate each other or a part."""
    lines = line_table(documents)
    pairs = materialize(pair_table(lines))
    x, y = sides(pairs, lines, materialize(lexicon(pairs, lines)))
    # A group is one pair of documents: as large as these two texts, however many there are.
    return x.groupBy("doc_x", "doc_y").cogroup(y.groupBy("doc_x", "doc_y")).applyInArrow(_aligned, "doc_a long, line_a int, doc_b long, line_b int")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned lines of all counterparts."""
    return align(table(spark, sf_dir, "documents").select("doc_id", "document_id", "language", "text"))


def p2_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word translations learned from all counterparts."""
    lines = line_table(table(spark, sf_dir, "documents").select("doc_id", "document_id", "language", "text"))
    return lexicon(materialize(pair_table(lines)), lines)
