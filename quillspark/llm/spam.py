"""Keyword-stuffed and link-list pages (problem 8).

Content and link features of each text are computed in SQL; rules that are sure of their case give weak labels; bagged
decision trees are fitted to a bounded sample of them and judge every page; the judgements are smoothed with the spam
rate of the page's host.

Defined results
  null, empty or blank text: no spam.
  without both kinds of weak labels (tiny tables) the rules' own score is used instead of the trees.
  pages without a host are not smoothed; neither is a host that has only a few pages (its rate is shrunk to the mean).
  rows repeated with the same doc_id: one row.
  texts of any length, also dotted or unspaced ones: the work grows with the text; an address is what the rules of domain
  names allow (labels of at most 63 characters, at most 127 of them).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.skew import join_groups
from quillspark.session import materialize, table

KINDS = ("page", "readable")
#: The bound of the labelled sample that the trees are fitted to, and the size of the bag.
SAMPLE_ROWS, TREES, DEPTH, SEED = 20_000, 25, 6, 11
#: Pages that a host needs before its own rate weighs as much as the mean, and the weight of the smoothing.
HOST_PRIOR, HOST_WEIGHT = 20.0, 0.5

ADDRESS = r"(?:https?:/?/?\S{0,300}?)?(?:[\p{L}\p{N}-]{1,63}+\.){1,127}[a-z]{2,}(?:/[\w/%?=&.#-]*)?"
LINK = rf"\[([^\[\]\n]*)\]\({ADDRESS}\)"
TAG = r"[#＃][^\s#＃,，、|]+"
STOP = r"[.!?。！？｡．⁉…]"
TOKEN = r"[\p{IsHan}\p{IsKatakana}\p{IsHiragana}]|[\p{L}\p{N}&&[^\p{IsHan}\p{IsKatakana}\p{IsHiragana}]]+"
FEATURES = ["prose", "links", "link_share", "tags", "repeats", "line_repeats", "top_share", "separators", "stops", "goods", "digits", "same_lines", "short_lines", "longest_run", "same_ends"]


def with_features(pages: DataFrame) -> DataFrame:
    """Adds the features of column ``text``; all are shares or rates, so they mean the same at any length."""
    count = lambda c, pattern: F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    out = pages.withColumn("_bare", F.regexp_replace(F.regexp_replace("text", LINK, "$1"), ADDRESS, " "))
    out = out.withColumn("_n", F.greatest(F.lit(1), F.length(F.regexp_replace("_bare", r"(?U)\s+", ""))).cast("double"))
    out = out.withColumn("_tokens", F.regexp_extract_all(F.lower("_bare"), F.lit(TOKEN), F.lit(0)))
    out = out.withColumn("_m", F.greatest(F.lit(1), F.size("_tokens")).cast("double"))
    # Sentences: pieces of a line, up to a stop if there is one; prose if they are long enough and no list in disguise.
    out = out.withColumn("_pieces", F.regexp_extract_all("_bare", F.lit(rf"[^\n\r.!?。！？｡．⁉…]+(?:{STOP}+[”’\"」』）)]*)?"), F.lit(0)))
    marks = lambda x: F.size(F.regexp_extract_all(x, F.lit(r"[,，、]"), F.lit(0)))
    tokens = lambda x: F.size(F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0)))
    out = out.withColumn("_prose", F.filter("_pieces", lambda x: ~F.rlike(x, F.lit(r"[#＃|·★☆»]")) & (tokens(x) >= F.when(F.rlike(x, F.lit(STOP)), 4).otherwise(6)) & (marks(x) * 6 <= tokens(x) + 6)))
    length = F.aggregate(F.transform("_prose", lambda x: F.length(F.regexp_replace(x, r"(?U)\s+", "")).cast("double")), F.lit(0.0), lambda a, x: a + x)
    # Elements are read by place: a slice of an array inside a lambda copies all of it.
    trigrams = lambda c: F.expr(f"transform(sequence(0, greatest(0, size({c}) - 3)), i -> concat_ws(' ', get({c}, i), get({c}, i + 1), get({c}, i + 2)))")
    out = out.withColumn("_grams", trigrams("_tokens"))
    # The same over different lines only: a refrain repeats whole lines, a stuffed text repeats words within them.
    out = out.withColumn("_own", F.regexp_extract_all(F.lower(F.array_join(F.array_distinct(F.split("_bare", r"\R")), "\n")), F.lit(TOKEN), F.lit(0)))
    out = out.withColumn("_own", trigrams("_own"))
    lines = F.filter(F.split("_bare", r"\R"), lambda x: F.rlike(x, F.lit(r"\S")))
    out = out.withColumn("_lines", lines).withColumn("_k", F.greatest(F.lit(1), F.size("_lines")).cast("double"))
    sorted_tokens = F.array_sort("_tokens")
    runs = F.aggregate(sorted_tokens, F.expr("struct('' as t, 0 as n, 0 as best)"), lambda a, x: F.struct(x.alias("t"), F.when(a["t"] == x, a["n"] + 1).otherwise(1).alias("n"), F.greatest(a["best"], F.when(a["t"] == x, a["n"] + 1).otherwise(1)).alias("best")), lambda a: a["best"])
    out = out.withColumns({
        "prose": length / F.col("_n"),
        "links": count("text", ADDRESS) * 20.0 / (F.col("_m") + count("text", ADDRESS)),
        "link_share": 1 - F.col("_n") / F.greatest(F.lit(1), F.length(F.regexp_replace("text", r"(?U)\s+", ""))),
        "line_repeats": 1 - F.size(F.array_distinct("_own")) / F.size("_own").cast("double"),
        "tags": F.length(F.array_join(F.regexp_extract_all("_bare", F.lit(TAG), F.lit(0)), "")) / F.col("_n"),
        "repeats": 1 - F.size(F.array_distinct("_grams")) / F.size("_grams").cast("double"),
        "top_share": runs / F.col("_m"),
        "separators": count("_bare", r"[,，、|·»/;；#＃]") * 10.0 / F.col("_m"),
        "stops": count("_bare", STOP) * 10.0 / F.col("_m"),
        "goods": F.size(F.filter("_lines", lambda x: F.rlike(x, F.lit(r"[★☆]|\bSKU|(?i)\b(?:no|id)\.?\s?\d{3,}|[€¥￥₩]\s?\d")))) / F.col("_k"),
        "digits": F.length(F.regexp_replace("_bare", r"[^\p{N}]+", "")) / F.col("_n"),
        "same_lines": 1 - F.size(F.array_distinct("_lines")) / F.col("_k"),
        "short_lines": F.size(F.filter("_lines", lambda x: ~F.rlike(x, F.lit(STOP + r"[”’\"」』）)\s]*$")))) / F.col("_k"),
        # Words from one stop or line break to the next; an ideograph or kana counts as half a word.
        "longest_run": F.coalesce(F.array_max(F.transform("_pieces", lambda x: tokens(x) - 0.5 * F.length(F.regexp_replace(x, r"[^\p{IsHan}\p{IsKatakana}\p{IsHiragana}]+", "")))), F.lit(0.0)),
        # Pieces that end like another one: doorway sentences differ in a place name only.
        "same_ends": 1 - F.size(F.array_distinct(F.transform("_pieces", lambda x: F.right(F.regexp_replace(x, r"[^\p{L}\p{N}]+", ""), F.lit(4))))) / F.greatest(F.lit(1), F.size("_pieces")).cast("double"),
        "n_tokens": F.col("_m"),
    })
    return out.select(*pages.columns, *FEATURES, "n_tokens")


#: How sure the rules are that a page is spam: 1 yes, 0 no, between: no label.
WEAK = """
    case when link_share > 0.6 or tags > 0.6 or goods > 0.7 then 1.0
         when line_repeats > 0.55 or (n_tokens > 30 and (top_share > 0.25 or (line_repeats > 0.35 and top_share > 0.2))) then 1.0
         when longest_run > 45 and stops < 0.2 then 1.0
         when same_ends > 0.7 and line_repeats > 0.3 and n_tokens > 30 then 1.0
         when prose < 0.25 and (links > 1.5 or separators > 2.0 or repeats > 0.5) then 1.0
         when prose > 0.8 and stops > 0.22 and link_share < 0.35 and tags < 0.1 and goods < 0.2 and longest_run < 40 and same_ends < 0.5
              and (line_repeats < 0.3 or (line_repeats < 0.5 and top_share < 0.085)) then 0.0
         else 0.5 end"""


def judged(pages: DataFrame) -> DataFrame:
    """(doc_id, host, p): the trees' probability that each page is spam."""
    featured = materialize(with_features(pages).withColumn("label", F.expr(WEAK)).select("doc_id", "host", "label", *FEATURES))
    labelled = featured.filter("label <> 0.5")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2 or min(counts.values()) < 3:
        return featured.select("doc_id", "host", F.col("label").alias("p"))
    # A bounded sample, drawn by a hash of the id and per class, so that the same rows are drawn every time.
    shares = {k: min(1.0, SAMPLE_ROWS / 2 / n) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) / F.lit(1e6)
    sample = labelled.filter(draw < F.when(F.col("label") == 1.0, shares[1.0]).otherwise(shares[0.0]))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    # Every tree sees all features of its own bootstrap sample: bagging.
    trees = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", bootstrap=True, seed=SEED)
    model = trees.fit(vectors.transform(sample).select("features", "label"))
    return model.transform(vectors.transform(featured)).select("doc_id", "host", vector_to_array("probability")[1].alias("p"))


def smoothed(pages: DataFrame) -> DataFrame:
    """Adds ``score``: p moved, on the log-odds scale, by what its host's spam rate says beyond the mean."""
    pages = materialize(pages)
    mean = pages.agg(F.avg("p")).first()[0] or 0.0
    per_host = pages.filter("host is not null").groupBy("host").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("host_pages"))
    rates = per_host.select("host", "host_pages", ((F.col("s") + HOST_PRIOR * mean) / (F.col("host_pages") + HOST_PRIOR)).alias("rate"))
    odds = lambda c: F.log(F.greatest(F.lit(0.01), F.least(F.lit(0.99), c)) / (1 - F.greatest(F.lit(0.01), F.least(F.lit(0.99), c))))
    shift = F.when(F.col("rate").isNotNull(), odds(F.col("rate")) - odds(F.lit(float(mean)))).otherwise(0.0)
    # One host may hold a third of all pages.
    joined = join_groups(pages.select("doc_id", "host", "p"), rates, "host", "host_pages", "doc_id", "left")
    return joined.select("doc_id", "host", "p", (1 / (1 + F.exp(-(odds(F.col("p")) + HOST_WEIGHT * shift)))).alias("score"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").filter(F.col("document_kind").isin(*KINDS)).filter(F.rlike(F.coalesce("text", F.lit("")), F.lit(r"(?U)[^\s\p{C}]")))
    return pages.select("doc_id", "text", F.nullif(F.regexp_extract("source_url", r"^[a-z]+://([^/]+)", 1), F.lit("")).alias("host"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the pages of which most is keywords, links, tags or goods."""
    return smoothed(judged(_pages(spark, sf_dir))).filter("score > 0.5").select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the trees' probability and the smoothed score."""
    return smoothed(judged(_pages(spark, sf_dir)))
