"""Encoding of a corpus with a public tokenizer (problem 6).

Texts are split into the tokenizer's words by Spark, every distinct word is encoded once, and the ids are joined back
by position. Frequent words (a bounded number, of bounded length) are joined by broadcast and their ids are gathered where
the document lies; only the rest is shuffled by word. A frequent word too long for the broadcast is spread over salts.

Defined results
  null or empty text: an empty array.
  rows repeated with the same doc_id and text: one row.
  strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import materialize, table

TOKENIZERS = "/opt/tokenizers"
#: The word pattern published with the byte_bpe_50k tokenizer, in Java's syntax (a fixed value).
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bound of the broadcast part of the word table: so many words of at most so many bytes, 40 MB with their ids.
HOT_WORDS, HOT_BYTES = 20_000, 400
#: A longer word is spread over the salts if it occurs more often than that. Each such word takes HOT_BYTES times HEAVY
#: bytes of the corpus, so 100 TB hold at most 2.5 million of them: 20 MB of hashes to broadcast.
HEAVY, SALTS = 100_000, 64


def texts_of(documents: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, text_key, *keep, text): rows with the same id and text once, spread by id, as large texts may lie in one file."""
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_key"), *keep, "text")
    return keyed.groupBy("doc_id", "text_key").agg(*(F.first(c).alias(c) for c in (*keep, "text")))


def _split(texts: DataFrame, *keys: str) -> DataFrame:
    # The outer form: the plain one makes the optimizer split every text twice, once to test for words.
    words = texts.select(*keys, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words"))
    return words.select(*keys, F.posexplode_outer("words").alias("pos", "word"))


def words_of(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, word) of every word of every text."""
    return _split(documents, "doc_id").filter("pos is not null")


def ranks_of(path: str) -> dict[bytes, int]:
    """The vocabulary file: one base64 piece and its id a line; about 50,000 entries."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def word_table(words: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n, ids) of each distinct word, encoded once."""
    shared = words.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        coder = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield batch.assign(ids=[coder.encode_ordinary(w) for w in batch["word"]])

    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).mapInPandas(encode, "word string, n long, ids array<int>")


def _coded(texts: DataFrame, vocabulary: str, value: Column, gather: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Per document what is gathered of the values of its words: of frequent ones, and of all others.

    ``value`` is made of a word's ``ids``; ``gather`` are aggregates over (pos, value)."""
    vocab = materialize(word_table(_split(texts, "doc_id").filter("pos is not null"), vocabulary))
    small = F.octet_length("word") <= HOT_BYTES
    hot = materialize(vocab.filter(small).orderBy(F.desc("n"), "word").limit(HOT_WORDS).select("word", "ids"))
    heavy = vocab.filter(~small & (F.col("n") > HEAVY)).select(F.xxhash64("word").alias("heavy")).distinct()
    keys = ["doc_id", "text_key"]
    tagged = _split(texts, *keys).join(F.broadcast(hot), "word", "left")
    # The texts lie by document already, so what is known here is gathered without a shuffle.
    known = tagged.withColumn("value", value).groupBy(*keys).agg(*gather)
    rest = tagged.filter("ids is null and word is not null").select(*keys, "pos", "word").join(F.broadcast(heavy), F.xxhash64("word") == F.col("heavy"), "left")
    rest = rest.withColumn("salt", F.when(F.col("heavy").isNotNull(), F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("heavy")
    cold = vocab.join(F.broadcast(hot.select("word")), "word", "left_anti")
    salts = F.when(~small & (F.col("n") > HEAVY), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    cold = cold.select("word", F.explode(salts).alias("salt"), value.alias("value"))
    return known, rest.join(cold, ["word", "salt"]).groupBy(*keys).agg(*gather)


def encode_documents(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) of every document; an empty array where there is no text."""
    parts = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("pos", "value"))).alias("parts")
    known, rest = _coded(texts_of(documents), vocabulary, F.col("ids"), [parts])
    none = F.expr("cast(array() as array<struct<pos:int,value:array<int>>>)")
    joined = known.join(rest.withColumnRenamed("parts", "others"), ["doc_id", "text_key"], "left")
    ordered = F.array_sort(F.concat("parts", F.coalesce("others", none)))
    return joined.select("doc_id", F.flatten(F.transform(ordered, lambda p: p["value"])).alias("ids"))


def token_counts(documents: DataFrame, vocabulary: str, *keep: str) -> DataFrame:
    """(doc_id, *keep, n_tokens) of every document; sizes, not ids, are shuffled."""
    texts = texts_of(documents, *keep)
    known, rest = _coded(texts, vocabulary, F.size("ids"), [F.sum(F.when(F.col("value") > 0, F.col("value"))).alias("n")])
    joined = known.join(rest.withColumnRenamed("n", "others"), ["doc_id", "text_key"], "left")
    counts = joined.select("doc_id", "text_key", (F.coalesce("n", F.lit(0)) + F.coalesce("others", F.lit(0))).alias("n_tokens"))
    return texts.select("doc_id", "text_key", *keep).join(counts, ["doc_id", "text_key"]).select("doc_id", *keep, "n_tokens")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), through a join with the id-to-piece table (as large as the vocabulary)."""
    spark = encoded.sparkSession
    pieces = spark.createDataFrame([(i, bytearray(b)) for b, i in ranks_of(vocabulary).items()], "id int, piece binary")
    flat = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id")).join(F.broadcast(pieces), "id", "left")
    rows = flat.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("piece").alias("h"))))).alias("p"))
    return rows.select("doc_id", F.decode(F.unhex(F.concat_ws("", F.transform("p", lambda x: x["h"]))), "UTF-8").alias("text"))


def p6_ids(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k, without special tokens."""
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{tokenizers}/byte_bpe_50k.tiktoken")


def p6_vocabulary(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The distinct-word table: word, occurrences, ids."""
    return word_table(words_of(table(spark, sf_dir, "documents").select("doc_id", "text")), f"{tokenizers}/byte_bpe_50k.tiktoken")


def p6_decoded(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) decoded again from the ids."""
    return decode_documents(p6_ids(spark, sf_dir, tokenizers), f"{tokenizers}/byte_bpe_50k.tiktoken")
