"""Duplicates hidden by formatting (problem 5).

A document is a small nested record: language, kind and a body of lines. Leaves (lines, or the whole body where line
order carries meaning) are normalised and hashed; the body of a ``list`` document is an unordered node, so its child
digests are sorted before they are hashed; the root digest covers language, order rule and body. Documents are grouped
by root digest and each group is confirmed by comparing the normalised structure itself.

Defined results
  null or empty text, text without any letter or digit: no case, no row.
  a document id that occurs twice with copies: it is listed once.
  letter case is set aside by upper- then lower-casing, so that SS and the sharp s agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.skew import join_groups
from quillspark.session import materialize, table

#: Everything that is neither letter, combining mark nor digit: white space, punctuation, symbols, controls.
SET_ASIDE = r"[^\p{L}\p{M}\p{N}]+"


def leaf(text: Column) -> Column:
    """The normalised form of a leaf."""
    # The removal stands between the two case changes, or the optimizer would drop the first.
    return F.lower(F.regexp_replace(F.upper(text), SET_ASIDE, ""))


def with_root_digest(documents: DataFrame) -> DataFrame:
    """Adds ``leaves`` (normalised, sorted where order does not count) and ``root`` (the Merkle digest)."""
    unordered = F.coalesce(F.col("document_kind") == "list", F.lit(False))
    # Only for lists does the line structure matter; elsewhere a line break is white space like any other.
    lines = F.when(unordered, F.split(F.col("text"), r"\R")).otherwise(F.array("text"))
    leaves = F.filter(F.transform(lines, leaf), lambda x: x != "")
    out = documents.select("doc_id", "language", F.when(unordered, "set").otherwise("sequence").alias("node"), leaves.alias("leaves"))
    out = out.filter(F.size("leaves") > 0)
    out = out.withColumn("leaves", F.when(F.col("node") == "set", F.array_sort("leaves")).otherwise(F.col("leaves")))
    digests = F.transform("leaves", lambda x: F.sha2(x, 256))
    body = F.sha2(F.concat_ws(",", F.when(F.col("node") == "set", F.array_sort(digests)).otherwise(digests)), 256)
    return out.withColumn("root", F.sha2(F.concat_ws("/", F.coalesce("language", F.lit("")), "node", body), 256))


def copy_groups(documents: DataFrame) -> DataFrame:
    """(doc_id, first_doc_id, n_copies) of every document that has at least one copy, the first included."""
    # Every text is digested once; ids and digests are all that is kept of it.
    rooted = materialize(with_root_digest(documents).select("doc_id", "root"))
    # By digest alone: counts are combined before the shuffle, so no task sees a whole group.
    repeated = rooted.groupBy("root").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("size")).filter("low < high").select("root", "size")
    wanted = materialize(join_groups(rooted, repeated, "root", "size", "doc_id").distinct())
    # Only documents whose digest occurs again are read and normalised a second time, for the full comparison.
    again = with_root_digest(documents.join(wanted.select("doc_id"), "doc_id", "left_semi"))
    structure = F.concat_ws("\u0001", F.coalesce("language", F.lit("")), "node", F.concat_ws("\u0002", "leaves"))
    members = materialize(again.select("doc_id", "root", structure.alias("structure")).distinct())
    # A group is confirmed if its least and greatest structure are the same text.
    per_root = members.groupBy("root").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n_copies"), F.min("structure").alias("least"), F.max("structure").alias("greatest"))
    per_root = materialize(per_root.select("root", "first_doc_id", "n_copies", (F.col("least") == F.col("greatest")).alias("confirmed")))
    confirmed = per_root.filter("confirmed").select("root", "first_doc_id", "n_copies")
    agreed = join_groups(members.select("doc_id", "root"), confirmed, "root", "n_copies", "doc_id").select("doc_id", "first_doc_id", "n_copies")
    # Different structures under one digest (a collision): group those by the structure itself.
    collided = members.join(per_root.filter("not confirmed").select("root"), "root", "left_semi")
    by_text = collided.groupBy("root", "structure").agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")
    disputed = collided.select("doc_id", "root", "structure").join(by_text, ["root", "structure"]).select("doc_id", "first_doc_id", "n_copies")
    return agreed.unionByName(disputed)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(first_doc_id, doc_id): one row for each copy besides the first of its group."""
    groups = copy_groups(table(spark, sf_dir, "documents"))
    return groups.filter("doc_id <> first_doc_id").select("first_doc_id", "doc_id")


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each text that has copies, with their number."""
    groups = copy_groups(table(spark, sf_dir, "documents"))
    return groups.filter("doc_id = first_doc_id").select("first_doc_id", "n_copies")
