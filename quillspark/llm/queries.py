"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import align, copies, encode, mixture, sentences, spam, unify

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": unify.p1_found,
    "p1_forms": unify.p1_forms,
    "p2_found": align.p2_found,
    "p2_lexicon": align.p2_lexicon,
    "p3_found": sentences.p3_found,
    "p3_sentences": sentences.p3_sentences,
    "p3_units": sentences.p3_units,
    "p5_found": copies.p5_found,
    "p5_records": copies.p5_records,
    "p6_ids": encode.p6_ids,
    "p6_vocabulary": encode.p6_vocabulary,
    "p6_decoded": encode.p6_decoded,
    "p7_mixture": mixture.p7_mixture,
    "p7_shares": mixture.p7_shares,
    "p7_exact": mixture.p7_exact,
    "p7_exact_shares": mixture.p7_exact_shares,
    "p7_whole": mixture.p7_whole,
    "p7_whole_shares": mixture.p7_whole_shares,
    "p8_found": spam.p8_found,
    "p8_scores": spam.p8_scores,
}

_GROUPS = r"""
WITH body AS (
  SELECT doc_id, language, coalesce(document_kind = 'list', false) AS is_list,
         CASE WHEN coalesce(document_kind = 'list', false) THEN string_split_regex(text, '\r\n|[\n\x0B\x0C\r\x{85}\x{2028}\x{2029}]') ELSE [text] END AS lines
  FROM documents WHERE text IS NOT NULL),
leaves AS (
  SELECT doc_id, language, is_list,
         [y FOR y IN [lower(upper(regexp_replace(x, '[^\p{L}\p{M}\p{N}]+', '', 'g'))) FOR x IN lines] IF y <> ''] AS leaves
  FROM body),
keyed AS (
  SELECT doc_id, coalesce(language, '') AS language, is_list, CASE WHEN is_list THEN list_sort(leaves) ELSE leaves END AS leaves
  FROM leaves WHERE len(leaves) > 0),
grouped AS (SELECT *, min(doc_id) OVER w AS first_doc_id, count(*) OVER w AS n_copies FROM keyed WINDOW w AS (PARTITION BY language, is_list, leaves))
"""

ORACLE: dict[str, str] = {
    "p5_found": _GROUPS + "SELECT first_doc_id, doc_id FROM grouped WHERE doc_id <> first_doc_id",
    "p5_records": _GROUPS + "SELECT first_doc_id, n_copies FROM grouped WHERE doc_id = first_doc_id AND n_copies > 1",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
