"""Every query of the subpackage on odd rows and on empty tables."""

from __future__ import annotations

import pytest
from conftest import GIVEN

from quillspark.llm import queries

COLUMNS = {"p1_found": ["id_a", "id_b"], "p2_found": ["doc_a", "line_a", "doc_b", "line_b"], "p3_found": ["doc_id", "end_char"], "p5_found": ["first_doc_id", "doc_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd_tables, name):
    queries.QUERIES[name](spark, odd_tables).collect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert not queries.QUERIES[name](spark, empty_tables).collect()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert queries.QUERIES[name](spark, GIVEN).columns == COLUMNS[name]
