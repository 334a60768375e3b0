"""Every core query against its SQL on the given tables; every core query on odd and on empty tables."""

from __future__ import annotations

import compare
import pytest
from conftest import GIVEN

from quillspark.plans import catalog

QUERIES, ORACLE = catalog.core_queries(), catalog.core_oracle()


@pytest.fixture(scope="module")
def con():
    return compare.connect(GIVEN)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    assert compare.spark_rows(QUERIES[name](spark, GIVEN)) == compare.sql_rows(con, ORACLE[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd_tables, name):
    QUERIES[name](spark, odd_tables).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_tables, name):
    rows = QUERIES[name](spark, empty_tables).collect()
    # Reports with a fixed list of lines keep them; everything else is empty.
    assert not rows or name == "orphans" and all(r["n"] == 0 for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
