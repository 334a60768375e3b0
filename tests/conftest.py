"""Fixtures: a small session and three data sets (given, with odd rows, empty)."""

from __future__ import annotations

import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
GIVEN = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
    s = s.config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


def _odd(t: pa.Table) -> pa.Table:
    """For every column a row in which it is null, rows written twice, and an extra column whose name clashes."""
    rows = t.slice(0, min(40, t.num_rows))
    for i, name in enumerate(rows.column_names):
        if i < rows.num_rows:
            values = rows.column(name).to_pylist()
            values[i] = None
            rows = rows.set_column(i, name, pa.array(values, rows.schema.field(name).type))
    rows = pa.concat_tables([rows, rows.slice(0, 5)])
    for extra in ("n", "salt", "line"):
        rows = rows.append_column(extra, pa.array([str(i) for i in range(rows.num_rows)]))
    return rows


def _write(target: Path, change) -> str:
    for p in Path(GIVEN).glob("*.parquet"):
        table = ds.dataset(str(p)).to_table()
        fields = [pa.field(f.name, f.type, nullable=True) for f in table.schema]
        pq.write_table(change(table.cast(pa.schema(fields))), target / p.name)
    return str(target)


@pytest.fixture(scope="session")
def odd_tables(tmp_path_factory):
    return _write(tmp_path_factory.mktemp("odd"), _odd)


@pytest.fixture(scope="session")
def empty_tables(tmp_path_factory):
    return _write(tmp_path_factory.mktemp("empty"), lambda t: t.slice(0, 0))
