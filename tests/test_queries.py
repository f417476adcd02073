"""Every registered query against its SQL on the smallest driver tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from kinspan.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _normal(frame):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>":
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    columns, rows = _normal(registry.QUERIES[name](spark, DATA).toPandas())
    expected_columns, expected = _normal(duck.sql(registry.ORACLES[name]).df())
    assert columns == expected_columns

    def close(a, b):
        return all(x == y or (x and y and math.isclose(float(x), float(y), rel_tol=1e-6, abs_tol=2e-5)) for x, y in zip(a, b, strict=True))

    assert len(rows) == len(expected)
    assert all(close(a, b) for a, b in zip(rows, expected, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_bands_of_peaks_with_ids_beyond_a_million(spark, tmp_path):
    import shutil

    import duckdb

    con = duckdb.connect()
    shutil.copy(f"{DATA}/orders.parquet", tmp_path / "orders.parquet")
    con.sql(f"copy (select * replace (p_partkey + 1980000 AS p_partkey) from '{DATA}/part.parquet') to '{tmp_path}/part.parquet' (format parquet)")
    for t in ("orders", "part"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    rows = _normal(registry.QUERIES["peak_intervals"](spark, str(tmp_path)).toPandas())
    assert rows == _normal(con.sql(registry.ORACLES["peak_intervals"]).df())
