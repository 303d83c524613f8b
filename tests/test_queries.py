"""Every registered query of the library against its SQL over the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from tracewright.plans import answers, oracles, queries

QUERIES, ORACLES = queries.QUERIES | answers.QUERIES, oracles.ORACLES | answers.ORACLES
TABLES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    if not TABLES.is_dir():
        pytest.skip("no tables")
    c = duckdb.connect()
    for f in TABLES.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, str(TABLES))
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    expected = plain(columns, want.fetchall())
    assert plain(got.columns, [tuple(r) for r in got.collect()]) == expected and expected[1]
    spark.catalog.clearCache()
