"""The registered queries against their SQL, where the driver's smallest tables are at hand."""

import math
import os
from collections import Counter
from pathlib import Path

import pytest

from colloquy.plans import core_queries

FOLDER = os.environ.get("COLLOQUY_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def comparable(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def same(spark, query, sql):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame = query(spark, FOLDER)
    names = sorted(frame.columns)
    got = Counter(tuple(map(comparable, r)) for r in frame.select(*names).collect())
    cursor = connection.execute(sql)
    order = [d[0] for d in cursor.description]
    assert sorted(order) == names
    expected = Counter(tuple(comparable(r[order.index(n)]) for n in names) for r in cursor.fetchall())
    assert got == expected


@pytest.mark.parametrize("name", sorted(core_queries.SQL))
def test_against_sql(spark, name):
    same(spark, core_queries.QUERIES[name], core_queries.SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()[entry.FLAGSHIP](spark, FOLDER).count() == 6
