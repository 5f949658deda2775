"""The queries of the subpackage: against their SQL where they have any, else that they run over the smallest tables."""

import os

import pytest
import test_queries as core

from colloquy.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(core.FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    core.same(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, core.FOLDER).count() >= 0
