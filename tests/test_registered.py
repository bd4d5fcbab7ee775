"""The registered queries: complete, and equal to their oracles on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import _rows, duck

SMALL = "/root/testdata/sf0.001"


def corpus_queries() -> set[str]:
    """Those of the corpus operators are compared in tests of their own."""
    try:
        from orbitlake.llm.queries import QUERIES
    except ModuleNotFoundError:
        return set()
    return set(QUERIES)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not here")
@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - corpus_queries()))
def test_query_equals_oracle(spark, name):
    df = entry.queries()[name](spark, SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(SMALL).execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert got == _rows(names, rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
