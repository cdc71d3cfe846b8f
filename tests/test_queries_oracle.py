"""Every registered query against its DuckDB oracle (sf0.001), and the
smoke entry point."""

import pytest

import __spark_entry__ as E
from tracekiln import catalog
from tracekiln.oracle.compare import compare

from .conftest import SF_SMALL

NAMES = sorted(catalog.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "majority_answer" in df.columns


def test_every_query_has_oracle():
    assert [n for n in catalog.queries() if n not in catalog.oracle_sql()] == []


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    r = compare(catalog.queries()[name](spark, SF_SMALL), catalog.oracle_sql()[name], SF_SMALL)
    assert r["match"] and r["types_match"], r
