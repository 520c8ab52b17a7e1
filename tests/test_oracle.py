"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

from conftest import SF01  # noqa: E402

KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[key])
    msg = compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description])
    assert msg is None, msg


def test_every_query_has_an_oracle_or_is_listed():
    # Approximate search has no exact SQL statement of its result, and the separator splitter no SQL form.
    # The numbered operators and the pipeline are an optional subpackage with tests of its own.
    own = {k for k in E.queries() if not re.match(r"op\d+_|pipeline$", k)}
    assert own - set(E.oracle_sql()) == {"knn_approx", "chunk_documents_recursive"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["filename", "query_count"]
    assert df.count() > 0
