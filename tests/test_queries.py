"""Every registered query against its SQL on the smallest tables, and the driver's contract."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n[:2] in ("p6", "p7", "p8")))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in SQL:
        assert differences(got, con.execute(SQL[name]).fetch_df()) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("missing", ["gridloom.llm", "gridloom.llm.queries", "regex"])
def test_core_does_not_need_llm(missing):
    import subprocess
    import sys

    code = f"import sys; sys.modules[{missing!r}] = None\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and not [q for q in e.queries() if q[:2] in ('p6', 'p7', 'p8')]\nassert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.ROOT)
