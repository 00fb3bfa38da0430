"""Every registered query against SQL on the same tables."""

import pytest

from roompulse.oracle import ORACLE
from roompulse.queries import QUERIES
from tests.conftest import as_bag


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    got = as_bag([r.asDict() for r in df.collect()], df.columns)
    cur = duck.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    want = as_bag([dict(zip(columns, r)) for r in cur.fetchall()], columns)
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want) and len(got) > 0
    assert got == want
