"""Every named query runs, and gives what its SQL gives."""

import glob
import os

import duckdb
import pytest

from quernel.plans import catalogue

SF = os.environ.get("QUERNEL_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the synthetic tables aren't here")


def shown(x):
    if isinstance(x, float):
        return f"{x:.9g}" if x else "0"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(shown, x)) + "]"
    return str(x)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = table(df.collect(), df.columns)
    assert len(set(df.columns)) == len(df.columns)
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name])
        assert got == table(want.fetchall(), want.columns)


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
