import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_flagship_and_names(spark):
    assert len(entry.entry(spark).columns) == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from folioflow.plans import catalog

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    plain = lambda rs: sorted(str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rs)
    for name, sql in catalog.oracle_sql().items():
        df = catalog.queries()[name](spark, SF)
        cols = sorted(df.columns)
        want = c.execute(f"SELECT {', '.join(chr(34) + k + chr(34) for k in cols)} FROM ({sql})").fetchall()
        assert plain(map(tuple, df.select(*cols).collect())) == plain(want), name
