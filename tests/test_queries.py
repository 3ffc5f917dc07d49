"""Every query of the library's own operators against its SQL oracle, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from spanlight.plans.all import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
#: Model fits take longest; their properties are checked on small tables elsewhere.
FITS = {"m01_window_detectors", "m04_process_ranker", "m11_binding_model"}
#: No case of the smallest tables has the four processes that a deletion asks for; tests/test_evidence.py reads larger ones.
FEW = {"m12_deletion_lift"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        out.append(repr([None if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v else float(f"{float(v):.9g}") if hasattr(v, "__float__") and not isinstance(v, str) else str(v) for v in row]))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITS))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got) or name in FEW
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_module():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
