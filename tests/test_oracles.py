"""Every catalog query against its SQL in DuckDB, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from trackweave.plans import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def norm(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return 0.0 if isinstance(v, float) and v == 0 else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    if not DATA.exists():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for p in DATA.iterdir():
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, duck):
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    cols = sorted(ours.columns)
    rows = lambda f: sorted((tuple(map(norm, r)) for r in f[cols].itertuples(index=False, name=None)), key=str)
    assert rows(ours) == rows(theirs)
