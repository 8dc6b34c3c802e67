"""Queries of the subpackage against their SQL in DuckDB, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from trackweave.llm import entry
from trackweave.llm.oracles import ORACLES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for p in DATA.iterdir():
        c.execute(f"create view {p.stem} as select * from '{p}'")
    theirs = c.execute(ORACLES[name])
    names = [d[0] for d in theirs.description]
    ours = entry.queries()[name](spark, str(DATA))
    assert sorted(ours.columns) == sorted(names)
    assert sorted((tuple(r) for r in ours.select(*names).collect()), key=str) == sorted(theirs.fetchall(), key=str)
