from __future__ import annotations

from pathlib import Path

import pandas as pd
import pytest

from clipseam.llm import registry

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = registry.QUERIES[name](spark, str(FOLDER)).toPandas(), db.sql(registry.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6)
    rows = lambda df: sorted(repr([plain(v) for v in r]) for r in df[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_all_are_registered():
    assert {int(k[2:].split("_")[0]) for k in registry.QUERIES} == set(range(1, 14))
