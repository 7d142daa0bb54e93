"""Every query with SQL gives the rows that DuckDB gives on the smallest tables; the others run."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from clipseam import queries, queries_jobs

FOLDER = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return db


def rows(pdf):
    columns = sorted(pdf.columns)
    clean = pdf[columns].astype(object).where(pdf[columns].notna(), None)
    return columns, sorted(map(repr, ([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r] for r in clean.itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(queries.SQL | queries_jobs.SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows((queries.QUERIES | queries_jobs.QUERIES)[name](spark, str(FOLDER)).toPandas()) == rows(duck.sql((queries.SQL | queries_jobs.SQL)[name]).df())


@pytest.mark.parametrize("name", ["frame_colour", "verify_spec", "json_fingerprint", "fit_calibrator"])
def test_other_queries_run(spark, name):
    assert (queries.QUERIES | queries_jobs.QUERIES)[name](spark, str(FOLDER)).count() > 0


def test_the_entry_stands_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "clipseam", tmp_path / "clipseam", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'ranking_metrics' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
