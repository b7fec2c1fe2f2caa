"""The entry point works with and without the training-data package, and queries equal their SQL."""

import random
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_package(tmp_path):
    code = "import sys; sys.modules['rasterloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op') or k == 'pipeline' for k in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)


def test_nothing_else_imports_it():
    for path in (ROOT / "rasterloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "rasterloom.llm" not in path.read_text()


def names():
    from rasterloom.queries import library, raster, raster_sql

    known = sorted((raster.queries() | library.queries()).keys() & (raster_sql.oracle_sql() | library.oracle_sql()).keys())
    return random.Random(2).sample(known, 20)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    from rasterloom.queries import library, raster, raster_sql
    from tools.compare import TABLES, rows

    if name in raster_sql.BY_SIZE:
        sf_dir = str(Path(sf_dir).parent / "sf0.01")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = (raster.queries() | library.queries())[name](spark, sf_dir).toPandas()
    want = con.sql((raster_sql.oracle_sql() | library.oracle_sql())[name]).df()
    assert rows(got) == rows(want)
