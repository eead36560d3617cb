"""The driver's contract, with and without the optional subpackage; each query against its SQL."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from capsift.plans import queries as core

ROOT = Path(__file__).resolve().parent.parent
D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.QUERIES) <= set(entry.queries())


def test_entry_works_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "capsift"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else _copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; assert e.llm is None; q = e.queries(); assert 'pipeline' not in q and len(q) > 40; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)


def _copy(source: Path, target: Path) -> None:
    target.mkdir()
    for p in source.iterdir():
        if p.name not in ("llm", "__pycache__"):
            (target / p.name).symlink_to(p)


SLOW = {"package_reports", "json_report", "text_report", "sarif_report", "ref_closure", "category_links"}


@pytest.mark.parametrize("name", sorted(set(core.SQL) - SLOW))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = core.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    want = con.sql(core.SQL[name])
    assert sorted(want.columns) == columns
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((tuple(r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
