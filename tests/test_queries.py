"""Queries against their SQL on the smallest tables, and that the package stands without its optional part."""

import math
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tessera.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    one = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({ORACLES[name]})")
    assert plain(df.select(*cols).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_part(tmp_path):
    repo = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run(f"cp -r {repo}/tessera {repo}/__spark_entry__.py {repo}/corpus_pipeline.py {tmp_path} && rm -rf {tmp_path}/tessera/llm", shell=True, check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert int(out.stdout) == len(QUERIES), out.stderr
