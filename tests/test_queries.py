"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import json
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from packetloom.plans import ORACLE_SQL, QUERIES

from .conftest import ROOT, SMALLEST

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALLEST}/{t}.parquet'")
    return con


def norm(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALLEST)
    columns = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
    assert got
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr([norm(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "stream_id" and df.count() > 0


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries())


def test_bench_prints_one_line_of_json(tmp_path):
    """Of a query that runs once and of one that runs three times; in a process of its own, as the bench ends its session."""
    env = os.environ | {"BENCH_SF_DIR": SMALLEST, "BENCH_CPUS": "2"}
    code = "import bench; bench.ONCE['stream_stats'] = 1; bench.main(['stream_stats', 'rule_filter'])"
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    (line,) = done.stdout.strip().splitlines()
    assert set(json.loads(line)["queries"]) == {"stream_stats", "rule_filter"} and "stream_stats" in done.stderr
