"""Every query with SQL against DuckDB, the others for a stable result."""

import math
from pathlib import Path

import duckdb
import pytest

from lamina.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        at = p if p.is_file() else p / "*.parquet"
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{round(float(v), 4) + 0.0:.4f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


def close(a, b):
    try:
        return abs(float(a) - float(b)) <= 2e-4 * max(1.0, abs(float(a)))
    except ValueError:
        return a == b


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    want, got = rows(names, cur.fetchall()), rows(df.columns, df.collect())
    assert sorted(names) == sorted(df.columns) and len(want) == len(got) and want
    assert want == got or all(close(a, b) for x, y in zip(want, got, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_and_repeats(spark, name):
    first, again = (registry.QUERIES[name](spark, DATA) for _ in range(2))
    a, b = (rows(x.columns, x.collect()) for x in (first, again.repartition(3)))
    assert a and a == b


def test_paired_chunks_of_large_and_repeated_keys(spark, tmp_path):
    """Names with more than six digits, and ranges that two rows name."""
    spark.createDataFrame([(k,) for k in (0, 2, 3, 6, 6, 49998, 50000, 50004, 6000000)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    cur = c.execute(registry.ORACLE_SQL["paired_chunks"])
    df = registry.QUERIES["paired_chunks"](spark, str(tmp_path))
    assert rows([x[0] for x in cur.description], cur.fetchall()) == rows(df.columns, df.collect())
