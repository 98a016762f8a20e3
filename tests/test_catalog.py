"""Every query of the engine against its SQL in DuckDB, and random queries against a plain model."""

import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from tarnql import catalog
from tarnql.plans.planner import sql

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert df.columns == names or sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["l_returnflag", "n", "sum_qty", "avg_price"]
    assert set(catalog.QUERIES) <= set(entry_point.queries()) and set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_random_queries_against_a_model(spark):
    rng = random.Random(5)
    data = [(rng.randint(-5, 5), rng.choice([-1.5, 0.0, 2.25, float("nan")]), rng.choice("abc")) for _ in range(60)]
    df = spark.createDataFrame(data, "i long, f double, s string").cache()
    ops = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "!=": lambda a, b: a != b}
    for _ in range(25):
        at, op = rng.randrange(3), rng.choice(list(ops))
        value = [rng.choice([1, 2.9, -1.5, "1"]), rng.choice([0, 2.25, "x"]), rng.choice(["a", "b", 1])][at]
        text = f"'{value}'" if isinstance(value, str) else str(value)
        if at < 2:
            keep = [r for r in data if not isinstance(value, str) and ops[op](r[at], int(value) if at == 0 else float(value))]
        else:
            keep = [r for r in data if ops[op](r[2], str(value))]
        got = sql(spark, f"SELECT COUNT(*) AS n, SUM(i) AS t, MIN(i) AS lo FROM t WHERE {'ifs'[at]} {op} {text}", {"t": df}).first()
        assert tuple(got) == (len(keep), float(sum(r[0] for r in keep)), float(min(r[0] for r in keep)) if keep else None)
