"""The registered queries on a small scale, against their SQL where there is any."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from tarnql.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_gives_what_its_sql_gives(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, found = queries.QUERIES[name](spark, str(DATA)), con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in df.columns]
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


def test_all_are_registered():
    names = list(entry_point.queries())
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)] and set(queries.QUERIES) <= set(names) and "pipeline" in names


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(DATA))
        assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert pieces.filter("length > 1024 or offset < 0").count() == 0
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").distinct().collect()}
