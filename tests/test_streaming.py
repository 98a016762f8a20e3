import pytest

from tarnql.errors import UnsupportedQueryError
from tarnql.streaming.live import follow, live


def test_queries_follow_a_stream(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "k string, v long"
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], schema).write.parquet(folder)
    runs = [follow(spark, folder, schema, "SELECT v FROM t WHERE v > 1", "passed", str(tmp_path / "c1")), follow(spark, folder, schema, "SELECT k, SUM(v) AS s FROM t GROUP BY k", "summed", str(tmp_path / "c2"), "complete")]
    for run in runs:
        run.processAllAvailable()
        run.stop()
    assert sorted(r[0] for r in spark.table("passed").collect()) == [2, 3]
    assert {r[0]: r[1] for r in spark.table("summed").collect()} == {"a": 4.0, "b": 2.0}


def test_a_stream_of_rows_has_no_order(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    with pytest.raises(UnsupportedQueryError):
        live(stream, "SELECT id FROM t ORDER BY id")
