"""How many labelled documents a model is trained on."""

import pyarrow as pa
from pyspark.sql import functions as F

from tarnql.llm import toxicity

from .cases import frame


def test_up_to_3000_documents_of_either_label_are_trained_on(spark, monkeypatch):
    def counted(*_):
        def run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([str(sum(b.num_rows for b in batches)).encode()], pa.binary())], ["model"])

        return run

    monkeypatch.setattr(toxicity, "_fit", counted)
    docs = frame(spark, [(i, f"text {i}", "", "") for i in range(10_000)])
    labels = spark.range(10_000).selectExpr("id doc_id", "cast(id % 2 as int) toxic").filter(~toxicity.held_out(F.col("doc_id")))
    assert labels.filter("toxic = 0").count() > 3000 and labels.filter("toxic = 1").count() > 3000
    assert toxicity.train(docs, labels) == b"6000"
