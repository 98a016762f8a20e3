"""The same queries over an unbounded stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import UnsupportedQueryError
from ..model import Relation
from ..plans.parser import parse
from ..plans.planner import plan


def live(stream: DataFrame, text: str) -> DataFrame:
    """The query over a streaming DataFrame. Rows pass through filters and projections in append mode; aggregates
    need complete or update mode, and only complete results can be ordered. LIMIT is refused without ORDER BY over
    aggregates, as a stream has no last row."""
    query = parse(text)
    calls = any(i.function for i in query.items) or query.group_by
    if (query.order_by or query.limit is not None or query.offset) and not calls:
        raise UnsupportedQueryError("a stream of rows has no order and no end: ORDER BY and LIMIT need aggregates")
    return plan(query, Relation.of(stream)).frame()


def follow(spark: SparkSession, folder: str, schema, text: str, name: str, checkpoint: str, mode: str = "append"):
    """Starts the query over the Parquet files that arrive in a folder; the result is the in-memory table ``name``."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return live(stream, text).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
