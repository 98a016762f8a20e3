"""CSV with a header: types from the first data row, cells coerced, ragged records refused."""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceError
from ..functions import coerce
from ..model import Kind, Relation

#: Files up to this size are parsed whole: they fill one partition at most.
WHOLE_BYTES = 32 << 20

csv.field_size_limit(1 << 30)  # cells of any length that Spark reads

_COERCE = {Kind.INT: coerce.to_int, Kind.FLOAT: coerce.to_float, Kind.STRING: coerce.to_text}


def _peek(spark: SparkSession, path: str) -> list[list[str]]:
    """Header and first record, at most."""
    local = path.removeprefix("file://")
    if os.path.isfile(local):
        with open(local, newline="", encoding="utf-8", errors="replace") as f:
            rows = (r for r in csv.reader(f) if r)
            return [r for _, r in zip(range(2), rows, strict=False)]
    try:
        rows = spark.read.options(header=False, multiLine=False, quote='"', escape='"').csv(path).head(2)
    except Exception as e:
        raise SourceError(f"cannot read {path!r}: {e}") from e
    return [["" if c is None else c for c in r] for r in rows]


def spans_lines(spark: SparkSession, paths: list[str]) -> bool:
    """Whether a quoted field may hold a line break: some line has an odd number of quotes. One pass for large inputs."""
    local = paths[0].removeprefix("file://")
    if len(paths) == 1 and os.path.isfile(local) and os.path.getsize(local) <= WHOLE_BYTES:
        return True
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(paths).filter(quotes % 2 == 1).head(1))


def read_text(spark: SparkSession, paths: list[str], width: int, multi_line: bool) -> DataFrame:
    """All cells as text, columns ``_0`` .. ; a record with another number of fields fails the query, also where
    the query needs none of its columns (hence no column pruning in the parser)."""
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(width)])
    return (
        spark.read.schema(schema)
        .options(header=True, quote='"', escape='"', mode="FAILFAST", multiLine=multi_line, columnPruning=False, enforceSchema=True)
        .csv(paths)
    )


def scan(spark: SparkSession, path: str, multi_line: bool | None = None, only: list[str] | None = None) -> Relation:
    """The file, or the files of a folder or glob, as a relation.

    A column's kind comes from the first data row; later cells that do not parse become 0. Without data rows
    all columns are String. ``multi_line`` None decides by looking: a file without quoted line breaks is split
    over tasks. ``only`` reads just these of the files (see ``zonemap``) and looks at no others; their first record gives the kinds.
    """
    found = _peek(spark, only[0] if only else path)
    if not found:
        raise SourceError(f"{path!r} is empty: there is no header")
    header, first = found[0], found[1] if len(found) > 1 else None
    if first is not None and len(first) != len(header):
        raise SourceError(f"{path!r}: the first record has {len(first)} fields, the header {len(header)}")
    kinds = tuple(coerce.infer(c) for c in first) if first else (Kind.STRING,) * len(header)
    if only is not None and not only:
        schema = T.StructType([T.StructField(f"_{i}", k.spark) for i, k in enumerate(kinds)])
        return Relation(spark.createDataFrame([], schema), tuple(header), kinds)
    text = read_text(spark, only or [path], len(header), spans_lines(spark, only or [path]) if multi_line is None else multi_line)
    typed = text.select(*[_COERCE[k](F.col(f"_{i}")).alias(f"_{i}") for i, k in enumerate(kinds)])
    return Relation(typed, tuple(header), kinds)
