"""A result as text: names, a rule, tab-separated rows and their number."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import DataFrame


def cell(value: object) -> str:
    return "NULL" if value is None else str(value)


def write_table(df: DataFrame, out: TextIO | None = None) -> int:
    """Rows come partition by partition, so the driver holds one partition at a time."""
    out = out or sys.stdout
    head = "\t".join(df.columns)
    print(head, "-" * (len(head) + 8), sep="\n", file=out)
    n = 0
    for row in df.toLocalIterator():
        print("\t".join(map(cell, row)), file=out)
        n += 1
    print(f"({n} rows)", file=out)
    return n
