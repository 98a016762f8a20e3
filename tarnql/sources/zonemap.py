"""Zone maps: row count and min/max per integer column of a CSV file, and skipping files by them."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions import coerce
from ..model import Comparator, Comparison, Kind, Relation
from .csv import _peek, read_text, scan, spans_lines


@dataclass
class ZoneMap:
    filename: str
    row_count: int
    min_values: dict[str, int] = field(default_factory=dict)
    max_values: dict[str, int] = field(default_factory=dict)

    def can_prune(self, column: str, comparator: Comparator, value: int) -> bool:
        """Whether no row of the file can match; false for a column that is not tracked."""
        if column not in self.min_values or column not in self.max_values:
            return False
        low, high = self.min_values[column], self.max_values[column]
        return {
            Comparator.EQ: value < low or value > high,
            Comparator.LT: low >= value,
            Comparator.LTE: low > value,
            Comparator.GT: high <= value,
            Comparator.GTE: high < value,
            Comparator.NEQ: low == high == value,
        }[comparator]

    def summary(self) -> str:
        lines = [f"Zone map: {self.filename}", f"Rows: {self.row_count}"]
        return "\n".join(lines + [f"  {c}: [{self.min_values[c]}, {self.max_values[c]}]" for c in sorted(self.min_values)])


def zone_map_path(path: str) -> str:
    return str(Path(path).with_suffix(".zonemap.json"))


def save_zone_map(zone_map: ZoneMap) -> str:
    """Writes the sidecar beside the file and returns its path."""
    at = Path(zone_map_path(zone_map.filename))
    at.write_text(json.dumps(asdict(zone_map), indent=2))
    at.chmod(0o644)
    return str(at)


def load_zone_map(path: str) -> ZoneMap:
    """The saved zone map of a CSV file."""
    return ZoneMap(**json.loads(Path(zone_map_path(path)).read_text()))


def zone_maps(spark: SparkSession, path: str) -> list[ZoneMap]:
    """One zone map per file of ``path``, all in one aggregation.

    Integer columns by the first data row are tracked; a file in which any cell is no int64 does not track that
    column, so coerced zeros can never hide. Files without rows do not appear, but for a single file.
    """
    found = _peek(spark, path)
    if not found:
        raise SourceError(f"{path!r} is empty: there is no header")
    header = found[0]
    ints = [i for i, c in enumerate(found[1]) if coerce.infer(c) is Kind.INT] if len(found) > 1 else []
    text = read_text(spark, [path], len(header), spans_lines(spark, [path]))
    values = [F.count(F.lit(1)).alias("n")]
    for i in ints:
        cell = F.col(f"_{i}")
        values += [F.min(cell.try_cast("bigint")).alias(f"lo{i}"), F.max(cell.try_cast("bigint")).alias(f"hi{i}"), F.bool_and(coerce.is_int(cell)).alias(f"ok{i}")]
    rows = text.groupBy(F.col("_metadata.file_path").alias("file")).agg(*values).orderBy("file").toLocalIterator()
    maps = []
    for r in rows:
        zm = ZoneMap(unquote(r["file"]), r["n"])
        for i in (i for i in ints if r[f"ok{i}"]):
            zm.min_values.setdefault(header[i], r[f"lo{i}"])
            zm.max_values.setdefault(header[i], r[f"hi{i}"])
        maps.append(zm)
    return maps or [ZoneMap(path, 0)]


def generate_zone_map(spark: SparkSession, path: str) -> ZoneMap:
    """The zone map of one CSV file, under the path it was asked for."""
    zm = zone_maps(spark, path)[0]
    zm.filename = path
    return zm


def pruned_scan(spark: SparkSession, path: str, comparisons: list[tuple[str, Comparator, int]], maps: list[ZoneMap] | None = None) -> Relation:
    """Scans only the files that may hold a match, and filters their rows."""
    from ..operators.filter import filtered

    maps = zone_maps(spark, path) if maps is None else maps
    kept = [re.sub(r"([\\\[\]{}*?])", r"\\\1", m.filename) for m in maps if not any(m.can_prune(*c) for c in comparisons)]
    rel = scan(spark, path, only=kept)
    return filtered(rel, *[Comparison(rel.resolve(name), op, value) for name, op, value in comparisons])


def table_zone_map(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, min_value, max_value, row_count) of integer columns, in one pass over the table."""
    parts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        parts += [F.min(c).cast("bigint").alias(f"lo{i}"), F.max(c).cast("bigint").alias(f"hi{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"), F.col("n").alias("row_count")) for i, c in enumerate(columns)])
    return df.agg(*parts).select(F.inline(rows))
