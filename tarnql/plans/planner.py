"""Query to a lazy plan: filter, aggregate, order, limit, project; Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import SourceError, UnsupportedQueryError
from ..model import Aggregate, Comparison, Relation
from ..operators.aggregate import aggregate
from ..operators.filter import filtered
from ..operators.order import CHUNK, limited, ordered
from ..operators.project import project
from ..sources.csv import scan
from .parser import Item, Query, parse


def plan(query: Query, rel: Relation, chunk: int = CHUNK) -> Relation:
    """The query over a relation.

    Conditions see the source's columns; ORDER BY sees group keys and aggregates, or columns that are not
    selected. With aggregates the output is the group keys in GROUP BY order, then the aggregates.
    """
    rel = filtered(rel, *[Comparison(rel.resolve(c), op, v) for c, op, v in query.where])
    calls = [i for i in query.items if i.function]
    columns = [i for i in query.items if not i.function and not i.star]
    stars = len(query.items) - len(calls) - len(columns)
    grouped = bool(calls or query.group_by)
    if grouped:
        if stars:
            raise UnsupportedQueryError("* does not go with aggregates or GROUP BY")
        keys = [rel.resolve(k) for k in query.group_by]
        for c in columns:
            if rel.resolve(c.column) not in keys:
                raise UnsupportedQueryError(f"column {c.column!r} is neither aggregated nor grouped by")
        rel = aggregate(rel, [Aggregate(c.function, rel.resolve(c.column) if c.column else -1, c.name) for c in calls], keys)
    if query.order_by:
        rel = ordered(rel, [(_key(rel, name, columns), desc) for name, desc in query.order_by], chunk)
    if query.limit is not None:
        rel = limited(rel, query.limit, query.offset)
    elif query.offset:
        rel = rel.replaced(rel.df.offset(query.offset))
    if grouped:  # renamed last, so that ORDER BY sees a key by its own name too
        renamed = {c.column: c.alias for c in columns if c.alias}
        names = [renamed.get(n, n) if i < len(query.group_by) else n for i, n in enumerate(rel.names)]
        return Relation(rel.df, tuple(names), rel.kinds)
    if stars:
        return rel
    return project(rel, [rel.resolve(c.column) for c in columns], [c.name for c in columns])


def _key(rel: Relation, name: str, columns: list[Item]) -> int:
    if rel.ordinal(name) < 0:
        name = next((c.column for c in columns if c.alias == name and c.column in rel.names), name)
    return rel.resolve(name)


def source(spark: SparkSession, table: str) -> Relation:
    """A table name as a path: a Parquet file or folder by its ending, else CSV."""
    if table.rstrip("/").endswith(".parquet"):
        try:
            return Relation.of(spark.read.parquet(table))
        except Exception as e:
            raise SourceError(f"cannot read {table!r}: {e}") from e
    return scan(spark, table)


def sql(spark: SparkSession, text: str, tables: Callable[[str], DataFrame | Relation] | dict | None = None, chunk: int = CHUNK) -> DataFrame:
    """Runs a query. ``tables`` maps names to DataFrames; names it lacks are paths."""
    query = parse(text)
    if callable(tables):
        found = tables(query.table)
    else:
        found = (tables or {}).get(query.table)
    if found is None:
        found = source(spark, query.table)
    rel = found if isinstance(found, Relation) else Relation.of(found)
    return plan(query, rel, chunk).frame()
