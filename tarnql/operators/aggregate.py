"""Scalar and grouped COUNT, SUM, MIN, MAX and AVG."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Aggregate, AggregateKind, Kind, Relation


def _expression(rel: Relation, agg: Aggregate) -> tuple[Column, Kind]:
    """COUNT counts rows, of a column too. The others are Float: SUM of nothing is 0, MIN and MAX skip NaN and are null of
    nothing, AVG divides by the number of rows. Text has no numeric value: SUM 0, MIN and MAX null, AVG 0."""
    rows = F.count(F.lit(1))
    if agg.kind is AggregateKind.COUNT:
        return rows, Kind.INT
    numeric = rel.has(agg.ordinal) and rel.kinds[agg.ordinal] in (Kind.INT, Kind.FLOAT)
    value = rel.col(agg.ordinal).cast("double") if numeric else F.lit(None).cast("double")
    number = F.when(~F.isnan(value), value) if numeric and rel.kinds[agg.ordinal] is Kind.FLOAT else value
    total = F.coalesce(F.sum(value), F.lit(0.0))
    out = {
        AggregateKind.SUM: total,
        AggregateKind.MIN: F.min(number),
        AggregateKind.MAX: F.max(number),
        AggregateKind.AVG: F.when(rows > 0, total / rows),
    }[agg.kind]
    return out, Kind.FLOAT


def aggregate(rel: Relation, aggregates: list[Aggregate], keys: list[int] | None = None) -> Relation:
    """With keys: one row per group, keys first; of no rows, none. Without: one row, also of no rows.

    Keys alone give their distinct combinations. A key out of range is one null Int key with an empty name.
    """
    keys = keys or []
    made = [(*_expression(rel, a), a.alias or f"{a.kind.value}_{i}") for i, a in enumerate(aggregates)]
    key_cols = [rel.col(k) if rel.has(k) else F.lit(None).cast("bigint") for k in keys]
    names = [rel.names[k] if rel.has(k) else "" for k in keys] + [m[2] for m in made]
    kinds = [rel.kinds[k] if rel.has(k) else Kind.INT for k in keys] + [m[1] for m in made]
    keyed = [c.alias(f"_k{i}") for i, c in enumerate(key_cols)]
    values = [m[0].alias(f"_v{i}") for i, m in enumerate(made)]
    if not keys:
        df = rel.df.agg(*values)
    elif values:
        df = rel.df.groupBy(*keyed).agg(*values)
    else:
        df = rel.df.select(*keyed).distinct()
    return Relation(df.toDF(*[f"_{i}" for i in range(len(names))]), tuple(names), tuple(kinds))


def aggregate_by_names(rel: Relation, keys: list[str], aggregates: list[Aggregate]) -> Relation:
    return aggregate(rel, aggregates, [rel.ordinal(k) for k in keys])
