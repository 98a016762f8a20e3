"""Sort, limit and offset. Sort then limit becomes a top-k plan, without a full sort."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Relation

#: A number of rows to sort at a time; accepted as a hint and checked, while Spark manages memory itself.
CHUNK = 1000


def ordered(rel: Relation, keys: list[tuple[int, bool]], chunk: int = CHUNK) -> Relation:
    """Rows by (ordinal, descending) keys; ordinals out of range order nothing. Null stays null, first ascending."""
    if chunk <= 0:
        raise ValueError(f"sort chunk size must be positive, not {chunk}")
    exprs = [(F.desc if desc else F.asc)(f"_{i}") for i, desc in keys if rel.has(i)]
    return rel.replaced(rel.df.orderBy(*exprs)) if exprs else rel


def ordered_by_name(rel: Relation, name: str, desc: bool = False, chunk: int = CHUNK) -> Relation:
    return ordered(rel, [(rel.ordinal(name), desc)], chunk)


def limited(rel: Relation, limit: int, offset: int = 0) -> Relation:
    """Skips ``offset`` rows, then keeps ``limit``."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return rel.replaced((rel.df.offset(offset) if offset else rel.df).limit(limit))
