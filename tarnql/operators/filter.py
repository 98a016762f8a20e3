"""Filters: a column against a literal, conjunctions, and any Column as predicate."""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.coerce import number_text
from ..model import Comparator, Comparison, Kind, Relation

_APPLY = {
    Comparator.EQ: operator.eq,
    Comparator.LT: operator.lt,
    Comparator.GT: operator.gt,
    Comparator.LTE: operator.le,
    Comparator.GTE: operator.ge,
    Comparator.NEQ: operator.ne,
}


def predicate(rel: Relation, comparison: Comparison) -> Column:
    """The comparison as an expression Catalyst can push down.

    The literal takes the column's type: on an Int column a float is truncated towards zero; on an Int or Float
    column text matches nothing, not even with ``!=``; on a String column a number is compared as text. NaN
    differs from everything and is neither less nor greater. Null and a bad ordinal match nothing.
    """
    if not rel.has(comparison.ordinal):
        return F.lit(False)
    col, kind, value = rel.col(comparison.ordinal), rel.kinds[comparison.ordinal], comparison.value
    apply = _APPLY[comparison.comparator]
    if kind is Kind.INT:
        if isinstance(value, str) or not math.isfinite(value):
            return F.lit(False)
        value = int(value)
        if not -(2**63) <= value < 2**63:
            return F.lit(apply(0, value)) & col.isNotNull()
        return apply(col, F.lit(value))
    if kind is Kind.FLOAT:
        if isinstance(value, str):
            return F.lit(False)
        if math.isnan(value):
            return F.lit(comparison.comparator is Comparator.NEQ) & col.isNotNull()
        found = apply(col, F.lit(float(value)))
        return found if comparison.comparator in (Comparator.NEQ, Comparator.EQ, Comparator.LT, Comparator.LTE) else found & ~F.isnan(col)
    if kind is Kind.STRING and not isinstance(value, str):
        value = number_text(value)
    return apply(col, F.lit(value))


def conjunction(conditions: list[Column]) -> Column:
    """All of them; of none, true."""
    return reduce(operator.and_, conditions, F.lit(True))


def filtered(rel: Relation, *conditions: Comparison | Column) -> Relation:
    """Rows for which every condition holds; a Column is any predicate over ``rel.col(i)``."""
    found = [predicate(rel, c) if isinstance(c, Comparison) else c for c in conditions]
    return rel.replaced(rel.df.filter(conjunction(found))) if found else rel
