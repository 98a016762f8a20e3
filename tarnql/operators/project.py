"""Projection by ordinal or by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Kind, Relation


def project(rel: Relation, ordinals: list[int], names: list[str] | None = None) -> Relation:
    """The columns in the given order, repeats allowed; of an empty list, all.

    An ordinal out of range gives a null Int column with an empty name. ``names`` renames.
    """
    if not ordinals:
        return rel
    parts = [
        (rel.col(i), rel.names[i], rel.kinds[i]) if rel.has(i) else (F.lit(None).cast("bigint"), "", Kind.INT) for i in ordinals
    ]
    return rel.selected([(c, names[i] if names else n, k) for i, (c, n, k) in enumerate(parts)])


def project_by_names(rel: Relation, names: list[str]) -> Relation:
    """As ``project``; a name that is not there gives the null column."""
    return project(rel, [rel.ordinal(n) for n in names])
