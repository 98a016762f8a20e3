"""Pieces the corpus operators share: column picking, running totals, ranks, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: A word of the contracts: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others, found by position.

    An exact match wins over one that differs in case, and the first of several; so extra columns,
    clashing ones too, never reach an operator. A missing column raises ValueError.
    """
    have = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(have))])

    def at(name: str) -> Column:
        found = [i for i, c in enumerate(have) if c == name] or [i for i, c in enumerate(have) if c.lower() == name.lower()]
        if not found:
            raise ValueError(f"column {name!r} is missing; there are {have}")
        return F.col(f"_{found[0]}").alias(name)

    return plain.select(*map(at, names))


def apart(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with the named columns (found as ``pick`` does) under their names and all others under names of no
    meaning, and how to get back the columns as they were."""
    have = df.columns
    inner = [f"_k{i}" for i in range(len(have))]
    for name in names:
        found = [i for i, c in enumerate(have) if c == name] or [i for i, c in enumerate(have) if c.lower() == name.lower()]
        if not found:
            raise ValueError(f"column {name!r} is missing; there are {have}")
        inner[found[0]] = name
    return df.toDF(*inner), lambda made: made.select(*inner).toDF(*have)


def whole_row(docs: DataFrame) -> Column:
    """A 64-bit name of everything in a row; maps, which do not hash, as text."""
    return F.xxhash64(*[F.col(f.name).cast("string") if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema.fields])


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def running_total(df: DataFrame, scratch: Scratch, name: str, group: str, order: list[Column], value: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the same group that come earlier.

    A group may hold most of the rows: rows are range-partitioned by (group, order), so a large group
    spans many partitions. Sums per partition and group give each run its start, and only the rest is
    summed inside a run. Null is a group like any other.
    """
    dealt = scratch.save(
        df.repartitionByRange(F.asc_nulls_last(group), *order).withColumn("_part", F.spark_partition_id()), name
    )
    runs = dealt.groupBy("_part", group).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("_part").alias("_p"), F.col(group).alias("_g"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(runs, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
        .withColumn("before", F.col("_start") + F.col("_inside"))
        .drop("_part", "_p", "_g", "_start", "_inside")
    )


def range_rank(df: DataFrame, scratch: Scratch, name: str, order: list[Column]) -> DataFrame:
    """Adds ``rank``: 0, 1, 2 ... in the given order over the whole table, without one task that sees all rows."""
    one = df.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
    return running_total(one, scratch, name, "_all", order, "_one").withColumnRenamed("before", "rank").drop("_all", "_one")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, component), component the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step moves links towards the
    smallest node seen and is a join, an aggregation and a distinct; the links never leave the executors.
    Each round is written to the shared folder, so a lost executor costs one round. Nodes without an edge
    do not appear. Self-links are ignored.
    """
    now = scratch.save(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0"
    )
    seen, step = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen, step = mark, step + 1
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = scratch.save(small.select("e.u", "e.v").filter("u <> v").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = after
    stars = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
