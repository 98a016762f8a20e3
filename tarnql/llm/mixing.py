"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, apart, pick, range_rank, running_total, whole_row, word_count

#: Weight schedules over training time 0..1 as knots (time, weight), dealt to sources in turn. Their
#: integrals are the weights of the contract: 5 (shrinking), 2 (steady) and 1 (growing).
SCHEDULES = [[(0.0, 7.0), (1.0, 3.0)], [(0.0, 2.0), (1.0, 2.0)], [(0.0, 0.0), (1.0, 2.0)]]


def integral(knots: list[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (v0 + v1) / 2 for (t0, v0), (t1, v1) in zip(knots, knots[1:], strict=False))


def invert(share: Column, knots: list[tuple[float, float]]) -> Column:
    """The time by which a source has met the given share (0..1) of its whole demand."""
    need, met, times = share * integral(knots), 0.0, []
    for (t0, v0), (t1, v1) in zip(knots, knots[1:], strict=False):
        rest = F.greatest(need - met, F.lit(0.0))
        root = v0 + F.sqrt(F.greatest(v0 * v0 + rest * (2 * (v1 - v0) / (t1 - t0)), F.lit(0.0)))
        met += (t1 - t0) * (v0 + v1) / 2
        times.append((met, F.least(t0 + F.when(root > 0, rest * 2.0 / root).otherwise(0.0), F.lit(t1))))
    out = times[-1][1]
    for end, time in reversed(times[:-1]):
        out = F.when(need <= end, time).otherwise(out)
    return out


def targets(sources: DataFrame, scratch: Scratch, share: float, schedules: list, most: float) -> DataFrame:
    """Adds ``turn`` (which schedule) and ``target`` to rows (source, source_size).

    Targets are proportional to weight but stop at ``most`` times the source's size, and the excess goes to
    the others by weight: target = min(most * size, level * weight) for the one level at which the targets
    add up. The level is found by a fixed point whose every step is one aggregation over the sources.
    """
    weights = [integral(k) for k in schedules]
    ranked = range_rank(sources, scratch, "by_source", [F.asc_nulls_last("source")])
    ranked = ranked.withColumn("turn", F.pmod("rank", F.lit(len(schedules))).cast("int")).drop("rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1)
    ranked = scratch.save(ranked.withColumn("weight", weight), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, F.lit(most) * F.col("source_size") < F.lit(0.0)
    while True:
        held, free = ranked.agg(F.sum(F.when(capped, F.lit(most) * F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        after = (share * total - (held or 0.0)) / free if free else level
        if after == level:
            break
        level, capped = after, F.lit(most) * F.col("source_size") < F.lit(after) * F.col("weight")
    return ranked.withColumn("target", F.when(capped, F.lit(most) * F.col("source_size")).otherwise(F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, share: float = 1.5, schedules: list = SCHEDULES, most: float = 2.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document, in training order: doc_id, size, source_size, target, taken, position, again.

    A document's size is its number of words (null text: 0). Each source's documents stand in a fixed
    shuffled order, by MD5 of doc_id, and its target is taken from that order, round and round: every
    document ``taken`` words, repeats counted, so the source's taken words are its target rounded to a word
    and at most one document of a source is cut. ``position`` is the training time (0..1) at which half of the
    document's first pass is due: the time at which the integral of the source's schedule reaches that share
    of the demand; ``again`` is the same for the second pass. Both are null where that pass takes nothing.
    Rows are range-sorted by position, untaken ones last. A null source is a source of its own, after all
    others; a null doc_id counts as empty text. Rows that tie in everything are taken in either order, which
    gives the same rows. Columns named in ``carry`` are handed through. An empty table gives an empty result.
    """
    if most > 2:
        raise ValueError("a document is passed twice at most")
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(
        pick(docs, "doc_id", "source", "text", *carry).select(
            *carry,
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("shuffle"),
            F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("tie"),
        ),
        "sized",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sources, scratch, share, schedules, most).withColumnRenamed("source", "_source")
    placed = running_total(sized, scratch, "dealt", "source", [F.col("shuffle"), F.col("doc_id"), F.col("size"), F.col("tie")], "size")
    joined = placed.join(goals, F.col("source").eqNullSafe(F.col("_source")))
    whole = F.floor(F.col("target") + 0.5)
    first = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("before")))
    second = F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("source_size") - F.col("before")))
    timed = joined.withColumns({"one": first.cast("long"), "two": second.cast("long"), "taken": (first + second).cast("long")})

    def due(start: Column, words: Column) -> Column:
        share_met = (start + words / 2.0) / F.col("target")
        time = F.lit(None).cast("double")
        for turn, knots in enumerate(schedules):
            time = F.when(F.col("turn") == turn, invert(share_met, knots)).otherwise(time)
        return F.when(words > 0, F.round(time, 9))

    return (
        timed.withColumn("position", due(F.col("before"), F.col("one")))
        .withColumn("again", due(F.col("source_size") + F.col("before"), F.col("two")))
        .select("doc_id", "size", "source_size", "target", "taken", "position", "again", *carry, *(["one", "two"] if carry else []))
        .orderBy(F.asc_nulls_last("position"), "doc_id")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves in training order, with the columns of ``docs``.

    A document stands at each position at which at least half of a pass over it is due, so up to twice; documents are
    not cut. Documents without words (null and empty texts too), which no target counts, stand at the end. Rows that are equal in
    every column stand once for each position that one of them has. Positions are worked out on narrow rows, which name their document by a
    hash of the whole row; texts are moved to meet them and then range-sorted. An empty table gives an empty result; columns
    that clash with those used are carried along.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    docs, back = apart(docs, "doc_id", "source", "text")
    named = docs.withColumn("_row", whole_row(docs))
    due = mix(named.select("_row", "doc_id", "source", "text"), carry=("_row",), **options)
    times = F.array(F.when(2 * F.col("one") >= F.col("size"), F.coalesce("position", F.lit(2.0))), F.when((2 * F.col("two") >= F.col("size")) & (F.col("two") > 0), F.col("again")))
    due = scratch.save(due.withColumn("_tie", F.monotonically_increasing_id()).select("_row", "_tie", F.explode(F.filter(times, lambda x: x.isNotNull())).alias("_time")), "due")
    if due.groupBy("_row").agg(F.min("_tie").alias("x"), F.max("_tie").alias("y")).filter("x < y").head(1):
        named = named.dropDuplicates(["_row"])  # of equal rows one meets the positions of all
    return back(named.join(due, "_row").orderBy("_time", "_tie"))
