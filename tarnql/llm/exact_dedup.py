"""Exact duplicates by two passes over a Bloom filter; only rows that may repeat are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .bloom import drop_some, keep_some
from .common import Scratch, apart, pick, whole_row

#: A group holding more than this share of all rows is joined by broadcast: there are at most that many thousand.
HOT_SHARE = 1000


def _sha() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def _flagged(prints: DataFrame, n: int, scratch: Scratch, bits_per_row: int, max_bits: int) -> DataFrame:
    """Adds ``maybe`` to narrow rows with a column ``sha``: whether another row may have the same, by filters of bits set twice."""
    spark = prints.sparkSession
    rounds = max(1, -(-n * bits_per_row // max_bits))
    bits = bloom.size_for(-(-n // rounds), bits_per_row, max_bits)
    prints = prints.withColumn("h", F.xxhash64("sha")).withColumn("round", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(rounds)).cast("int"))
    at = f"{scratch.path}/prints"
    (prints.write.partitionBy("round") if rounds > 1 else prints.write).parquet(at)
    prints = spark.read.schema(prints.schema).parquet(at)
    flagged = None
    for r in range(rounds):
        own = prints.filter(F.col("round") == r).drop("round")
        twice = bloom.fill(own.select("h"), bits, least=2)
        tested = scratch.save(bloom.mark(own, "h", twice, bits), f"tested-{r}")
        flagged = tested if flagged is None else flagged.union(tested)
    return flagged


def exact_dedup(docs: DataFrame, bits_per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, so all null and empty texts are one group. Of
    equal texts the row with the largest doc_id stays (a null doc_id ranks lowest); of rows that also
    share that doc_id exactly one stays. An empty table gives an empty result.

    A table of fingerprints is written first. Then a filter of ``bits_per_row`` bits a row is filled: tasks
    report bit positions, a few bytes a row, and bits set twice or more are merged by slice. The merged
    filter holds no more than ``max_bits`` bits (128 MB), which bounds what the driver broadcasts; a larger
    table is worked in rounds, each over the fingerprints of its own hash range. Rows whose bits were not
    all set twice are unique and pass straight through; the others, repeats and about 1 % false alarms,
    are grouped by their SHA-256, which makes the result exact. Groups of over a thousandth of all rows, of
    which there can be a thousand at most, meet their rows by broadcast, so none of them gathers in one task.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    n = docs.count()
    prints = pick(docs, "doc_id", "text").select("doc_id", _sha().alias("sha"), F.monotonically_increasing_id().alias("uid"))
    flagged = _flagged(prints, n, scratch, bits_per_row, max_bits)
    alone = flagged.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    again = flagged.filter("maybe").select("doc_id", "uid", "sha")
    groups = scratch.save(again.groupBy("sha").agg(F.max(F.struct("doc_id", "uid")).alias("top"), F.count("*").alias("group_size")), "groups")
    large = F.col("group_size") > max(1, n // HOT_SHARE)
    hot = F.broadcast(groups.filter(large))
    met = again.join(hot, "sha").union(again.join(hot.select("sha"), "sha", "left_anti").join(groups, "sha"))
    grouped = met.select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("top.uid")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return alone.union(grouped)


def distinct_documents(docs: DataFrame, bits_per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """One row of each text, with the columns of ``docs``: of equal texts the row with the largest doc_id stays (null ranks lowest).

    Of rows that share text and doc_id the one with the largest hash of all its columns stays; of rows equal in every column, one. Null
    texts count as empty, and are a group with them; extra columns, maps or clashing names among them, are carried along. An empty table gives an empty result.

    Which rows go is worked out as in ``exact_dedup``, on rows of hashes; texts are then read again, and those of rows that the
    filter shows to stay pass through unshuffled.
    """
    scratch = Scratch(docs.sparkSession, "distinct")
    docs, back = apart(docs, "doc_id", "text")
    docs = docs.withColumn("_row", whole_row(docs))
    flagged = _flagged(docs.select("doc_id", _sha().alias("sha"), "_row"), docs.count(), scratch, bits_per_row, max_bits)
    rows = scratch.save(flagged.filter("maybe").groupBy("sha", "_row").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n")), "rows")
    tops = rows.groupBy("sha").agg(F.max(F.struct("doc_id", "_row"))["_row"].alias("top"), F.count("*").alias("kinds")).filter("kinds > 1")
    losers = rows.join(scratch.save(tops, "tops"), "sha").filter("_row <> top").select("_row")
    again = scratch.save(rows.filter("n > 1").select("_row").join(losers, "_row", "left_anti"), "again")
    gone = scratch.save(losers.union(again), "gone")
    stay = drop_some(docs, "_row", gone)
    twins = keep_some(docs, F.col("_row"), again, F.col("_row")).join(again, "_row", "left_semi").dropDuplicates(["_row"])
    return back(stay.select(*docs.columns).union(twins.select(*docs.columns)))
