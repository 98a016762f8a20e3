"""Bloom filters filled by tasks and merged slice by slice; their size is bounded, so they may be broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .hashing import tidy

#: Bits of a slice, the unit in which tasks report what they have seen.
SLICE = 1 << 16
#: Fingerprints worked on at once.
LOT = 1 << 18


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """The two filter positions of each 64-bit fingerprint, shape (2, n)."""
    u = h.view(np.uint64)
    return np.stack([u & np.uint64(bits - 1), (u >> np.uint64(32)) & np.uint64(bits - 1)])


def holds(plane: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether all positions of each fingerprint are set."""
    out = np.zeros(len(h), bool)
    for i in range(0, len(h), LOT):
        p = places(h[i : i + LOT], bits)
        out[i : i + LOT] = ((plane[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)
    return out


def _told(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Positions, slice by slice: those set once or more, and those set again."""
    at, n = np.unique(np.concatenate(parts), return_counts=True)
    cut = np.flatnonzero(np.diff(at >> np.uint64(16))) + 1
    rows = []
    for p, c in zip(np.split(at, cut), np.split(n, cut), strict=True):
        low = (p & np.uint64(SLICE - 1)).astype("<u2")
        rows.append((int(p[0]) // SLICE, low.tobytes(), low[c > 1].tobytes()))
    for i in range(0, len(rows), 256):
        k, a, b = zip(*rows[i : i + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["slice", "once", "again"])


def _flat(column: pa.Array) -> np.ndarray:
    return (column.flatten() if pa.types.is_list(column.type) else column).to_numpy(zero_copy_only=False)


def in_share(h: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Whether each fingerprint is in share k of so many."""
    k, shares = share
    return ((h.view(np.uint64) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(48)) * np.uint64(shares) >> np.uint64(16) == k


def _seen(bits: int, share: tuple[int, int] = (0, 1)):
    """A task reports the positions of its fingerprints, a million fingerprints or so at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            values = _flat(batch.column(0))
            for i in range(0, len(values), LOT):
                lot = values[i : i + LOT]
                parts.append(places(lot if share[1] == 1 else lot[in_share(lot, share)], bits).ravel())
                n += len(parts[-1])
                if n > 8 * LOT:
                    yield from _told(parts)
                    parts, n = [], 0
        if parts:
            yield from _told(parts)

    return run


def _merge(least: int):
    """The bits of slices that were set ``least`` times (1 or 2) or more, over all tasks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = {}
        for name, told in pdf.groupby("slice"):
            have, twice = np.zeros(SLICE, bool), np.zeros(SLICE, bool)
            for once, again in zip(told["once"], told["again"], strict=True):
                at = np.frombuffer(once, "<u2")
                twice[at[have[at]]] = True
                have[at] = True
                twice[np.frombuffer(again, "<u2")] = True
            made[name] = np.packbits(twice if least > 1 else have, bitorder="little").tobytes()
        return pd.DataFrame({"slice": list(made), "plane": list(made.values())})

    return run


def size_for(rows: int, bits_per_row: int, max_bits: int) -> int:
    """A power of two of bits, at least a slice and at most ``max_bits``."""
    bits = SLICE
    while bits < rows * bits_per_row and bits < max_bits:
        bits *= 2
    return bits


def fill(prints: DataFrame, bits: int, least: int = 1, share: tuple[int, int] = (0, 1)) -> bytes:
    """The filter of the fingerprints in the one column of ``prints``, of numbers or arrays of them: bits set ``least`` (1 or 2) times
    or more. Of them only those of a share count (see ``in_share``)."""
    told = prints.mapInArrow(tidy(_seen(bits, share)), "slice int, once binary, again binary")
    scratch = Scratch(prints.sparkSession, "filter")
    slices = scratch.save(told.groupBy(F.shiftright("slice", 3)).applyInPandas(_merge(least), "slice int, plane binary"), "slices")
    plane = bytearray(bits // 8)
    for row in slices.toLocalIterator():
        at = row["slice"] * (SLICE // 8)
        plane[at : at + SLICE // 8] = row["plane"]
    scratch.drop("slices")
    return bytes(plane)


def _maybe(spark: SparkSession, plane: bytes, bits: int):
    """A function of a column of 64-bit fingerprints: whether the filter may hold them. Only that column goes to Python; the
    row waits in the JVM."""
    shared = spark.sparkContext.broadcast(plane)

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(holds(np.frombuffer(shared.value, np.uint8), h.to_numpy(zero_copy_only=False), bits))

    return maybe


def mark(df: DataFrame, column: str, plane: bytes, bits: int) -> DataFrame:
    """Adds ``maybe``: whether the filter may hold the row's fingerprint, a column of 64-bit integers without nulls."""
    return df.withColumn("maybe", _maybe(df.sparkSession, plane, bits)(F.col(column)))


def _survivors(shared, bits: int, share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            keys = batch.column(0)
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            some = holds(plane, flat, bits)
            held = np.flatnonzero(some if share[1] == 1 else some & in_share(flat, share))
            owner = pa.array(np.repeat(np.arange(len(keys)), keys.value_lengths().fill_null(0).to_numpy())[held])
            yield pa.RecordBatch.from_arrays([pa.array(flat[held]), *[c.take(owner) for c in batch.columns[1:]]], ["key", *batch.schema.names[1:]])

    return run


def repeated_keys(rows: DataFrame, bits_per_key: int = 8, max_bits: int = 1 << 29, share: tuple[int, int] = (0, 1), apart: int = 1) -> DataFrame:
    """``rows`` (keys, an array of numbers, and other columns of numbers) to a row for each key that may occur twice in the table,
    or for those of them that are in a share, which is one of ``apart`` in these rows.

    A filter of bits set twice lets about one in twenty of those that occur once pass too. It takes 64 MB at most; where that
    is too small more keys pass, and what is grouped by key afterwards is the same.
    """
    n = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    bits = size_for(-(-n // apart), bits_per_key, max_bits)
    shared = rows.sparkSession.sparkContext.broadcast(fill(rows.select("keys"), bits, least=2, share=share))
    others = [c for c in rows.columns if c != "keys"]
    return rows.select("keys", *others).mapInArrow(tidy(_survivors(shared, bits, share)), ", ".join(["key long", *[f"{c} long" for c in others]]))


def keep_some(df: DataFrame, key: Column, others: DataFrame, other_key: Column, bits_per_row: int = 16, max_bits: int = 1 << 27) -> DataFrame:
    """Rows of ``df`` whose key is among those of ``others``, and about one in seventy of the rest.

    It thins a large table before a join, so that texts no one asks for are not shuffled. The filter takes 16 MB at most;
    where that is too small for ``others`` more rows pass, and the join after it stays exact.
    """
    bits = size_for(others.count(), bits_per_row, max_bits)
    return df.filter(_maybe(df.sparkSession, fill(others.select(other_key.alias("h")), bits), bits)(key))


def drop_some(df: DataFrame, column: str, dropped: DataFrame, bits_per_row: int = 16, max_bits: int = 1 << 27) -> DataFrame:
    """Rows of ``df`` whose ``column``, a 64-bit hash, is not in the one column of ``dropped``; only rows that the filter may hold are joined."""
    bits = size_for(dropped.count(), bits_per_row, max_bits)
    marked = mark(df, column, fill(dropped, bits), bits)
    others = dropped.select(F.col(dropped.columns[0]).alias("_key"))
    some = marked.filter("maybe").join(others, F.col(column) == F.col("_key"), "left_anti")
    return marked.filter("not maybe").select(*df.columns).union(some.select(*df.columns))
