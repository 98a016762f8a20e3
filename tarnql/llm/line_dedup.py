"""Fuzzy duplicate lines by MinHash over the whole corpus.

Signatures and exact tests run in numpy, a batch at a time: in DataFrame functions alone they do not meet the limits (the
README has the figures). Everything between them is joins and aggregations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import fill, holds, in_share, keep_some, mark, repeated_keys, size_for
from .common import Scratch, components, pick
from .hashing import _INVERSE, _P, STEP, _table, distinct, mix, tidy

#: Characters of a shingle.
WIDTH = 5
_ODD = mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)
#: Bits of a shingle's hash; those above number the lines that are sorted together.
BITS = np.uint64(48)
#: Bins of the range of hashes; a line's signature is the least hash of each.
BINS = 128
#: Ways of banding: (from so many shingles, to fewer than so many, bands). Similar lines differ in size by a quarter at
#: most, so two of them always have a way in common. The first takes every hash in an eighth of the bins, not the least alone.
#: Bands are of even width: one of the few bins left over would be shared by lines that have little in common.
#: At similarity 0.8 that no band is shared has a chance of 0.003 at most the first way, 0.002 and 0.001 in between, and 0.0001 the last.
WAYS = [(1, 40, 8), (32, 80, 13), (64, 160, 18), (128, 1 << 40, 25)]
#: Lines of a band are compared with each other, by their bits, if they are so many at most; of larger bands all lines stay.
COMPARED = 4096
#: Lines of a band are paired out if they are so many at most; larger bands are searched by rarest shingles.
PAIRED = 256
#: Columns by which names of bands are dealt, and names that are filtered and grouped at once: more are taken in rounds.
SHARES, ROUND = 16, 1 << 25
#: Rows compared at once, or one larger band.
LOT = 1 << 16
#: Counters of shingles, by which rare ones are known, and those that tasks report together.
TALLIES, TALLY_SLICE = 1 << 21, 1 << 15

# Fixed value: what is trimmed from a line.
_TRIM = np.zeros(256, bool)
_TRIM[[32, 9, 11, 12, 13]] = True


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    return at, np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)


def _steps(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of ``STEP`` bytes, or one longer row."""
    first = 0
    while first < len(at) - 1:
        end = max(first + 1, int(np.searchsorted(at, at[first] + STEP, side="right")) - 1)
        yield first, end
        first = end


def lines_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, rows, bytes, row, number, start, stop and name of each line); blank lines are left out."""
    at, data = _buffers(texts)
    for first, end in _steps(at):
        raw, edges = data[at[first] : at[end]], at[first : end + 1] - at[first]
        breaks = np.flatnonzero(raw == 10)
        begins, ends = np.sort(np.concatenate([edges[:-1], breaks + 1])), np.sort(np.concatenate([breaks, edges[1:]]))
        count = 1 + np.diff(np.searchsorted(breaks, edges))
        row = np.repeat(np.arange(end - first), count)
        number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        ink = np.flatnonzero(~_TRIM[raw] & (raw != 10))
        i, j = np.searchsorted(ink, begins), np.searchsorted(ink, ends) - 1
        some = i <= j
        start, stop = ink[i[some]], ink[j[some]] + 1
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _table(_P, len(raw))[: len(raw)])])
        name = mix((total[stop] - total[start]) * _table(_INVERSE, len(raw))[start]).view(np.int64)
        yield first, end - first, raw, row[some], number[some], start, stop, name


def shingle_sets(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Character shingles of lines, given as spans of UTF-8 bytes, as (first line, lines, line, hash): sorted and distinct.

    A shingle is ``WIDTH`` code points in sequence; a line of fewer is one shingle.
    """
    lead = (raw & 0xC0) != 0x80
    lead[start] = True  # so that bytes that are not UTF-8 cannot reach over a line's start
    place = np.flatnonzero(lead)
    code = raw[place].astype(np.uint64)
    if len(place) < len(raw):
        after = np.append(place[1:], len(raw))
        for j in (1, 2, 3):
            more = np.flatnonzero(place + j < after)
            code[more] = (code[more] << np.uint64(8)) | raw[place[more] + j]
    low, high = np.searchsorted(place, start), np.searchsorted(place, stop)
    whole = np.zeros(max(0, len(code) - WIDTH + 1), np.uint64)
    for j in range(WIDTH):
        whole += code[j : len(whole) + j] * _ODD[j]
    whole = mix(whole) >> (np.uint64(64) - BITS)
    step = 1 << (64 - int(BITS))
    for first in range(0, len(start), step):
        lo, size = low[first : first + step], (high - low)[first : first + step]
        count = np.maximum(size - WIDTH + 1, 0)
        line = np.repeat(np.arange(len(lo)), count)
        at = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        keys = (line.astype(np.uint64) << BITS) | whole[at]
        short = np.flatnonzero(count == 0)
        if len(short):
            h = np.zeros(len(short), np.uint64)
            for j in range(WIDTH - 1):
                inside = size[short] > j
                h[inside] += code[lo[short[inside]] + j] * _ODD[j]
            h = mix(h ^ mix(size[short].astype(np.uint64))) >> (np.uint64(64) - BITS)
            keys = np.concatenate([keys, (short.astype(np.uint64) << BITS) | h])
        keys = distinct(keys)
        yield first, len(lo), (keys >> BITS).astype(np.int64), keys & ((np.uint64(1) << BITS) - np.uint64(1))


def signatures(line: np.ndarray, h: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, name) of the bands of lines, from their sorted shingles, and ``BINS`` bits of each line, as two numbers.

    A band is named by the least hash of each of its bins, and has no name if it is empty. Up to three shingles are one band, as such
    lines are alike only if they are equal. Every bin gives a bit of its least hash, or 0 if it is empty: what two lines do
    not share turns half of the bits it decides.
    """
    size = np.bincount(line, minlength=lines)
    place = ((h * np.uint64(BINS)) >> BITS).astype(np.int64)
    cell = line * BINS + place
    first = np.concatenate([[True], cell[1:] != cell[:-1]])[: len(h)]
    low, cell = mix(h[first]), cell[first]
    owner, place = cell // BINS, cell % BINS
    found = []
    for way, (least, most, bands) in enumerate(WAYS):
        own = ((size >= least) & (size < most))
        if not own.any():
            continue
        if way == 0:  # every hash
            some = np.flatnonzero(own[line])
            x, at, band = mix(h[some]), line[some], ((h[some] * np.uint64(BINS)) >> BITS).astype(np.int64) * bands // BINS
            band[size[at] < 4] = 0
        else:
            some = np.flatnonzero(own[owner])
            x, at, band = low[some], owner[some], place[some] * bands // BINS
        new = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (at[1:] != at[:-1])]))
        found.append((at[new], mix(np.add.reduceat(x, new) ^ mix(np.array([way], np.uint64)))))
    bits = np.zeros(2 * lines, np.uint64)
    if len(cell):
        word = cell >> 6
        new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        bits[word[new]] = np.bitwise_or.reduceat(((low >> np.uint64(17)) & np.uint64(1)) << (place & 63).astype(np.uint64), new)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[a for a, _ in found]]), np.concatenate([none, *[b.view(np.int64) for _, b in found]]), bits.reshape(lines, 2).view(np.int64)


KEYS = [f"keys{k}" for k in range(SHARES)]
DEALT = "doc_id long, uid long, line_no int, node long, n long, x long, y long, " + ", ".join(f"{c} array<long>" for c in KEYS)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, uid, text) to a row for each line that is not blank, and one with a null name for a document without any.

    Equal lines of a run of rows are signed once, at the first of them.
    """
    for batch in batches:
        for first, rows, raw, row, number, start, stop, name in lines_of(batch.column(2)):
            _, where = np.unique(name, return_index=True)
            where.sort()
            size, bits, owner, keys = np.zeros(len(name), np.int64), np.zeros((len(name), 2), np.int64), [], []
            for at, lines, line, h in shingle_sets(raw, start[where], stop[where]):
                size[where[at : at + lines]] = np.bincount(line, minlength=lines)
                own, key, bits[where[at : at + lines]] = signatures(line, h, lines)
                owner.append(where[at + own])
                keys.append(key)
            owner, keys = np.concatenate([np.zeros(0, np.int64), *owner]), np.concatenate([np.zeros(0, np.int64), *keys])
            order = np.argsort(owner, kind="stable")
            ends = np.searchsorted(owner[order], np.arange(len(name) + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order]))
            blank = np.setdiff1d(np.arange(rows), row)
            none = pa.nulls(len(blank))
            own = pa.array(np.concatenate([row, blank]) + first)
            columns = [batch.column(0).take(own), batch.column(1).take(own)]
            columns += [pa.concat_arrays([a, none.cast(a.type)]) for a in (pa.array(number.astype(np.int32)), pa.array(name), *(pa.array(c, mask=size == 0) for c in (size, bits[:, 0].copy(), bits[:, 1].copy())), found)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "line_no", "node", "n", "x", "y", "keys"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``_signed`` with names of bands dealt to the columns ``KEYS``."""
    for batch in _signed(batches):
        keys = batch.column(7)
        flat, owner = keys.flatten().to_numpy(), np.repeat(np.arange(len(keys)), keys.value_lengths().fill_null(0).to_numpy())
        columns = batch.columns[:7]
        for k in range(SHARES):
            some = np.flatnonzero(in_share(flat, (k, SHARES)))
            ends = np.searchsorted(owner[some], np.arange(len(keys) + 1)).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[some])))
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:7], *KEYS])


def _wanted(shared, bits: int):
    """(text) to (node, line) of the lines that a filter of nodes may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for _, _, raw, _, _, start, stop, name in lines_of(batch.column(0)):
                node, at = np.unique(name, return_index=True)
                held = holds(plane, node, bits)
                at = at[held]
                data = raw.tobytes()
                lines = [data[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node[held]), pa.array(lines, pa.binary())], ["node", "line"])

    return run


def _alike(percent: int):
    """(a, b, line of a, line of b) to the pairs whose lines' shingles reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [_buffers(batch.column(c).cast(pa.large_binary()).cast(pa.large_string(), safe=False)) for c in (2, 3)]
            edges = both[0][0] - both[0][0][0] + both[1][0] - both[1][0][0]
            for first, end in _steps(edges):
                sets = []
                for at, data in both:
                    raw, cut = data[at[first] : at[end]], at[first : end + 1] - at[first]
                    parts = [((line + low).astype(np.int64), h) for low, _, line, h in shingle_sets(raw, cut[:-1], cut[1:])]
                    sets.append([np.concatenate(p) for p in zip(*parts, strict=True)])
                n = end - first
                line, h = (np.concatenate([x, y]) for x, y in zip(*sets, strict=True))
                order = np.lexsort((h, line))
                line, h = line[order], h[order]
                twice = np.flatnonzero((line[1:] == line[:-1]) & (h[1:] == h[:-1]))
                same, every = np.bincount(line[twice], minlength=n), np.bincount(line, minlength=n)
                near = 100 * same >= percent * (every - same)
                if near.any():
                    yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, n).filter(pa.array(near)) for c in (0, 1)], ["a", "b"])

    return run


def _shingled(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Shingles of the lines in the last column as (first row, rows, row, hash)."""
    at, data = _buffers(batch.column(batch.num_columns - 1).cast(pa.large_binary()).cast(pa.large_string(), safe=False))
    for first, end in _steps(at):
        raw, cut = data[at[first] : at[end]], at[first : end + 1] - at[first]
        for low, lines, line, h in shingle_sets(raw, cut[:-1], cut[1:]):
            yield first + low, lines, line, h


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of the lines fall to each of ``TALLIES`` counters, slice by slice."""
    tally = np.zeros(TALLIES, np.int64)
    for batch in batches:
        for _, _, _, h in _shingled(batch):
            tally += np.bincount((h % TALLIES).astype(np.int64), minlength=TALLIES)
    parts = np.minimum(tally, 65535).astype("<u2").reshape(-1, TALLY_SLICE)
    some = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["slice", "tally"])


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(TALLY_SLICE, np.int64)
    for told in pdf["tally"]:
        total += np.frombuffer(told, "<u2")
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "tally": [np.minimum(total, 65535).astype("<u2").tobytes()]})


def tallies(lines: DataFrame, scratch: Scratch) -> bytes:
    """Counters of the shingles of lines (the one column): at least as many as a shingle has, as several share a counter."""
    told = lines.mapInArrow(tidy(_tallied), "slice int, tally binary")
    slices = scratch.save(told.groupBy("slice").applyInPandas(_summed, "slice int, tally binary"), "tallies")
    out = bytearray(2 * TALLIES)
    for row in slices.toLocalIterator():
        at = 2 * TALLY_SLICE * row["slice"]
        out[at : at + 2 * TALLY_SLICE] = row["tally"]
    scratch.drop("tallies")
    return bytes(out)


def _rarest(shared, percent: int):
    """(node, component, n, x, y, line) to the same with ``grams`` for the line: so many of its rarest shingles, rarest first, that
    two lines that are alike share one.

    Shingles are ordered by their counter, then by their hash: the order is the same for all lines, which is what makes this exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.frombuffer(shared.value, "<u2").astype(np.uint64)
        for batch in batches:
            for first, lines, line, h in _shingled(batch):
                order = np.lexsort(((tally[(h % TALLIES).astype(np.int64)] << BITS) | h, line))
                size = np.bincount(line, minlength=lines)
                place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
                early = place <= (size - (size * percent + 99) // 100)[line]
                ends = np.concatenate([[0], np.cumsum(np.bincount(line[early], minlength=lines))]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[order][early].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*[c.slice(first, lines) for c in batch.columns[:-1]], grams], [*batch.schema.names[:-1], "grams"])

    return run


def _rare_pairs(lines: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of lines (node, component, n, x, y, line) in different components that may be alike, by their rarest shingles.

    Lines that are alike share one of the first n - ceil(percent n / 100) + 1 shingles of each, and from the first that they share
    on, enough must follow in both. Only those shingles leave a line, and of them only such as may occur twice.
    """
    shared = lines.sparkSession.sparkContext.broadcast(tallies(lines.select("line"), scratch))
    schema = "node long, component long, n long, x long, y long, grams array<long>"
    index = scratch.save(lines.select("node", "component", "n", "x", "y", "line").mapInArrow(tidy(_rarest(shared, percent)), schema), "index")
    bits = size_for(index.agg(F.sum(F.size("grams"))).first()[0] or 0, 8, 1 << 29)
    twice = fill(index.select("grams"), bits, least=2)
    rows = index.select("node", "component", "n", "x", "y", F.posexplode("grams").alias("place", "gram"))
    rows = scratch.save(mark(rows, "gram", twice, bits).filter("maybe").drop("maybe"), "places")
    scratch.drop("index")
    other = rows.select("gram", *[F.col(c).alias(f"{c}2") for c in ("node", "component", "n", "x", "y", "place")])
    enough = (100 + percent) * F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) >= percent * (F.col("n") + F.col("n2"))
    both = rows.join(other, "gram").filter((F.col("component") < F.col("component2")) & enough & _near(percent))
    return both.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _near(percent: int) -> Column:
    """Whether lines (n, x, y) and (n2, x2, y2) may be alike: by size, and by the bits in which they differ.

    Of d shingles that only one of them has each turns a bit with a chance of a half, and of all the bits a tenth is turned at 0.8.
    Lines that are alike go beyond five standard deviations of that with a chance of one in a million.
    """
    apart = (F.col("n") + F.col("n2")) * ((100 - percent) / (100 + percent))
    share = (100 - percent) / 200
    most = F.least(0.5 * apart + 2.5 * F.sqrt(apart), F.lit(BINS * share + 5 * (BINS * share * (1 - share)) ** 0.5))
    turned = F.bit_count(F.col("x").bitwiseXOR(F.col("x2"))) + F.bit_count(F.col("y").bitwiseXOR(F.col("y2")))
    return (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (turned <= most)


def _met(percent: int, most: int):
    """Rows (key, node, n, x, y), ordered by key and n, to those that may be alike with another of the same key, with ``met``, the number
    of such others.

    Every two rows of a key that are near enough in size are compared by their bits, as in ``_near``. Of a key with more rows than
    ``most`` all stay, as if they had met so many.
    """
    ratio, share = (100 - percent) / (100 + percent), (100 - percent) / 200
    limit = BINS * share + 5 * (BINS * share * (1 - share)) ** 0.5

    def told(rows: list[np.ndarray], large: bool = False) -> pa.RecordBatch:
        key, _, n, x, y = rows
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(new, len(key)))
        end, size = np.repeat(new + size, size), np.repeat(size, size)
        met = np.where(large | (size > most), most, 0)
        i, step = np.flatnonzero(met == 0), 0
        while len(i):  # a row that is too small for the one so far behind it is so for all that follow
            step += 1
            i = i[i + step < end[i]]
            i = i[100 * n[i] >= percent * n[i + step]]
            j = i + step
            apart = (n[i] + n[j]) * ratio
            turned = np.bitwise_count(x[i] ^ x[j]).astype(np.int64) + np.bitwise_count(y[i] ^ y[j])
            near = turned <= np.minimum(0.5 * apart + 2.5 * np.sqrt(apart), limit)
            met[i[near]] += 1
            met[j[near]] += 1
        return pa.RecordBatch.from_arrays([pa.array(c[met > 0].view(np.int64)) for c in (*rows, met)], ["key", "node", "n", "x", "y", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count, large = [], 0, None
        for batch in batches:
            rows = [c.to_numpy().view(np.uint64) if k > 2 else c.to_numpy() for k, c in enumerate(batch.columns)]
            if large is not None and len(rows[0]):  # the rest of a key with too many rows
                more = int(np.searchsorted(rows[0], large, side="right"))
                if more:
                    yield told([c[:more] for c in rows], True)
                if more < len(rows[0]):
                    large = None
                rows = [c[more:] for c in rows]
            if not len(rows[0]):
                continue
            parts.append(rows)
            count += len(rows[0])
            if count < LOT:
                continue
            rows = [np.concatenate(c) for c in zip(*parts, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield told([c[:last] for c in rows])
            parts, count = [[c[last:] for c in rows]], len(rows[0]) - last
            if count > most:
                yield told(parts[0], True)
                parts, count, large = [], 0, rows[0][-1]
        if parts:
            yield told([np.concatenate(c) for c in zip(*parts, strict=True)])

    return run


def _meetings(own: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, n, x, y, KEYS) to (key, node, n, x, y, met), a row for each band of a line in which it may be alike with another line.

    Most of what shares a band shares little else, and the more lines there are the more so; it ends here, after one shuffle. Bands are taken
    in rounds by their names, so that neither the shuffle nor what the filter lets through grows with the table.
    """
    total = own.agg(F.sum(sum((F.size(c) for c in KEYS), F.lit(0)))).first()[0] or 0
    rounds = 1
    while rounds * ROUND < total:
        rounds *= 2
    found = []
    for k in range(rounds):  # each reads its columns, or one column and of it a part
        own_keys = F.concat(*KEYS[k * SHARES // rounds : (k + 1) * SHARES // rounds]) if rounds <= SHARES else F.col(KEYS[k * SHARES // rounds])
        share = (k, rounds) if rounds > SHARES else (0, 1)
        rows = repeated_keys(own.select(own_keys.alias("keys"), "node", "n", "x", "y"), share=share, apart=rounds // SHARES or 1).repartition("key").sortWithinPartitions("key", "n")
        found.append(scratch.save(rows.mapInArrow(tidy(_met(percent, COMPARED)), "key long, node long, n long, x long, y long, met long"), f"met/{k}"))
    return reduce(DataFrame.union, found)


def _tested(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    lines = keep_some(lines, F.col("node"), ends, F.col("node"))
    both = pairs.join(lines.select(F.col("node").alias("b"), F.col("line").alias("lb")), "b").join(lines.select(F.col("node").alias("a"), F.col("line").alias("la")), "a")
    return both.select("a", "b", "la", "lb").mapInArrow(tidy(_alike(percent)), "a long, b long")


def _once(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, n, x, y, KEYS) with one row for each node. Only rows that a filter takes for repeated ones are shuffled."""
    bits = size_for(signed.count(), 16, 1 << 29)
    marked = mark(signed, "node", fill(signed.select("node"), bits, least=2), bits)
    again = scratch.save(marked.filter("maybe").drop("maybe").dropDuplicates(["node"]), "again")
    return marked.filter("not maybe").drop("maybe").union(again)


def line_dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_lines (numbers of the lines that stay, from 0).

    Lines (trimmed; blank ones do not count and never go) are alike if the Jaccard similarity of their character shingles is
    ``percent`` or more. Of every component of alike lines, over all documents and within them, one occurrence stays: in the
    document with the smallest doc_id (nulls first), of its rows the first read, there the first line. A null or empty text has
    no lines. Documents with the same doc_id are separate rows, and repeated rows copies of the first. Lines of any length are read whole.
    Columns that clash with those used do not matter. An empty table gives an empty result.

    Equal lines become one node. Nodes that share a band and differ in few bits (see ``signatures``) are candidates, and of a band only those
    go on (see ``_meetings``); each is tested against the
    most central of the nodes it meets, the one that shares most with others. Where a band's nodes then still lie in several
    components, they are paired out across these if they are ``PAIRED`` at most; else the rest is searched by rarest
    shingles (see ``_rare_pairs``), so that no band of many lines is paired out. Every pair is verified by exact Jaccard. Components come from
    distributed union-find. Lines are named by 64 bits, shingles by 48.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    source = pick(docs, "doc_id", "text")
    numbered = source.select("doc_id", F.monotonically_increasing_id().alias("uid"), "text")
    signed = scratch.save(numbered.mapInArrow(tidy(_dealt), DEALT), "signed")

    places = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "uid", "line_no")
    nodes = scratch.save(signed.filter("node is not null").groupBy("node").agg(F.min(places).alias("first")), "nodes")
    every = scratch.save(signed.groupBy("uid").agg(F.min("doc_id").alias("doc_id"), F.count("node").alias("n_lines")), "every")
    own = _once(signed.filter("n is not null").select("node", "n", "x", "y", *KEYS), scratch)
    met = _meetings(own, percent, scratch)
    scratch.drop("signed", "again")
    signs = met.groupBy("node").agg(F.sum("met").alias("weight"), *[F.first(c).alias(c) for c in ("n", "x", "y")])
    signs = scratch.save(signs, "weighed")
    held = scratch.save(met.select("key", "node").join(signs, "node"), "known")
    scratch.drop("met")
    centre = scratch.save(held.groupBy("key").agg(F.max(F.struct("weight", "node", "n", "x", "y")).alias("centre")), "centre")
    met = held.join(centre, "key").select("node", "n", "x", "y", "centre", *[F.col(f"centre.{c}").alias(f"{c}2") for c in ("n", "x", "y")])
    best = met.filter(_near(percent)).groupBy("node").agg(F.max("centre")["node"].alias("centre")).filter("node <> centre")
    stars = scratch.save(best.select(F.col("centre").alias("a"), F.col("node").alias("b")), "stars")
    scratch.drop("centre")

    need = signs.select("node")
    bits = size_for(need.count(), 16, 1 << 27)
    wanted = source.select("text").mapInArrow(tidy(_wanted(docs.sparkSession.sparkContext.broadcast(fill(need, bits)), bits)), "node long, line binary")
    lines = scratch.save(wanted.join(need, "node", "left_semi").dropDuplicates(["node"]), "texts")
    first = scratch.save(_tested(stars, lines, percent), "first")
    joined = scratch.save(components(first, scratch, "one"), "joined")
    placed = scratch.save(held.join(joined, "node", "left").select("key", "node", "n", "x", "y", F.coalesce("component", "node").alias("component")), "placed")
    scratch.drop("known")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).filter("x < y")
    mixed = scratch.save(placed.join(mixed.select("key", "size"), "key"), "mixed")
    scratch.drop("placed")
    some = mixed.filter(F.col("size") <= PAIRED).drop("size")
    other = some.select("key", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "x", "y", "component")])
    small = some.join(other, "key").filter((F.col("component") < F.col("component2")) & _near(percent)).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
    active = mixed.filter(F.col("size") > PAIRED).select("node", "component").distinct()
    active = scratch.save(active, "active")
    small = scratch.save(small.distinct(), "small")
    scratch.drop("mixed")
    crowd = keep_some(lines, F.col("node"), active, F.col("node")).join(active, "node").join(signs.select("node", "n", "x", "y"), "node")
    large = _rare_pairs(scratch.save(crowd, "crowd"), percent, scratch)
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = scratch.save(small.union(large).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
    second = _tested(pairs, lines, percent)
    known = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = scratch.save(components(known.union(second), scratch, "two"), "final")

    kept = nodes.join(final, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    kept = kept.groupBy("first.uid").agg(F.sort_array(F.collect_list("first.line_no")).alias("kept_lines"))
    kept = scratch.save(kept, "kept")
    scratch.drop("nodes", "weighed", "stars", "texts", "first", "joined", "small", "active", "crowd", "places", "pairs", "final")
    return every.join(kept, "uid", "left").select(
        "doc_id",
        "n_lines",
        (F.col("n_lines") - F.coalesce(F.size("kept_lines"), F.lit(0))).alias("n_removed"),
        F.coalesce("kept_lines", F.array().cast("array<int>")).alias("kept_lines"),
    )


def keep_lines(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The texts after ``line_dedup``: doc_id, text with the kept lines, and blank ones, joined by line ends. doc_id must be unique."""
    both = pick(docs, "doc_id", "text").join(kept.select(F.col("doc_id").alias("_id"), "kept_lines"), F.col("doc_id").eqNullSafe(F.col("_id")))
    stays = F.filter(F.split("text", "\n"), lambda x, i: F.array_contains("kept_lines", i) | ~x.rlike(r"[^\x20\x09-\x0D]"))
    return both.select("doc_id", F.array_join(stays, "\n").alias("text"))
