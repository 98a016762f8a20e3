"""Packing documents into fixed-length sequences as a cutting-stock problem solved by column generation."""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, running_total
from .hashing import tidy

# Fixed value: the split rule of byte-level BPE.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(path: str) -> Callable[[str], bytes]:
    """Text to little-endian 32-bit ids, those that the tokenizers library gives for the file.

    A byte-level BPE whose ids are in order of its merges runs in tiktoken, which encodes whole texts four times
    as fast and gives the same ids; any other file, a text that holds the string of a special token, and one that tiktoken
    gives up on (its regular expressions have a bounded stack, which a million blanks in a row exceed), goes through tokenizers.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    special = [t.content for t in made.get_added_tokens_decoder().values()]

    def plain(text: str) -> bytes:
        return np.array(made.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"].get("vocab", {}), spec["model"].get("merges", [])
    letters, pre = _byte_letters(), spec.get("pre_tokenizer") or {}
    order = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
    ranked = order == sorted(order) and all(i > 255 for i in order)
    if not (ranked and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("dropout")):
        return plain
    import tiktoken

    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    fast = tiktoken.Encoding("fast", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return plain(text)
        try:
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        except Exception:  # tiktoken has no error type of its own
            return plain(text)

    return encode


def _cut(path: str, length: int, width: int, end: int, keep_ids: bool):
    """Documents to pieces: full sequences first, then the rest; each piece with its number within partition and class.
    A third column is handed through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        stop = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows, own = [], []
            for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                ids = encode(text.as_py() or "") + stop
                n = len(ids) // 4
                for start in range(0, n, length):
                    body = ids[4 * start : 4 * (start + length)]
                    size = len(body) // 4
                    kind = -(-size // width)
                    rows.append((doc, start, size, zlib.crc32(body), n, kind, part, seen[kind], np.frombuffer(body, "<u4").tolist() if keep_ids else None))
                    own.append(row)
                    seen[kind] += 1
                if len(rows) > 5000:
                    yield _batch(rows, keep_ids, batch.columns[2:], own)
                    rows, own = [], []
            if rows:
                yield _batch(rows, keep_ids, batch.columns[2:], own)

    return tidy(run)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kind int"


def _batch(rows: list[tuple], keep_ids: bool, carried: list[pa.Array], own: list[int]) -> pa.RecordBatch:
    doc, start, size, crc, n, kind, part, at, ids = zip(*rows, strict=True)
    columns = {"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(n, pa.int64()), "kind": pa.array(kind, pa.int32())}
    if keep_ids:
        columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
    columns |= {"part": pa.array(part, pa.int32()), "at": pa.array(at, pa.int64())}
    return pa.RecordBatch.from_pydict(columns | {"order": c.take(pa.array(own)) for c in carried})


def _best_pattern(worth: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Pricing: the pattern of greatest worth that fits, by dynamic programming over the room used."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        fit = np.searchsorted(sizes, w, side="right")
        if fit:
            got = value[w - sizes[:fit]] + worth[:fit]
            i = int(got.argmax())
            if got[i] > value[w - 1] + 1e-12:
                value[w], choice[w] = got[i], i
                continue
        value[w] = value[w - 1]
    out, w = np.zeros(len(sizes)), room
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            out[choice[w]] += 1
            w -= sizes[choice[w]]
    return float(value[room]), out


def _first_basis(sizes: np.ndarray, need: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis, close to the optimum: the largest size left, topped up largest first, as often as any of its
    sizes lasts. Each pattern uses up one size, which later ones lack, so the matrix is triangular up to order."""
    left, active, columns, times = need.copy(), np.ones(len(sizes), bool), [], []
    for _ in sizes:
        column, free = np.zeros(len(sizes)), room
        some = np.flatnonzero(active & (left > 0))
        for i in (some if len(some) else np.flatnonzero(active)[:1])[::-1]:
            if sizes[i] <= free:
                column[i] = free // sizes[i]
                free -= column[i] * sizes[i]
        held = np.flatnonzero(column)
        lasts = left[held] / column[held]
        out = held[lasts.argmin()]
        columns.append(column)
        times.append(lasts.min())
        left = np.maximum(left - lasts.min() * column, 0)
        left[out], active[out] = 0, False
    return np.array(columns).T, np.array(times)


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan steps on whole rows. (The driver's BLAS may run threads, which a forked session can leave hung.)"""
    both = np.hstack([a.astype(float), np.eye(len(a))])
    for i in range(len(a)):
        at = i + int(np.abs(both[i:, i]).argmax())
        both[[i, at]] = both[[at, i]]
        both[i] /= both[i, i]
        other = both[:, i].copy()
        other[i] = 0
        both -= np.outer(other, both[i])
    return both[:, len(a) :]


def patterns(demand: dict[int, int], room: int, rounds: int = 4000) -> list[tuple[int, dict[int, int]]]:
    """(times, {size: count}) patterns that use every piece exactly once, nearly as few sequences as possible.

    The linear program min sum(x) with A x = demand starts from a greedy basis. Its simplex multipliers are the
    worth of each size; the knapsack prices a new pattern, which enters the basis, until none is worth more than a
    sequence, or ``rounds`` have passed (every round's solution is feasible). Solutions are rounded down; what is left over, at most a basis full, is packed best fit, largest first.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0))
    if not len(sizes):
        return []
    need = np.array([demand[s] for s in sizes], float)
    basis, x = _first_basis(sizes, need, room)
    inverse = _inverse(basis)
    for _ in range(rounds):
        value, column = _best_pattern(inverse.sum(axis=0), sizes, room)
        if value <= 1 + 1e-7:
            break
        step = (inverse * column).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        move = ratio[out]
        x = np.maximum(x - move * step, 0)
        x[out] = move
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    times = np.floor(x + 1e-9)
    left = need - (basis * times).sum(axis=1)
    for i in np.argsort(x - times):  # rounding errors must not use a piece twice
        while (left < -0.5).any() and times[i] > 0:
            times[i] -= 1
            left = left + basis[:, i]
    made = [(int(t), {int(s): int(c) for s, c in zip(sizes, basis[:, i], strict=True) if c}) for i, t in enumerate(times) if t > 0]
    bins: dict[int, list[Counter]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        size = int(sizes[i])
        for _ in range(round(left[i])):
            free = min((r for r in bins if r >= size and bins[r]), default=None)
            content = bins[free].pop() if free is not None else Counter()
            content[size] += 1
            bins.setdefault((room if free is None else free) - size, []).append(content)
    rest = Counter(frozenset(c.items()) for found in bins.values() for c in found)
    return made + [(n, dict(sorted(p))) for p, n in sorted(rest.items(), key=lambda x: sorted(x[0]))]


def _layout(made: list[tuple[int, dict[int, int]]]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """For each kind, blocks (first rank, count in the pattern, pattern, first slot) by rank; and how often each pattern is used."""
    layout: dict[int, list] = {}
    used: Counter = Counter()
    for number, (times, pattern) in enumerate(made):
        slot = 0
        for kind in sorted(pattern, reverse=True):
            layout.setdefault(kind, []).append((used[kind], pattern[kind], number, slot))
            used[kind] += times * pattern[kind]
            slot += pattern[kind]
    return {k: np.array(v, np.int64) for k, v in layout.items()}, np.array([times for times, _ in made], np.int64)


def _assign(shared):
    """Ranked pieces to sequences and slots, pattern by pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, times = shared.value
        first = np.concatenate([[0], np.cumsum(times)])
        for b in batches:
            kind, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("kind", "rank"))
            seq, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for k in np.unique(kind):
                own, rows = kind == k, layout[int(k)]
                at = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                q = rank[own] - at[:, 0]
                seq[own], slot[own] = first[at[:, 2]] + q // at[:, 1], at[:, 3] + q % at[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(slot)], [*b.schema.names, "sequence_id", "slot"])

    return run


def _due(copy: np.ndarray, pattern: int, times: np.ndarray) -> np.ndarray:
    """When the copies of a pattern are due, from 0 to 1: spread evenly, each pattern from a start of its own."""
    return (copy + (0.5 + pattern * 0.6180339887498949) % 1.0) / times[pattern]


def _due_by(time: np.ndarray, pattern: int, times: np.ndarray, also: bool) -> np.ndarray:
    """How many copies of a pattern are due before the given times, or ``also`` just then."""
    side = np.less_equal if also else np.less
    n = np.clip((time * times[pattern]).astype(np.int64) - 1, 0, times[pattern])  # at most the true number
    while (more := (n < times[pattern]) & side(_due(n, pattern, times), time)).any():
        n += more
    return n


def _turns(rank: np.ndarray, rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pattern, copy, place among those of the kind in it) of the pieces of a kind, by rank, if places are filled as they are due."""
    low, high = np.zeros(len(rank), np.int64), np.full(len(rank), np.float64(2.0).view(np.int64))
    while (low < high).any():  # the time of each place, found bit by bit: positive floats are in order of their bits
        mid = (low + high) // 2
        enough = sum(count * _due_by(mid.view(np.float64), p, times, True) for _, count, p, _ in rows.tolist()) > rank
        high, low = np.where(enough, mid, high), np.where(enough, low, mid + 1)
    time = low.view(np.float64)
    rest = rank - sum(count * _due_by(time, p, times, False) for _, count, p, _ in rows.tolist())
    out, copy, place, open_ = (np.zeros(len(rank), np.int64) for _ in range(4))
    for at, (_, count, p, _) in enumerate(rows.tolist()):  # patterns due at the same time, in their order
        n = _due_by(time, p, times, False)
        here = (open_ == 0) & (_due_by(time, p, times, True) > n)
        found = here & (rest < count)
        out[found], copy[found], place[found], open_[found] = at, n[found], rest[found], 1
        rest -= np.where(here & ~found, count, 0)
    return out, copy, place


def _assign_in_turn(shared):
    """Pieces ranked in order to sequences and slots: sequences are numbered as they are due, all patterns at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, times = shared.value
        for b in batches:
            kind, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("kind", "rank"))
            pattern, copy, slot, seq = (np.zeros(len(kind), np.int64) for _ in range(4))
            for k in np.unique(kind):
                own, rows = kind == k, layout[int(k)]
                at, copy[own], place = _turns(rank[own], rows, times)
                pattern[own], slot[own] = rows[at, 2], rows[at, 3] + place
            time = np.zeros(len(kind))
            for p in np.unique(pattern):
                time[pattern == p] = _due(copy[pattern == p], int(p), times)
            for other in range(len(times)):
                seq += np.where(other < pattern, _due_by(time, other, times, True), _due_by(time, other, times, False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(slot)], [*b.schema.names, "sequence_id", "slot"])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, width: int = 4, end: int = 0, keep_ids: bool = False, order: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if kept).

    A document's ids are the tokenizer's, then ``end``; null and empty texts are that one id, a null doc_id is kept. A document longer
    than ``length`` is cut into full sequences and a rest, however long its text; nothing else is cut. Rests are classed by length in
    steps of ``width``; the histogram of classes, at most length / width numbers, is all the driver sees. Column
    generation turns it into patterns, rounded to whole numbers, and the pieces of a class, ranked over the
    whole table, are dealt to the patterns' places. Offsets are gapless from 0. A sequence holds ``length`` ids at most; one with fewer is
    padded to ``length`` by whoever writes it out, unless the number of its ids is a power of two: it then stands as it is, with no padding.
    Repeated documents are packed as often as they occur; ties change nothing. Columns that clash with those used do not matter. An empty table gives an empty result.

    With ``order``, the name of a column, sequences come in that order as far as packing allows: the copies of every pattern are
    spread evenly over the run, sequences are numbered as they are due, and the pieces of a class fill its places in order.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    schema = PIECE + ", ids array<int>" * keep_ids
    source = pick(docs, "doc_id", "text", *[order] * (order is not None))
    carried = f", order {source.schema[-1].dataType.simpleString()}" if order else ""
    pieces = scratch.save(source.mapInArrow(_cut(tokenizer, length, width, end, keep_ids), f"{schema}, part int, at long{carried}"), "pieces")
    counts = scratch.save(pieces.groupBy("part", "kind").agg(F.count("*").alias("n")), "counts")
    demand = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    room = length // width
    rests = {k: n for k, n in demand.items() if k != room}
    made = patterns(rests, room) + ([(demand[room], {room: 1})] if room in demand else [])
    shared = spark.sparkContext.broadcast(_layout(made))
    if order:
        one = pieces.drop("part", "at").withColumn("_one", F.lit(1).cast("long"))
        ranked = running_total(one, scratch, "ranked", "kind", [F.col("order"), F.col("start")], "_one").withColumnRenamed("before", "rank").drop("_one", "order")
    else:
        earlier = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select(F.col("part").alias("_p"), F.col("kind").alias("_k"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_s"))
        ranked = pieces.join(starts, (F.col("part") == F.col("_p")) & (F.col("kind") == F.col("_k"))).withColumn("rank", F.col("_s") + F.col("at")).drop("_p", "_k", "_s", "part", "at")
    placed = ranked.mapInArrow((_assign_in_turn if order else _assign)(shared), f"{schema}, rank long, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids)
