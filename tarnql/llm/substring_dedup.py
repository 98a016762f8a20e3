"""Repeated passages by compacting the de Bruijn graph of token windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import keep_some
from .common import Scratch, pick
from .hashing import _INVERSE, _P, _table, mix, tidy, word_hashes

#: Words of a minimizer, the marker by which windows are brought together.
MARK = 8
_ODD = mix(np.arange(1, MARK + 1, dtype=np.uint64)) | np.uint64(1)


class _Spans:
    """Hashes of any span of a run of words, from one running sum."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(words * _table(_P, self.n)[: self.n])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.total[end] - self.total[start]) * _table(_INVERSE, self.n)[start]
        return mix(h ^ mix((end - start).astype(np.uint64))).view(np.int64)


def _runs(window: int):
    """Documents to runs of windows that share a minimizer.

    A window's minimizer is its least 8-word run by hash, the leftmost if tied: it depends on the window's words
    alone, so equal windows have equal minimizers at equal places. Windows in sequence share one for a while; such
    a run of edges of the de Bruijn graph is one row, about one for every fifteen words.
    """
    marks = window - MARK + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, off, words in word_hashes(batch.column(2)):
                if len(words) < window:
                    continue
                mark = np.zeros(len(words) - MARK + 1, np.uint64)
                for j in range(MARK):
                    mark += words[j : len(mark) + j] * _ODD[j]
                mark = mix(mark)
                at = np.lib.stride_tricks.sliding_window_view(mark, marks).argmin(axis=1) + np.arange(len(mark) - marks + 1)
                doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
                start = np.flatnonzero(doc[: len(at)] == doc[window - 1 :])
                if not len(start):
                    continue
                at = at[start]
                cut = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
                lo, hi, own = start[cut[:-1]], start[cut[1:] - 1], doc[start[cut[:-1]]]
                spans = _Spans(words)(lo, hi + window)
                order = np.arange(len(own)) - np.searchsorted(own, own)
                rows = pa.array(own + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, (order.astype(np.int32), (lo - off[own]).astype(np.int32), (hi - off[own]).astype(np.int32), mark[at[cut[:-1]]].view(np.int64), spans))],
                    ["doc_id", "text_hash", "ord", "lo", "hi", "mark", "span"],
                )

    return tidy(run)


def _windows(window: int):
    """The windows of the given runs of a document: (doc_id, text_hash, start, name, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(3).to_pylist()
            for first, off, words in word_hashes(batch.column(2)):
                spans, starts, docs, weights = _Spans(words), [], [], []
                for i in range(len(off) - 1):
                    for r in wanted[first + i]:
                        starts.append(np.arange(r["lo"], r["hi"] + 1) + off[i])
                        docs.append(np.full(r["hi"] - r["lo"] + 1, i))
                        weights.append(np.full(r["hi"] - r["lo"] + 1, r["weight"], np.int32))
                if not starts:
                    continue
                s, d = np.concatenate(starts), np.concatenate(docs)
                rows = pa.array(d + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((s - off[d]).astype(np.int32)), pa.array(spans(s, s + window)), pa.array(np.concatenate(weights))],
                    ["doc_id", "text_hash", "start", "name", "weight"],
                )

    return tidy(run)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and their ranges to (doc_id, n_words, n_removed, kept_sha256, kept)."""
    for batch in batches:
        n, removed, sha = [], [], []
        for text, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = (text.as_py() or "").encode().split()
            total = len(words)
            if ranges:
                keep = np.ones(total, bool)
                for r in ranges:
                    keep[r["start"] : r["end"]] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            n.append(total)
            removed.append(total - len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def compact(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Nonbranching paths of a graph (span, next): rows (span, path, place) for every span with a predecessor on its path.

    A link counts if its tail has one successor and its head one predecessor. A null stands for an end: a span that
    stops or starts somewhere has one neighbour more there. Pointer doubling finds the first span of
    each path: each round joins the open pointers with all, and doubles the steps they reach back, so a path of n spans
    takes log2 n rounds. Spans of a closed ring have no first one; they stay paths of their own.
    """
    out = links.groupBy("span").agg(F.count("*").alias("n"), F.min("next").alias("next")).filter("n = 1 and span is not null")
    into = links.groupBy("next").agg(F.count("*").alias("n")).filter("n = 1").select("next")
    back = out.join(into, "next").select(F.col("next").alias("span"), F.col("span").alias("path"), F.lit(1).cast("long").alias("place"))
    state, done, step = scratch.save(back, "back-0"), None, 0
    limit = max(1, state.count()).bit_length() + 1
    while step < limit:
        reach = state.select(F.col("span").alias("_s"), F.col("path").alias("_p"), F.col("place").alias("_d"))
        after = state.join(reach, F.col("path") == F.col("_s"), "left")
        moved = scratch.save(after.select("span", F.coalesce("_p", "path").alias("path"), (F.col("place") + F.coalesce("_d", F.lit(0))).alias("place"), F.col("_p").isNotNull().alias("open")), f"back-{step + 1}")
        scratch.drop(f"back-{step}")
        state, step = moved.drop("open"), step + 1
        if not moved.filter("open").head(1):
            done = state
            break
    if done is None:  # rings are left: what still moves belongs to them
        done = moved.filter("not open").drop("open")
    return done


def repeated_ranges(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """Ranges of words (doc_id, text_hash, start, end, path) that windows occurring elsewhere cover.

    ``docs`` has doc_id, text_hash and text. Runs of windows whose minimizer occurs once are unique. Of the rest, a run
    that occurs twice or more with the same words is repeated whole; those are the repeated edges of the graph, and
    their nonbranching paths are compacted. As ends of passages count as branches, whoever holds a path's first run holds
    the whole path: each occurrence of that run is a range as long as the path, and its words are compared with the other
    occurrences' at their source coordinates. Where
    runs share a minimizer but not all their words, a passage begins or ends inside them: one occurrence of each such
    run is read again at its source coordinates, and its windows are compared one by one.
    """
    key = ["doc_id", "text_hash"]
    runs = scratch.save(docs.mapInArrow(_runs(window), "doc_id long, text_hash long, ord int, lo int, hi int, mark long, span long"), "runs")
    marks = runs.groupBy("mark").agg(F.count("*").alias("n"), F.min("span").alias("x"), F.max("span").alias("y")).filter("n > 1")
    marks = scratch.save(marks.select("mark", (F.col("x") < F.col("y")).alias("mixed")), "marks")  # a table, so that AQE may split a hot mark
    some = scratch.save(runs.join(marks, "mark"), "some")
    spans = some.groupBy("mark", "span", "mixed").agg(F.count("*").alias("n"), F.min(F.struct(*key, "lo", "hi")).alias("at"))
    spans = scratch.save(spans, "spans")
    whole = some.join(spans.filter("n > 1").select("mark", "span"), ["mark", "span"]).select(*key, "ord", "lo", "hi", "span").distinct()
    whole = scratch.save(whole, "whole")

    read = spans.filter("mixed").select("at.*", F.when(F.col("n") > 1, 2).otherwise(1).alias("weight"))
    read = read.groupBy(*key).agg(F.collect_list(F.struct("lo", "hi", "weight")).alias("wanted"))
    read = read.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    read = scratch.save(read, "read")
    some_docs = keep_some(docs, F.xxhash64("doc_id", "text_hash"), read, F.xxhash64("_id", "_hash"))
    again = some_docs.join(read, same).select(*key, "text", "wanted")
    windows = scratch.save(again.mapInArrow(_windows(window), "doc_id long, text_hash long, start int, name long, weight int"), "windows")
    twice = windows.groupBy("name").agg(F.sum("weight").alias("n")).filter("n > 1").select("name")
    edges = windows.filter("weight = 1").join(twice, "name").select(*key, "start", (F.col("start") + window).alias("end"), F.lit(None).cast("long").alias("path"))

    order = Window.partitionBy(*key).orderBy("ord")

    def beside(other: Callable[[str], Column], step: int) -> Column:
        return F.when(other("ord").over(order) == F.col("ord") + step, other("span").over(order))

    steps = whole.select("span", beside(F.lead, 1).alias("next"), beside(F.lag, -1).alias("last"))
    links = scratch.save(steps.select("span", "next").union(steps.filter("last is null").select("last", "span")).distinct(), "links")
    sizes = whole.groupBy("span").agg(F.min(F.col("hi") - F.col("lo") + 1).alias("size"))
    paths = compact(links, scratch).select(F.col("span").alias("_span"), "path")
    paths = sizes.join(paths, F.col("span") == F.col("_span"), "left").groupBy(F.coalesce("path", "span").alias("path")).agg(F.sum("size").alias("size"))
    paths = scratch.save(paths, "paths")
    claims = whole.join(paths, F.col("span") == F.col("path")).select(*key, F.col("lo").alias("start"), (F.col("lo") + F.col("size") - 1 + window).cast("int").alias("end"), "path")
    return verified(docs, scratch.save(claims, "claims"), scratch).unionByName(edges)


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text, claims) to a row for each claim: (doc_id, text_hash, start, end, path, digest of its words)."""
    for batch in batches:
        rows, claims, digests = [], [], []
        for i, (text, wanted) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            words = (text.as_py() or "").encode().split()
            for claim in wanted.as_py():
                rows.append(i)
                claims.append(claim)
                digests.append(hashlib.blake2b(b" ".join(words[claim["start"] : claim["end"]]), digest_size=16).digest())
        at = pa.array(rows, pa.int64())
        columns = [pa.array([c[k] for c in claims], t) for k, t in (("start", pa.int32()), ("end", pa.int32()), ("path", pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns, pa.array(digests, pa.binary())], ["doc_id", "text_hash", "start", "end", "path", "digest"])


def verified(docs: DataFrame, claims: DataFrame, scratch: Scratch) -> DataFrame:
    """Of ``claims`` (doc_id, text_hash, start, end, path) those whose words, read at these coordinates, stand at another claim of the path.

    A row that the table repeats is another place. Only claims that no other one bears out are joined out, so a path with
    many occurrences meets nothing.
    """
    wanted = claims.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end", "path")).alias("wanted"))
    wanted = scratch.save(wanted.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), "wanted")
    some = keep_some(docs, F.xxhash64("doc_id", "text_hash"), wanted, F.xxhash64("_id", "_hash"))
    read = some.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("doc_id", "text_hash", "text", "wanted")
    spelled = scratch.save(read.mapInArrow(tidy(_spelled), "doc_id long, text_hash long, start int, end int, path long, digest binary"), "spelled")
    alone = scratch.save(spelled.groupBy("path", "digest").agg(F.count("*").alias("n")).filter("n = 1").select("path", "digest"), "alone")
    return spelled.join(alone, ["path", "digest"], "left_anti").select("doc_id", "text_hash", "start", "end", "path").distinct()


def substring_dedup(docs: DataFrame, window: int = 35) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Words are maximal runs of characters that are not ASCII white space; a null text has none. A word goes if any
    ``window`` consecutive words that hold it also start elsewhere, in this document or another; windows are judged
    on the input. kept_sha256 is of the words left, joined by one blank (of none: of the empty string). Documents with
    fewer words lose nothing. Rows repeated with the same doc_id and text are occurrences of each other. Texts of any
    length are read whole, columns that clash with those used do not matter, and an empty table gives an empty result. Words,
    windows and runs are found by 64-bit hashes; passages of whole runs are verified by their words.
    """
    if window < MARK:
        raise ValueError(f"a window has at least {MARK} words")
    scratch = Scratch(docs.sparkSession, "passages")
    source = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    ranges = repeated_ranges(source, window, scratch)
    each = ranges.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    each = scratch.save(each.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), "ranges")
    scratch.drop("runs", "marks", "some", "spans", "whole", "read", "windows", "links", "paths", "claims", "wanted", "spelled", "alone")
    found = source.join(each, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return found.select("doc_id", "text", "ranges").mapInArrow(tidy(_strip), "doc_id long, n_words long, n_removed long, kept_sha256 string")
