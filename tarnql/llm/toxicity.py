"""Toxic documents by multiple-instance learning: sentences are scored, documents are labelled."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, pick
from .hashing import _INVERSE, _LOWER, _P, STEP, _table, mix, tidy

#: Hashed features; bucket 0 stands for none.
BUCKETS = 1 << 20
#: Lengths in bytes of the word beginnings that are features beside the word itself.
BEGINNINGS = (3, 4, 5, 6)

_INK = np.zeros(256, bool)
_INK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


def sentence_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, rows, doc of each word, sentence of each word, word hash, features of each word).

    Words are runs of letters and digits (A-Z lower-cased, all beyond ASCII taken as letters); sentences end at
    ``. ! ?`` and line ends and are numbered within their document from 0. Features are a bucket for the word and for
    each of its beginnings that is shorter than it, else 0.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + STEP, side="right")) - 1)
        raw, edges = _LOWER[data[at[first] : at[end]]], at[first : end + 1] - at[first]
        ink = _INK[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[edges] = True
        before, after = np.concatenate([[False], ink[:-1]])[: len(ink)], np.concatenate([ink[1:], [False]])[: len(ink)]
        start = np.flatnonzero(ink & (~before | edge[:-1]))
        stop = np.flatnonzero(ink & (~after | edge[1:])) + 1
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _table(_P, len(raw))[: len(raw)])])
        back = _table(_INVERSE, len(raw))[start]
        word = mix((total[stop] - total[start]) * back)
        marks = [(word >> np.uint64(44)).astype(np.int32) % (BUCKETS - 1) + 1]
        for size in BEGINNINGS:
            longer = stop - start > size
            h = mix((total[np.minimum(start + size, len(raw))] - total[start]) * back + np.uint64(size))
            marks.append(np.where(longer, (h >> np.uint64(44)).astype(np.int32) % (BUCKETS - 1) + 1, 0))
        doc = np.searchsorted(edges, start, side="right") - 1
        ends = np.concatenate([[0], np.cumsum(_END[raw])])
        yield first, end - first, doc, ends[start] - ends[edges[doc]], word, np.stack(marks, axis=1)
        first = end


def _distinct(doc: np.ndarray, sentence: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Places of the first of each word in each sentence, in order of sentence."""
    order = np.lexsort((word, sentence, doc))
    d, s, w = doc[order], sentence[order], word[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (w[1:] != w[:-1])
    return order[new]


def _fit(epochs: int, rate: float, shrink: float, least_gain: float):
    """In one task: labelled texts (label, text) to a model, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, docs, sentences, marks, seen = [], [], [], [], [np.zeros(BUCKETS), np.zeros(BUCKETS)]
        for batch in batches:
            for first, rows, doc, sentence, word, feature in sentence_words(batch.column(1)):
                at = _distinct(doc, sentence, word)
                own = batch.column(0).slice(first, rows).to_pylist()
                pairs = np.unique(np.repeat(doc[at], feature.shape[1]) * BUCKETS + feature[at].ravel())
                for k in (0, 1):
                    bucket, n = np.unique(pairs[np.array(own)[pairs // BUCKETS] == k] % BUCKETS, return_counts=True)
                    seen[k][bucket] += n
                docs.append((doc[at] + len(labels)).astype(np.int32))
                sentences.append(sentence[at].astype(np.int32))
                marks.append(feature[at])
                labels += own
        y = np.array(labels, float)
        if not docs or y.min(initial=1) == y.max(initial=0):
            return
        doc, sentence, mark = np.concatenate(docs), np.concatenate(sentences), np.concatenate(marks)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])
        row = np.cumsum(new) - 1
        owner = doc[new]
        # Only buckets seen in significantly more of the toxic documents are kept (log-likelihood ratio).
        size = [float((y == k).sum()) for k in (0, 1)]
        both = seen[0] + seen[1]
        gain = np.zeros(BUCKETS)
        for k in (0, 1):
            for have, share in ((seen[k], both / len(y)), (size[k] - seen[k], 1 - both / len(y))):
                gain += 2 * have * np.log(np.maximum(have, 1e-9) / np.maximum(size[k] * share, 1e-9))
        kept = (gain > least_gain) & (seen[1] / size[1] > seen[0] / size[0])
        kept[0] = False
        mark[~kept[mark]] = 0
        used = np.flatnonzero(np.bincount(mark.ravel(), minlength=BUCKETS))
        used = used[used > 0]
        short = np.zeros(BUCKETS, np.int32)
        short[used] = np.arange(1, len(used) + 1)
        mark = short[mark]
        some = mark.any(axis=1)
        mark, row = mark[some], row[some]
        w, g = np.zeros(len(used) + 1), np.full(len(used) + 1, 1e-6)
        b, gb = -6.0, 1e-6
        weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y == 0).sum()))) / len(y)
        for _ in range(epochs):
            z = b + np.bincount(row, w[mark].sum(axis=1), minlength=len(owner))
            p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(y))  # log of the chance that no sentence is toxic
            miss = np.exp(clean)
            pull = np.where(y > 0, -miss / np.maximum(1 - miss, 1e-9), 1.0) * weight
            d = np.clip(pull[owner] * p, -1, 1)
            grad = np.bincount(mark.ravel(), np.repeat(d[row], mark.shape[1]), minlength=len(w)) + shrink * w
            grad[0] = 0
            g += grad * grad
            w -= rate * grad / np.sqrt(g)
            gb += d.sum() ** 2
            b -= rate * d.sum() / np.sqrt(gb)
        out = io.BytesIO()
        np.savez(out, used=used.astype(np.int32), w=w[1:].astype(np.float32), b=np.array([b]))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    return run


class Model:
    """Weights by bucket and a bias. None given: nothing is toxic."""

    def __init__(self, data: bytes | None):
        self.w, self.b = np.zeros(BUCKETS, np.float32), -35.0
        if data:
            with np.load(io.BytesIO(data)) as f:
                self.w[f["used"]], self.b = f["w"], float(f["b"][0])

    def sentences(self, doc: np.ndarray, sentence: np.ndarray, word: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, sentence, logit) of every sentence that has words."""
        value = self.w[mark].sum(axis=1)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (sentence[1:] != sentence[:-1])
        row = np.cumsum(new) - 1
        z = np.full(int(new.sum()), self.b)
        some = np.flatnonzero(np.abs(value) > 1e-6)
        if len(some):
            at = some[_distinct(doc[some], sentence[some], word[some])]
            z += np.bincount(row[at], value[at], minlength=len(z))
        return doc[new], sentence[new], z


def _score(shared):
    made: list[Model] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Model(shared.value))
        model = made[0]
        for batch in batches:
            n = batch.num_rows
            score, worst, where = np.zeros(n), np.zeros(n), np.full(n, -1)
            for first, rows, *words in sentence_words(batch.column(1)):
                doc, sentence, z = model.sentences(*words)
                p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=rows)
                score[first : first + rows] = -np.expm1(clean)
                order = np.lexsort((-sentence, p, doc))
                last = np.flatnonzero(np.diff(np.append(doc[order], rows)))
                worst[first + doc[order[last]]], where[first + doc[order[last]]] = p[order[last]], sentence[order[last]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(where), pa.array(worst)], ["doc_id", "score", "worst_sentence", "worst_score"])

    return run


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 3000, epochs: int = 200, rate: float = 0.3, shrink: float = 1e-4, least_gain: float = 15.0) -> bytes | None:
    """A model from at most ``per_label`` labelled documents of either label, the first by a hash of doc_id, whole texts.

    Held-out rows take no part. The sample is gathered in one task, which fits the weights by AdaGrad; only they
    reach the driver. Without both labels there is no model.
    """
    known = pick(labels, "doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        sample = part if sample is None else sample.union(part)
    texts = pick(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * per_label)
    rows = texts.select(F.col("toxic").cast("int"), "text").coalesce(1).mapInArrow(_fit(epochs, rate, shrink, least_gain), "model binary").collect()
    return bytes(rows[0]["model"]) if rows else None


def toxicity(docs: DataFrame, model: bytes | None, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, worst_sentence, worst_score.

    A sentence's chance is logistic in its distinct words; a document is toxic unless none of its sentences is
    (noisy-or). worst_sentence is the number of the sentence with the highest chance, the first if tied. A text
    without words (null, empty) has score 0 and worst_sentence -1. A null doc_id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = pick(docs, "doc_id", "text").mapInArrow(tidy(_score(shared)), "doc_id long, score double, worst_sentence long, worst_score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_sentence", "worst_score")


def _locate(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        model = Model(shared.value)
        for batch in batches:
            ids, texts, out = batch.column(0).to_pylist(), batch.column(1), []
            for first, _, *words in sentence_words(texts):
                doc, sentence, z = model.sentences(*words)
                p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                for i in np.flatnonzero(p >= least):
                    row = first + int(doc[i])
                    out.append((ids[row], int(sentence[i]), re.split(r"[.!?\n]", texts[row].as_py())[sentence[i]].strip(), float(p[i])))
            if out:
                a, b, c, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c), pa.array(d)], ["doc_id", "sentence", "text", "score"])

    return run


def toxic_sentences(docs: DataFrame, model: bytes | None, least: float = 0.5) -> DataFrame:
    """The sentences that offend: doc_id, sentence (its number), text, score, where the chance is ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return pick(docs, "doc_id", "text").mapInArrow(_locate(shared, least), "doc_id long, sentence long, text string, score double")


def clean_documents(docs: DataFrame, model: bytes | None, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, with the columns of ``docs``. A text without words (null, empty) stays.

    Only texts go to Python, and one truth value a row comes back. Repeated rows are judged each, and alike; columns that clash
    with ``text`` but for case are carried along. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = _score(shared)

        def judged(part: pa.Array) -> pa.Array:
            found = [np.zeros(0, bool)]
            for start in range(0, len(part), 500):
                texts = part.slice(start, 500)
                batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(texts), np.int64)), texts], ["doc_id", "text"])
                found += [scored.column(1).to_numpy() < threshold for scored in score(iter([batch]))]
            return pa.array(np.concatenate(found))

        yield from tidy(lambda parts: map(judged, parts))(parts)

    docs, back = apart(docs, "text")
    return back(docs.filter(clean("text")))


def trained_on(spark: SparkSession, sf_dir: str, docs: DataFrame) -> bytes | None:
    """The model for a folder of tables: labels beside the documents given."""
    return train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
