"""URL verdicts: rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

# The rules of the contract, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

# Words of the small labelled URL table.
BLOCKED = "casino poker jackpot betting slots porn xxx adult escort camgirls viagra pills pharmacy torrent warez crack keygen malware phishing clickbait popunder adserver tracker doubleclick banner freegift payday loans spam".split()
ALLOWED = "news wiki docs blog article library museum university science history recipes garden weather travel music sports health school forum review guide research archive local culture economy nature book story".split()

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)


def labelled_urls() -> list[tuple[str, str, int]]:
    """The labelled table: host, path, label (1: block). Every word stands in host and in path, under mixed names; the rest
    are names of no meaning, made of common syllables, on every top-level domain and language path, and allowed."""
    rows, ends, tongues = [], ["com", "net", "org"], ["en", "de", "fr", "es"]
    for label, words in ((1, BLOCKED), (0, ALLOWED)):
        for i, w in enumerate(words):
            v = words[(i + 7) % len(words)]
            rows += [
                (f"{w}.example.{ends[i % 3]}", f"/{tongues[i % 4]}/{100 + 31 * i}", label),
                (f"www.{w}{v}.example.{ends[(i + 1) % 3]}", f"/{tongues[(i + 1) % 4]}/{i}", label),
                (f"m.site{i}.example.{ends[(i + 2) % 3]}", f"/{tongues[(i + 2) % 4]}/{w}/{v}", label),
                (f"my{w}.{ends[i % 3]}", "/", label),
            ]
    parts = "th er in on re an ti ha ing ou tion ed es en st at ly nd le ma so vi ka do pet bet por cas slo".split()
    for i in range(240):
        name = "".join(parts[(i * k + i // 29) % len(parts)] for k in (1, 3, 7)[: 2 + i % 2])
        rows.append((f"{['', 'www.', 'm.', 'blog.'][i % 4]}{name}.example.{ends[i % 3]}", f"/{tongues[(i // 3) % 4]}/{37 * i % 900}", 0))
    return rows


def _grams(texts: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram of ``^text$``, over all rows at once."""
    codes = [np.frombuffer(f"^{t}$".encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    flat = np.concatenate(codes).astype(np.uint64) if codes else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    at, where = [], []
    for n in GRAMS:
        if len(flat) < n:
            continue
        h = np.full(len(flat) - n + 1, seed * 31 + n, np.uint64)
        for j in range(n):
            h = (h ^ flat[j : len(flat) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        inside = row[: len(h)] == row[n - 1 :]
        at.append(row[: len(h)][inside])
        where.append((h[inside] >> np.uint64(48)).astype(np.int64) % BUCKETS)
    return (np.concatenate(at), np.concatenate(where)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and weights; each row's n-grams weigh 1 / sqrt of their number."""
    parts = [_grams(hosts, 1), _grams(paths, 2)]
    row, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    n = np.bincount(row, minlength=len(hosts))
    return row, at, 1 / np.sqrt(np.maximum(n, 1))[row]


@lru_cache(maxsize=1)
def train(epochs: int = 300, rate: float = 0.5, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from ``labelled_urls()`` by full-batch AdaGrad; always the same."""
    rows = labelled_urls()
    y = np.array([r[2] for r in rows], float)
    row, at, x = _features([r[0] for r in rows], [r[1] for r in rows])
    w, b, g, gb = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(epochs):
        z = b + np.bincount(row, w[at] * x, minlength=len(rows))
        e = (1 / (1 + np.exp(-z)) - y) / len(rows)
        d = np.bincount(at, e[row] * x, minlength=BUCKETS) + shrink * w
        g += d * d
        gb += e.sum() ** 2
        w -= rate * d / np.sqrt(g)
        b -= rate * 0.1 * e.sum() / np.sqrt(gb)
    return w, float(b)


def _score(w: np.ndarray, b: float):
    def run(batches):
        for t in batches:
            hosts, paths = t.column("host").to_pylist(), t.column("path").to_pylist()
            row, at, x = _features(hosts, paths)
            p = 1 / (1 + np.exp(-(b + np.bincount(row, w[at] * x, minlength=len(hosts)))))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(p)], [*t.schema.names, "score"])

    return run


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
    ``?``, ``#`` or the end. A null url or one without ``://`` has empty host and path, fits no rule and is judged
    by the model, as is every page without a fitting rule. Of the fitting rules the longest wins; rules are a
    short list held in the plan (at most some hundreds). The model is trained from a table of fixed size.
    """
    if len(rules) > 1000:
        raise ValueError("rules are held in the plan: give at most 1000")
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    split = (
        pick(pages, "page_id", "url")
        .withColumn("rest", rest)
        .select(
            "page_id",
            F.translate(F.regexp_extract("rest", r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
            F.regexp_extract("rest", r"\A[^/?#]*([^?#]*)", 1).alias("path"),
        )
    )
    scored = split.mapInArrow(_score(*train()), "page_id long, host string, path string, score double")
    rule = verdict = F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, model).alias("verdict"), "score")
