"""Quality rules: per-text statistics, and robust multivariate outliers among them. DataFrame functions only."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, Scratch, pick

#: Least standard deviation of each statistic: a group in which nearly all texts agree must not reject the first other one.
FLOORS = {"length": 0.6, "letters": 0.12, "symbols": 0.08, "lines": 0.5, "repeats": 0.12, "capitals": 0.5}
STATS = list(FLOORS)
#: A concentration step must lower the logarithm of a group's determinant by more than this, or the group is done.
FALL = 1e-3


def text_stats(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper for the column ``text``.

    Words are kept as an array of hashes; windows of five words hash together. Only texts in which some window occurs
    twice have their windows sorted, to find which.
    """
    text = F.coalesce("text", F.lit(""))
    first = docs.withColumn("_words", F.array_remove(F.split(text, GAP), ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    second = first.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "_lines": lines,
        "_hash": F.transform("_words", lambda x: F.xxhash64(x)),
    }).drop("_words", "text")
    h = F.col("_hash")
    grams = F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), lambda i: F.xxhash64(*[h[i + j] for j in range(5)])))
    third = second.withColumns({"n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_grams": grams}).drop("_lines", "_hash")
    repeats = F.col("n_words") >= 5
    fourth = third.withColumn("_sorted", F.when(repeats & (F.size(F.array_distinct("_grams")) < F.size("_grams")), F.sort_array(F.transform("_grams", lambda x, i: F.struct(x.alias("g"), i.alias("i")))))).drop("_grams")
    s = F.col("_sorted")
    same = F.filter(s, lambda x, k: (F.when(k > 0, F.get(s, k - 1)["g"]) == x["g"]) | (F.get(s, k + 1)["g"] == x["g"]))
    fifth = fourth.withColumn("_places", F.sort_array(F.transform(same, lambda x: x["i"]))).drop("_sorted")
    p = F.col("_places")
    covered = F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-5).alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(5), x - a["at"])).alias("n"), x.alias("at")))
    return fifth.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long")).drop("_places")


def _vector(df: DataFrame) -> DataFrame:
    """The statistics on scales on which ordinary texts spread evenly."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns({
        "length": F.log1p("n_words"),
        "letters": F.log((F.col("word_chars") + 1) / n),
        "symbols": F.sqrt(F.col("n_symbols") / n),
        "lines": F.log1p("n_dup_lines"),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
        "capitals": F.log((F.col("n_upper") + 2) / (F.col("word_chars") + 40)),
    })


def chi2_quantile(share: float, p: int) -> float:
    """Of the chi-square distribution with an even number of degrees of freedom."""

    def above(x: float) -> float:
        return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) > 1 - share else (low, mid)
    return low


def _bins(value: Column) -> Column:
    return F.floor(F.log1p(value) * 512).cast("long")


def _lower_part(rows: DataFrame, share: float) -> DataFrame:
    """For each group the bin of ``distance`` that holds the given share of its rows: (gid, edge), from a histogram."""
    counts = rows.groupBy("gid", _bins(F.col("distance")).alias("bin")).agg(F.count("*").alias("n"))
    each = Window.partitionBy("gid")
    upto = counts.withColumns({"sum": F.sum("n").over(each.orderBy("bin")), "all": F.sum("n").over(each)})
    return upto.filter(F.col("sum") >= F.col("all") * share).groupBy("gid").agg(F.min("bin").alias("edge"))


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of the covariance of each group: (gid, m_i, l_i_j)."""
    sums = [F.count("*").alias("n"), *[F.avg(a).alias(f"m_{a}") for a in STATS]]
    sums += [F.avg(F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for i, a in enumerate(STATS) for b in STATS[: i + 1]]
    out = rows.groupBy("gid").agg(*sums)
    for i, a in enumerate(STATS):
        for j, b in enumerate(STATS[: i + 1]):
            value = F.col(f"c_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}")
            for c in STATS[:j]:
                value = value - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}")
            floor = FLOORS[a] ** 2
            out = out.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(value, F.lit(0.0)) + floor) if i == j else value / F.col(f"l_{b}_{b}"))
    return out.select("gid", *[f"m_{a}" for a in STATS], *[f"l_{a}_{b}" for i, a in enumerate(STATS) for b in STATS[: i + 1]])


def _logdet(estimates: DataFrame) -> DataFrame:
    """Adds ``logdet``, the logarithm of the covariance's determinant, to a table of estimates."""
    total = F.lit(0.0)
    for a in STATS:
        total = total + 2 * F.log(f"l_{a}_{a}")
    return estimates.withColumn("logdet", total)


def _distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds ``distance``, the squared Mahalanobis distance to the row's group."""
    out, keep = rows.join(estimates, "gid"), [*rows.columns, "distance"]
    for i, a in enumerate(STATS):
        value = F.col(a) - F.col(f"m_{a}")
        for c in STATS[:i]:
            value = value - F.col(f"l_{a}_{c}") * F.col(f"z_{c}")
        out = out.withColumn(f"z_{a}", value / F.col(f"l_{a}_{a}"))
    total = F.lit(0.0)
    for a in STATS:
        total = total + F.col(f"z_{a}") * F.col(f"z_{a}")
    return out.withColumn("distance", total).select(*keep)


def quality(docs: DataFrame, least_group: int = 50, share: float = 0.75, steps: int = 25, limit: float = 1 - 1e-5) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    base_failed: fewer than 10 words, or more than a fifth of them in windows of five words that the text repeats. The
    others are judged against texts of their language and source: location and scatter come from the ``share`` of the
    group that lies closest together (minimum covariance determinant, by concentration steps from the group's
    medians; the estimate of least determinant stays, and a group is done when a step no longer lowers it; ``steps`` at most, beyond which a warning says so), and a text is rejected whose squared distance, scaled down where the group's median exceeds that of the chi-square
    distribution, exceeds its quantile ``limit``. A group of under ``least_group`` texts is judged as its language, a small
    language as the whole table; if that is small too, nothing is rejected but by the base. Null languages and sources
    are groups. ``distance`` is null where nothing was judged. A null text has no words, texts of any length are read whole, repeated rows count each, rows that tie are judged alike, columns that clash
    with those used do not matter, and an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = text_stats(pick(docs, "doc_id", "lang", "source", "text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = scratch.save(_vector(stats.withColumn("base_failed", failed)), "stats")
    good = stats.filter("not base_failed")
    names = [F.xxhash64(F.lit(0), "lang", F.coalesce("source", F.lit("")), F.col("source").isNull()), F.xxhash64(F.lit(1), "lang"), F.lit(2).cast("long")]
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumns({"n1": F.sum("n").over(Window.partitionBy("lang"))})
    whole = sizes.agg(F.sum("n")).first()[0] or 0
    last = F.lit(2).cast("long") if whole >= least_group else F.lit(None).cast("long")
    chosen = sizes.select(names[0].alias("_g0"), F.when(F.col("n") >= least_group, names[0]).when(F.col("n1") >= least_group, names[1]).otherwise(last).alias("gid"))
    chosen = scratch.save(chosen, "chosen")
    level = F.explode(F.array(*names)).alias("gid")
    used = scratch.save(chosen.select("gid").distinct(), "used")
    rows = good.select(level, *STATS).join(used, "gid", "left_semi")
    rows = scratch.save(rows, "rows")

    middle = rows.groupBy("gid").agg(*[F.percentile_approx(a, 0.5, 1000).alias(f"m_{a}") for a in STATS])
    start = rows.join(scratch.save(middle, "middle"), "gid")
    spread = F.lit(0.0)
    for a in STATS:
        spread = spread + ((F.col(a) - F.col(f"m_{a}")) / FLOORS[a]) ** 2
    near = start.withColumn("distance", spread).select("gid", *STATS, "distance")
    best = None
    for step in range(steps):
        near = scratch.save(near, f"near-{step}")
        edges = scratch.save(_lower_part(near, share), f"edges-{step}")
        close = near.join(edges, "gid").filter(_bins(F.col("distance")) <= F.col("edge"))
        lower = _logdet(scratch.save(_estimate(close), f"made-{step}"))  # a table first, or the filter below is put into the factor's expressions
        if best is not None:
            was = best.select("gid", F.col("logdet").alias("_was"))
            lower = lower.join(was, "gid").filter(F.col("logdet") < F.col("_was") - FALL).drop("_was")
        lower = scratch.save(lower, f"lower-{step}")
        scratch.drop(*[f"{name}-{step}" for name in ("near", "edges", "made")])
        if not lower.head(1):
            break
        best = scratch.save(lower if best is None else best.join(lower.select("gid"), "gid", "left_anti").union(lower), f"best-{step}")
        near = _distances(rows, lower)  # the groups whose determinant still falls
    else:
        warnings.warn(f"some groups' determinants still fall after {steps} concentration steps", stacklevel=2)
    estimates = (best if best is not None else lower).drop("logdet")
    near = _distances(rows, estimates)
    scale = _lower_part(near, 0.5).select("gid", (F.exp((F.col("edge") + 1) / 512.0) - 1).alias("median"))
    final = scratch.save(estimates.join(scale, "gid"), "final")

    judged = stats.withColumn("_g0", names[0]).join(chosen, "_g0", "left")
    shown = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    ready = judged.filter("not base_failed and gid is not null").select(*shown, "gid", *STATS)
    scored = _distances(ready, final.drop("median")).join(final.select("gid", "median"), "gid")
    # What is joined here is a row per group, written to a table before: small, it is broadcast; large, AQE may split hot groups.
    typical = chi2_quantile(0.5, len(STATS))
    distance = F.col("distance") * typical / F.greatest(F.col("median"), F.lit(typical))
    out = scored.select(*shown, (distance <= chi2_quantile(limit, len(STATS))).alias("kept"), distance.alias("distance"))
    rest = judged.filter("base_failed or gid is null").select(*shown, (~F.col("base_failed")).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return out.union(rest)
