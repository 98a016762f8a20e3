"""Compacted paths carry the passages, and their words are read again before anything goes."""

import random

from pyspark.sql import functions as F

from tarnql.llm.common import Scratch, pick
from tarnql.llm.substring_dedup import repeated_ranges, verified

from .cases import frame, prose


def _named(df):
    return pick(df, "doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def test_a_long_passage_is_one_path_for_each_occurrence(spark):
    rng = random.Random(5)
    passage = prose(rng, 900)
    docs = [(k, f"{prose(rng, 50)} {passage} {prose(rng, 40)}", "", "") for k in range(3)]
    found = repeated_ranges(_named(frame(spark, docs)), 35, Scratch(spark, "t")).collect()
    paths = [r for r in found if r.path is not None]
    assert sorted(r.doc_id for r in paths) == [0, 1, 2] and len({r.path for r in paths}) == 1
    assert all(r.end - r.start > 700 for r in paths)
    for k in range(3):
        covered = set().union(*[range(r.start, r.end) for r in found if r.doc_id == k])
        assert covered == set(range(50, 950))


def test_paths_end_where_passages_do(spark):
    """Parts of a passage stand alone, first, last and in the middle of it: every occurrence is covered whole."""
    rng = random.Random(6)
    long = prose(rng, 400).split(" ")
    parts = [(0, 400), (0, 400), (0, 150), (120, 300), (250, 400), (0, 400)]
    docs = [(k, f"{prose(rng, 40)} {' '.join(long[a:b])} {prose(rng, 40)}", "", "") for k, (a, b) in enumerate(parts)]
    docs += [(10, " ".join(long[150:260]), "", ""), (11, " ".join(long[150:260]) + " " + prose(rng, 40) + " " + " ".join(long), "", "")]
    found = repeated_ranges(_named(frame(spark, docs)), 35, Scratch(spark, "t")).collect()

    def covered(k):
        return set().union(*[range(r.start, r.end) for r in found if r.doc_id == k])

    for k, (a, b) in enumerate(parts):
        assert covered(k) == set(range(40, 40 + b - a))
    assert covered(10) == set(range(110)) and covered(11) == set(range(110)) | set(range(150, 550))


def test_claims_are_held_against_the_words(spark):
    docs = _named(frame(spark, [(1, "a b c d e", "", ""), (2, "x b c d", "", ""), (3, "b c y", "", ""), (4, "q r", "", ""), (4, "q r", "", "")]))
    at = {1: [(1, 4, 7), (0, 2, 8)], 2: [(1, 4, 7)], 3: [(0, 3, 7), (0, 2, 8)], 4: [(0, 2, 9)]}
    claims = docs.distinct().select("doc_id", "text_hash").collect()
    rows = [(r.doc_id, r.text_hash, *c) for r in claims for c in at[r.doc_id]]
    made = spark.createDataFrame(rows, "doc_id long, text_hash long, start int, end int, path long")
    got = sorted((r.doc_id, r.start, r.end, r.path) for r in verified(docs, made, Scratch(spark, "t")).collect())
    assert got == [(1, 1, 4, 7), (2, 1, 4, 7), (4, 0, 2, 9)]
