"""The near-duplicate stage of the pipeline links at five words and 0.8."""

import corpus_pipeline

from .cases import frame


def test_appended_and_scattered_changes_are_near_copies(spark):
    base = [f"w{i}" for i in range(200)]
    scattered = [f"x{i}" if i in (40, 90, 140, 190) else w for i, w in enumerate(base)]
    other = [f"u{i}" for i in range(100)]
    rows = [(1, base), (2, scattered), (3, other), (4, other + [f"v{i}" for i in range(20)]), (5, other[:60] + [f"z{i}" for i in range(60)])]
    got = corpus_pipeline.ngram_join(spark, frame(spark, [(i, " ".join(w), "", "") for i, w in rows]), "")
    assert sorted(r[0] for r in got.collect()) == [1, 3, 5]
