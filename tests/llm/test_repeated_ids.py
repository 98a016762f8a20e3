"""Rows that share a doc_id are dropped for their own text only."""

from tarnql.llm.ngram_join import one_of_each

from .cases import frame


def test_a_unique_text_stays_beside_a_near_copy_of_the_same_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "", ""), (2, text + " more", "", ""), (2, " ".join(f"u{i}" for i in range(40)), "", ""), (2, None, "", ""), (None, text, "", "")]
    left = one_of_each(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert sorted((r[0] or 0, r[1] or "") for r in left.collect()) == sorted([(0, text), (1, text), (2, rows[2][1]), (2, "")])
