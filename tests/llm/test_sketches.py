"""Sketches rule out pairs of sets before the sets are cut and moved, and never one that links."""

import random

import numpy as np
import pyarrow as pa

from tarnql.llm import ngram_join as op
from tarnql.llm.hashing import mix

from .cases import frame


def test_no_linked_pair_is_ruled_out_and_few_others_stay():
    rng = random.Random(9)
    rows, linked = [], []
    for k in range(1500):
        n, keep = rng.choice([1, 2, 5, 9, 30, 63, 64, 65, 130, 700, 1025]), rng.choice([0.0, 0.5, 0.7, 0.85, 0.89, 0.9, 0.95, 1.0])
        x = mix(np.arange(3000 * k, 3000 * k + n, dtype=np.uint64))
        shared = x[: max(1, round(keep * n))]
        y = np.concatenate([shared, mix(np.arange(3000 * k + n, 3000 * k + n + rng.randint(0, n - len(shared)), dtype=np.uint64))])
        rows.append((2 * k, 2 * k + 1, len(x), len(y), op.sketch(np.sort(x)), op.sketch(np.sort(y))))
        linked.append(100 * len(shared) >= 80 * (len(x) + len(y) - len(shared)))
    batch = pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:4]], *[op._lists(list(c)) for c in list(zip(*rows, strict=True))[4:]]], ["a", "b", "na", "nb", "sa", "sb"])
    stay = {a for b in op._within(80)(iter([batch.slice(0, 7), batch.slice(7)])) for a in b["a"].to_pylist()}
    assert len({len(s) for r in rows for s in r[4:]}) > 4 and 300 < sum(linked) < 1200
    assert all(a in stay for (a, *_), is_linked in zip(rows, linked, strict=True) if is_linked)
    assert len(stay) < 1.4 * sum(linked)


def test_sets_that_only_share_a_phrase_are_not_cut(spark, monkeypatch):
    """They meet by the fragment that the phrase fills, but are no near copies; a near copy among them still links."""
    rng = random.Random(10)
    text = lambda: "by the same phrase as all of them " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))
    rows = [(i, text(), "", "") for i in range(200)]
    near = " ".join(f"z{rng.randrange(10**6)}" for _ in range(80))
    rows += [(900, near, "", ""), (901, f"{near} and", "", "")]
    cut, save = [], op.Scratch.save
    monkeypatch.setattr(op.Scratch, "save", lambda self, df, name, by=None: [made := save(self, df, name, by), cut.append(made.select("node").distinct().count()) if by else None][0])
    got = {r.doc_id: r.component_id for r in op.ngram_join(frame(spark, rows), width=5, percent=80).collect()}
    assert got == {i: i for i, *_ in rows} | {901: 900}
    assert cut and cut[0] < 20
