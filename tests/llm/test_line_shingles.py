"""Alike lines against a brute force on true character shingles."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import tarnql.llm.line_dedup as line_dedup_module
from tarnql.llm.line_dedup import TALLIES, _met, _rarest, _signed, line_dedup

from .cases import frame, jaccard, joined, prose


def character_shingles(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} if len(line) >= 5 else {line}


def family(rng, line, copies):
    """A line and copies with a few characters changed, put in or left out at scattered places."""
    yield line
    for _ in range(copies):
        s = list(line)
        for _ in range(max(1, len(s) // rng.choice([30, 45, 60, 90]))):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é", "\U0001f600"])
        yield "".join(s).strip()


def test_short_edits_link_lines(spark):
    """One word of ten is another: most character shingles stay, though few runs of three words do."""
    rng = random.Random(5)
    lines = [x for k in range(60) for x in family(rng, prose(rng, 3 + 3 * (k % 20)), 4)]
    lines += ["abcd", "abcd", "abce", "a", "the wind came over the northern hills in the evening", "the wind came over the northern hills on the evening"]
    lines = list(dict.fromkeys(x for x in lines if x))
    own = joined([character_shingles(x) for x in lines], jaccard(80))
    want, seen = {}, set()
    for i, c in enumerate(own):
        want[i] = 0 if c in seen else 1
        seen.add(c)
    assert len(seen) < len(lines) - 60
    got = {r.doc_id: len(r.kept_lines) for r in line_dedup(frame(spark, [(i, x, "", "") for i, x in enumerate(lines)])).collect()}
    assert got == want


def signed(lines):
    """(size, bands, bits) of each line."""
    order = pa.array(range(len(lines)))
    rows = [r for b in _signed(iter([pa.RecordBatch.from_arrays([order, order, pa.array(lines)], ["doc_id", "uid", "text"])])) for r in b.to_pylist()]
    made = {r["node"]: (r["n"], set(r["keys"]), (r["x"] % 2**64) << 64 | r["y"] % 2**64) for r in rows if r["n"]}
    return [made[r["node"]] for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_signatures_meet_at_the_threshold():
    """Of the pairs at 0.8 or a little more, found by brute force on characters, hardly any shares no band or differs in too many bits."""
    rng = random.Random(6)
    lines = [x or "empty" for k in range(900) for x in family(rng, prose(rng, 3 + 2 * (k % 45)), 6)]
    sets, made = [character_shingles(x) for x in lines], signed(lines)
    assert [n for n, _, _ in made] == [len(s) for s in sets]
    near = [(i, j) for k in range(0, len(lines), 7) for i in range(k, k + 7) for j in range(k, i) if 80 * len(sets[i] | sets[j]) <= 100 * len(sets[i] & sets[j]) <= 86 * len(sets[i] | sets[j])]
    apart = [len(sets[i] ^ sets[j]) for i, j in near]
    missed = [p for p, d in zip(near, apart, strict=True) if not made[p[0]][1] & made[p[1]][1] or (made[p[0]][2] ^ made[p[1]][2]).bit_count() > min(0.5 * d + 2.5 * d**0.5, 29)]
    assert len(near) > 1500 and 500 * len(missed) <= len(near)


def test_ends_of_long_words_and_spaceless_lines_count(spark):
    """Lines that begin alike and end otherwise stay, whatever their script."""
    docs = [
        (1, "see also: https://example.org/cats/and/dogs\nThe parcel arrives tomorrow\n\u7b2c\u4e00 \u7ae0 \u5929\u5730\u7384\u9ec4\u5b87\u5b99\u6d2a\u8352\u65e5\u6708\u76c8\u6603", "", ""),
        (2, "see also: https://weather.test/2024/storm-report\nThe parcel arrives tomohawk\n\u7b2c\u4e00 \u7ae0 \u5bd2\u6765\u6691\u5f80\u79cb\u6536\u51ac\u85cf\u95f0\u4f59\u6210\u5c81", "", ""),
    ]
    assert {r.doc_id: r.n_removed for r in line_dedup(frame(spark, docs)).collect()} == {1: 0, 2: 0}


def test_a_large_family_is_one_component(spark):
    """More lines in a band than are paired out, in chains whose ends are not alike, beside lines that share their beginning only."""
    rng = random.Random(8)
    base = prose(rng, 200)
    chain = [base[: len(base) - 3 * k] for k in range(300)]
    other = [base[:60] + prose(rng, 40) for _ in range(300)]
    lines = list(dict.fromkeys(x.strip() for x in chain + other))
    own = joined([character_shingles(x) for x in lines], jaccard(80))
    got = sum(len(r.kept_lines) for r in line_dedup(frame(spark, [(i, x, "", "") for i, x in enumerate(lines)])).collect())
    assert got == len(set(own))


def test_lines_alike_share_one_of_their_rarest_shingles():
    """Whatever the counters hold, and of each line a fifth and one at most leave it."""
    rng = random.Random(11)
    lines = [x or "empty" for k in range(200) for x in family(rng, prose(rng, 2 + 2 * (k % 30)), 4)]
    sets = [character_shingles(x) for x in lines]
    node, zero = pa.array(range(len(lines))), pa.array([0] * len(lines))

    class Shared:
        value = np.random.default_rng(11).integers(0, 4, TALLIES).astype("<u2").tobytes()

    batch = pa.RecordBatch.from_arrays([node, node, zero, zero, zero, pa.array([x.encode() for x in lines])], ["node", "component", "n", "x", "y", "line"])
    made = {r["node"]: r["grams"] for b in _rarest(Shared, 80)(iter([batch.slice(0, 7), batch.slice(7)])) for r in b.to_pylist()}
    assert [len(made[i]) for i in range(len(lines))] == [len(s) - -(-80 * len(s) // 100) + 1 for s in sets]
    near = [(i, j) for k in range(0, len(lines), 5) for i in range(k, k + 5) for j in range(k, i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(near) > 500 and all(set(made[i]) & set(made[j]) for i, j in near)


def shuffled(spark, after=-1):
    """The last stage, and the records that stages after the given one have written for shuffles."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    stages = [stages.apply(i) for i in range(stages.size())]
    return max((s.stageId() for s in stages), default=-1), sum(s.shuffleWriteRecords() for s in stages if s.stageId() > after)


def test_a_crowded_band_moves_few_of_its_lines_shingles(spark):
    """Lines of one form, each with words of its own, share bands without being alike; a copy among them with one letter changed is found."""
    rng = random.Random(12)
    form = prose(rng, 50)[:300]
    lines = [form + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(110)) for _ in range(1500)]
    lines.append(lines[7][:-1] + "#")
    before, _ = shuffled(spark)
    got = line_dedup(frame(spark, [(i, x, "", "") for i, x in enumerate(lines)])).filter(F.col("n_removed") > 0).collect()
    assert [r.doc_id for r in got] == [1500]
    assert shuffled(spark, before)[1] < sum(len(x) - 4 for x in lines)


def test_no_band_is_narrow():
    """Lines of a hundred letters at random, so without a shingle in common, share no band; one of two bins would often be a single hash."""
    rng = random.Random(13)
    lines = [prose(rng, 40)[:90] + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(2000)]
    sets, made = [character_shingles(x) for x in lines], signed(lines)
    holders = {}
    for i, (_, keys, _) in enumerate(made):
        for key in keys:
            holders.setdefault(key, []).append(i)
    apart = sum(1 for own in holders.values() for k, i in enumerate(own) for j in own[:k] if 3 * len(sets[i] & sets[j]) < len(sets[i] | sets[j]))
    assert apart < 300


def test_only_lines_that_may_be_alike_leave_a_band():
    """Held against all pairs, whatever the batches; of a band with too many lines all stay."""
    rng, random_bits = np.random.default_rng(14), np.random.default_rng(15)
    rows = []
    for key in range(300):
        size = int(rng.choice([1, 2, 3, 9, 40, 130]))
        base = random_bits.integers(0, 1 << 63, (3, 2))
        for _ in range(size):
            x, y = base[rng.integers(3)]
            flips = rng.integers(0, 63, rng.integers(0, 40))
            rows.append((key, len(rows), int(rng.integers(100, 400)), int(x ^ np.bitwise_xor.reduce(1 << flips, initial=0)), int(y)))
    rows.sort(key=lambda r: (r[0], r[2]))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "node", "n", "x", "y"])
    want = {}
    for key in range(300):
        own = [r for r in rows if r[0] == key]
        for a in own:
            met = sum(
                100 * min(a[2], b[2]) >= 80 * max(a[2], b[2]) and (a[3] ^ b[3]).bit_count() + (a[4] ^ b[4]).bit_count() <= min((a[2] + b[2]) / 18 + 2.5 * ((a[2] + b[2]) / 9) ** 0.5, 12.8 + 5 * 11.52**0.5)
                for b in own
                if b is not a
            )
            if met or len(own) > 100:
                want[a[1]] = 100 if len(own) > 100 else met
    for width, lot in ((len(rows), 1 << 16), (37, 150), (1, 101)):
        line_dedup_module.LOT, before = lot, line_dedup_module.LOT
        try:
            batches = [batch.slice(i, width) for i in range(0, len(rows), width)]
            got = {r["node"]: r["met"] for b in _met(80, 100)(iter(batches)) for r in b.to_pylist()}
        finally:
            line_dedup_module.LOT = before
        assert got == want


def test_lines_without_a_like_move_once(spark):
    """Of lines that share bands only, little is shuffled; and rounds, more of them than columns too, and crowded bands give the same rows."""
    rng = random.Random(16)
    form = prose(rng, 50)[:300]
    lines = [form + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(110)) for _ in range(1500)]
    lines += [x[:-1] + "#" for x in lines[:50]] + [x for k in range(40) for x in family(rng, prose(rng, 3 + 3 * (k % 20)), 4) if x]
    docs = frame(spark, [(i, x, "", "") for i, x in enumerate(lines)])
    before, _ = shuffled(spark)
    want = sorted(map(tuple, line_dedup(docs).select("doc_id", "n_lines", "n_removed").collect()))
    assert sum(r[2] for r in want) > 90
    assert shuffled(spark, before)[1] < 260_000
    kept = {name: getattr(line_dedup_module, name) for name in ("SHARES", "KEYS", "DEALT", "ROUND", "COMPARED", "PAIRED")}
    try:
        few = {"SHARES": 2, "KEYS": kept["KEYS"][:2], "DEALT": kept["DEALT"].split(", keys2")[0], "ROUND": 12_000}
        for change in (few, {"COMPARED": 20, "PAIRED": 10}):
            for name, value in (kept | change).items():
                setattr(line_dedup_module, name, value)
            assert sorted(map(tuple, line_dedup(docs).select("doc_id", "n_lines", "n_removed").collect())) == want
    finally:
        for name, value in kept.items():
            setattr(line_dedup_module, name, value)
