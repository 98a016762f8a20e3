"""The document operators against plain versions on odd cases, and on nothing."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnql.llm.bloom import drop_some, keep_some
from tarnql.llm.common import Scratch, components, pick, range_rank, running_total
from tarnql.llm.exact_dedup import distinct_documents, exact_dedup
from tarnql.llm.line_dedup import keep_lines, line_dedup
from tarnql.llm.mixing import SCHEDULES, integral, invert, mix, mixed_documents
from tarnql.llm.ngram_join import ngram_join, one_of_each
from tarnql.llm.packing import encoder, pack, patterns
from tarnql.llm.quality import quality
from tarnql.llm.substring_dedup import compact, substring_dedup
from tarnql.llm.toxicity import clean_documents, toxic_sentences, toxicity, train

from .cases import base_stats, documents, frame, jaccard, joined, line_components, shingle_set, stripped, words

tokenizers = pytest.importorskip("public_tokenizers")
BPE = tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


def bag(rows):
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("bits", [1 << 30, 1 << 9])
def test_exact_dedup(spark, docs, bits):
    groups = defaultdict(list)
    for d in documents():
        groups[d[1] or ""].append(d[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha, spare = hashlib.sha256(text.encode()).hexdigest(), 1
        for i in sorted(ids, key=lambda i: i != keep):
            want[(i, keep, len(ids), spare == 1, sha)] += 1
            spare = 0
    assert bag(exact_dedup(docs, max_bits=bits).collect()) == want
    kept = distinct_documents(docs, max_bits=bits)
    assert kept.columns == docs.columns
    assert sorted(r[1] or "" for r in kept.collect()) == sorted(groups)


def test_substring_dedup(spark, docs):
    want = Counter((d[0], n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for d, (n, kept) in zip(documents(), stripped(documents(), 35), strict=True))
    assert bag(substring_dedup(docs).collect()) == want


def test_substring_dedup_with_short_windows_and_loops(spark):
    odd = [(1, "a b c d e f g h " * 6, "", ""), (2, "x " * 40, "", ""), (3, "a b c d e f g h i", "", ""), (4, "q " + "a b c d e f g h " * 2, "", "")]
    want = Counter((d[0], n, n - len(kept)) for d, (n, kept) in zip(odd, stripped(odd, 9), strict=True))
    assert bag(r[:3] for r in substring_dedup(frame(spark, odd), 9).collect()) == want


def test_paths_are_compacted_and_rings_end(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 200), (300, 301)], "span long, next long")
    got = {r.span: (r.path, r.place) for r in compact(links, Scratch(spark, "t")).collect()}
    assert got[7] == (1, 6) and got[40] == (8, 32) and got[301] == (300, 1) and 8 not in got


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, docs, width, percent):
    all_docs = documents()
    sets = [shingle_set(d[1], width) for d in all_docs]
    own = joined(sets, jaccard(percent))
    least = defaultdict(list)
    for d, c in zip(all_docs, own, strict=True):
        least[c].append(d[0])
    want = Counter((d[0], len(s), min((i for i in least[c] if i is not None), default=None) if s else d[0]) for d, s, c in zip(all_docs, sets, own, strict=True))
    assert bag(ngram_join(docs, width, percent).collect()) == want
    left = one_of_each(docs, width=width, percent=percent)
    assert left.columns == docs.columns
    assert Counter(r[0] for r in left.collect()) == Counter(i for i, _, c in want.elements() if i is None or i == c)


def test_ngram_join_of_a_large_family(spark):
    """Hundreds of texts, each a word or two from one another: one component, and few pairs tested."""
    base = [f"w{i}" for i in range(120)]
    many = [(k, " ".join(base[: k % 110] + [f"odd{k}"] + base[k % 110 + 1 :]), "", "") for k in range(300)]
    many += [(1000 + k, " ".join(f"u{k}n{i}" for i in range(50)), "", "") for k in range(5)]
    got = {r.doc_id: r.component_id for r in ngram_join(frame(spark, many)).collect()}
    own = joined([shingle_set(t, 3) for _, t, *_ in many], jaccard(90))
    least = {}
    for (i, *_), c in zip(many, own, strict=True):
        least.setdefault(c, i)
    assert got == {i: least[c] for (i, *_), c in zip(many, own, strict=True)}


def test_line_dedup(spark):
    some = [d for d in documents() if d[0] is None or d[0] not in (3, 4)]
    got = line_dedup(frame(spark, some))
    want = Counter()
    nulls = Counter()
    for d, kept in zip(some, line_components(some), strict=True):
        n = sum(1 for x in (d[1] or "").split("\n") if x.strip(" \t\n\x0b\x0c\r"))
        (want if d[0] is not None else nulls)[(d[0], n, n - len(kept), tuple(kept))] += 1
    rows = [(*r[:3], tuple(r[3])) for r in got.collect()]
    assert Counter(r for r in rows if r[0] is not None) == want
    assert sum(r[2] for r in rows if r[0] is None) == sum(r[2] * n for r, n in nulls.items())
    texts = {r.doc_id: r.text for r in keep_lines(frame(spark, some), got).collect()}
    line = next(i for i, t, *_ in some if t and t.startswith("Repeat this"))
    assert texts[line].count("Repeat this") == 1 and "something else here" in texts[line]


def test_quality(spark, docs):
    got = defaultdict(list)
    for r in quality(docs).collect():
        got[r.doc_id].append(r)
    for d in documents():
        stats = base_stats(d[1])
        failed = stats[0] < 10 or 100 * stats[4] > 20 * stats[0]
        found = [r for r in got[d[0]] if tuple(r[1:6]) == stats]
        assert found and all(r.base_failed == failed and (not failed or not r.kept) for r in found)


def test_quality_rejects_what_lies_far_from_its_group(spark):
    rows = [(i, " ".join(f"Word{(i * 7 + j) % 97}" for j in range(40 + i % 30)), "en", f"s{i % 2}") for i in range(200)]
    junk = [(1000 + i, " ".join(f"x{(i + j) % 89}%%%###$$$" for j in range(50)), "en", "s0") for i in range(6)]
    got = {r.doc_id: r.kept for r in quality(frame(spark, rows + junk)).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(6))


def test_mixing(spark, docs):
    rows = mix(docs.withColumn("own", F.col("source")), carry=("own",)).collect()
    assert Counter((r.doc_id, r.own, r.size) for r in rows) == Counter((d[0], d[3], len(words(d[1]))) for d in documents())
    size = Counter()
    for d in documents():
        size[d[3]] += len(words(d[1]))
    names = sorted((s for s in size if s is not None), key=str.encode) + ([None] if None in size else [])
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(names)}
    total, target = 1.5 * sum(size.values()), dict.fromkeys(names, 0.0)
    capped: set = set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            break
        capped |= set(over)
    target = {s: 2.0 * size[s] if s in capped else level * weight[s] for s in names}
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(target[r.own]) and r.source_size == size[r.own]
        assert 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0)
        taken[r.own] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    times = [r.position for r in rows if r.position is not None]
    assert times == sorted(times) and bag(mix(docs).collect()) == bag(mix(docs.repartition(5)).collect())


def test_schedules_are_inverted(spark):
    for knots in [*SCHEDULES, [(0.0, 1.0), (0.25, 5.0), (0.5, 0.0), (1.0, 2.0)]]:
        shares = [k / 50 for k in range(51)]
        df = spark.createDataFrame([(s,) for s in shares], "s double")
        for r in df.select("s", invert(F.col("s"), knots).alias("t")).collect():
            part, met = [(t, v) for t, v in knots if t <= r.t], 0.0
            after = next(((t, v) for t, v in knots if t > r.t), None)
            if after:
                (t0, v0), (t1, v1) = part[-1], after
                part.append((r.t, v0 + (v1 - v0) * (r.t - t0) / (t1 - t0)))
            met = integral(part) / integral(knots)
            assert met == pytest.approx(r.s, abs=1e-9)


def test_mixed_documents_repeat_and_order(spark, docs):
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert max(Counter((r[0], r[1]) for r in out.filter("doc_id = 5").collect()).values(), default=0) <= 2


def test_packing_is_a_round_trip(spark, docs):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(BPE)
    rows = pack(docs, BPE, keep_ids=True).collect()
    want = Counter(tuple([*made.encode(d[1] or "", add_special_tokens=False).ids, 0]) for d in documents())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_doc.values():
        runs = Counter(p.start for p in pieces)
        assert len(set(runs.values())) == 1  # repeated documents: every piece as often
    assert Counter(t for ids in want.elements() for t in ids) == Counter(t for r in rows for t in r.ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows) / (1024 * len(by_sequence)) > 0.9


def test_patterns_use_every_piece_once_with_little_left_over():
    rng = np.random.default_rng(1)
    demand = Counter(rng.integers(1, 256, 5000).tolist())
    made, used = patterns(demand, 256), Counter()
    for times, pattern in made:
        assert sum(k * n for k, n in pattern.items()) <= 256
        for k, n in pattern.items():
            used[k] += times * n
    assert used == demand and sum(n for n, _ in made) * 256 < 1.01 * sum(k * n for k, n in demand.items())
    assert patterns({}, 256) == [] and patterns({256: 3}, 256) == [(3, {256: 1})]


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    made, encode = Tokenizer.from_file(BPE), encoder(BPE)
    for text in ["", "a  b\n\n c　x\x1c y   ", "<|endoftext|> hi", "it's\t\tok\x85 z  w\xa0", "\n \n\n x\n  \ty", "don't 've 123abc!?\x0b\x0c 'S \U0001f600é", *[d[1] or "" for d in documents()]]:
        assert np.frombuffer(encode(text), "<u4").tolist() == made.encode(text, add_special_tokens=False).ids


def test_toxicity(spark):
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        insult = ["grubworm", "zapfhead", "grubling"][i % 3]
        rows.append((i, f"{' '.join(f'w{(i * 13 + j) % 211}' for j in range(20))}. You {insult if bad else 'friend'} of w{i % 50}! And w{i % 31}, w{i % 37}.", "en", "s"))
        labels.append((i, 1, int(bad)))
    rows += [(5000, "", "en", "s"), (5001, None, None, None), (None, "calm words", "en", "s"), (5002, "A nice day. You grubworm of a thing! Bye.", "en", "s")]
    docs = frame(spark, rows)
    known = spark.createDataFrame([*labels, (None, 1, 1), (77777, 0, None)], "doc_id long, quality int, toxic int")
    model = train(docs, known)
    got = {r.doc_id: r for r in toxicity(docs, model).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(900))
    assert sum(got[i].predicted == int(i % 5 == 0) for i in held) >= 0.98 * len(held)
    assert got[5000].score == got[5001].score == 0 and got[5000].worst_sentence == -1
    assert got[5002].predicted == 1 and got[5002].worst_sentence == 1
    assert [(r.doc_id, r.text) for r in toxic_sentences(docs.filter("doc_id = 5002"), model).collect()] == [(5002, "You grubworm of a thing")]
    clean = clean_documents(docs, model)
    assert clean.columns == docs.columns and {r[0] for r in clean.collect()} == {i for i, r in got.items() if not r.predicted}
    assert train(docs, known.filter("toxic = 0")) is None and toxicity(docs, None).agg(F.max("score")).first()[0] < 1e-6


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for made in (exact_dedup(none), distinct_documents(none), substring_dedup(none), ngram_join(none), one_of_each(none), line_dedup(none), quality(none), mix(none), mixed_documents(none), pack(none, BPE), toxicity(none, train(none, labels)), clean_documents(none, None)):
        assert made.collect() == []


def test_pick_takes_exact_names_first(spark):
    df = spark.createDataFrame([(1, 2, 3)], "A int, a int, b int")
    assert pick(df, "a", "B").collect() == [(2, 3)]
    with pytest.raises(ValueError, match="missing"):
        pick(df, "c")


def test_ranks_totals_and_components(spark):
    df = spark.createDataFrame([(k % 3 if k % 7 else None, k, k * 2) for k in range(100)], "g int, k long, v long")
    assert sorted((r.k, r["rank"]) for r in range_rank(df, Scratch(spark, "t"), "r", [F.desc("k")]).collect()) == [(k, 99 - k) for k in range(100)]
    seen = Counter()
    totals = {r.k: r.before for r in running_total(df, Scratch(spark, "t"), "s", "g", [F.col("k")], "v").collect()}
    for k in range(100):
        g = k % 3 if k % 7 else None
        assert totals[k] == seen[g]
        seen[g] += 2 * k
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (105, 101), (7, 7), (200, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {**dict.fromkeys([*range(61), 200], 0), 100: 100, 101: 100, 105: 100}


def test_bloom_filters_only_thin(spark):
    df = spark.range(5000).withColumn("x", F.lit("y"))
    some = spark.range(0, 5000, 50)
    kept = {r.id for r in keep_some(df, F.xxhash64("id"), some, F.xxhash64("id")).collect()}
    assert set(range(0, 5000, 50)) <= kept and len(kept) < 400
    left = drop_some(df, "id", some)
    assert left.columns == ["id", "x"] and {r.id for r in left.collect()} == set(range(5000)) - set(range(0, 5000, 50))
