"""Small documents with every odd case, and plain versions of what the operators do."""

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `TEXT` int, extra array<string>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    out = []
    for _ in range(n):
        w = "".join(rng.choice("aeiouéü") + rng.choice("bdlmnrst") for _ in range(rng.randint(1, 4)))
        out.append(w + rng.choice(["", "", "", ",", "."]))
    return " ".join(out)


def documents():
    """(doc_id, text, lang, source): unique, copied, near-copied, repeated within, short, long, blank and null."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(40, 160)) for _ in range(12)]
    passage = prose(rng, 60)
    texts = list(base)
    texts += [base[0], base[0], base[1]]
    for k in range(9):  # near copies of one text, a word or more changed
        w = base[2].split(" ")
        for j in range(k // 2 + 1):
            w[(17 * k + 29 * j) % len(w)] = f"changed{k}x{j}"
        texts.append(" ".join(w))
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 25)}" for _ in range(4)]
    texts.append(f"{passage}\n{prose(rng, 9)}\n{passage}")
    texts += ["one", "two words", "two words", "Three small Words", "three Small words", "", "   \t\n", None, None, "x\x0by\x0cz\rq", "￿ \U0001f600 é \x85 \xa0 w"]
    texts.append("Repeat this line.\nRepeat this line.\nsomething else here\nRepeat this line!")
    texts.append(" ".join(["again"] * 120))
    texts.append(prose(rng, 30_000))
    texts.append("### $$$ " * 30 + prose(rng, 20))
    docs = [(i, t, "abc"[i % 3] if i % 7 else None, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    docs += [docs[3], docs[3], (4, base[5], "a", "s1"), (None, base[6], None, None), (None, "two words", "a", None), (None, None, None, None)]
    return docs


def frame(spark, docs=None):
    docs = documents() if docs is None else docs
    rows = [(i, t, lang, source, len(t or ""), 7, None) for i, t, lang, source in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def joined(sets, linked):
    """Component numbers of a list by a test on pairs."""
    own = list(range(len(sets)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                own[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def jaccard(percent):
    return lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def shingle_set(text, width):
    w = words(lower(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def stripped(docs, window):
    """(n_words, kept words) of each document."""
    count = Counter(tuple(w[i : i + window]) for _, t, *_ in docs for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for _, t, *_ in docs:
        w = words(t)
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        out.append((len(w), [x for x, k in zip(w, keep, strict=True) if k]))
    return out


def base_stats(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, hit = Counter(grams), [False] * len(w)
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit[i : i + 5] = [True] * 5
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(hit)


def line_components(docs):
    """For each document (in order) the numbers of the lines that stay, by exact Jaccard of the same shingles."""
    found = defaultdict(list)
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0))
    for k in order:
        for i, line in enumerate((docs[k][1] or "").split("\n")):
            if line := line.strip(" \t\n\x0b\x0c\r"):
                found[line].append((k, i))
    lines = list(found)
    sets = [{line[i : i + 5] for i in range(max(1, len(line) - 4))} for line in lines]
    own = joined(sets, jaccard(80))
    rank = {k: n for n, k in enumerate(order)}
    best = {}
    for line, c in zip(lines, own, strict=True):
        least = min(found[line], key=lambda p: (rank[p[0]], p[1]))
        best[c] = min(best.get(c, least), least, key=lambda p: (rank[p[0]], p[1]))
    kept = defaultdict(list)
    for k, i in best.values():
        kept[k].append(i)
    return [sorted(kept[k]) for k in range(len(docs))]
