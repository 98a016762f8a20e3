"""Jaccard self-join of documents on word n-grams by vertical partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import drop_some, keep_some, repeated_keys
from .common import Scratch, apart, components, pick
from .hashing import mix, shingles, tidy, word_hashes


_classes: dict[int, np.ndarray] = {}


def classes(percent: int) -> np.ndarray:
    """The least size of each size class. Sets link with at most the next class; each is as wide as keeps fragment names fewest."""
    if percent not in _classes:
        least, grow = [1], min(percent, 95) ** 2
        while least[-1] < 1 << 40:
            least.append(max(least[-1] + 1, -(-least[-1] * 10000 // grow)))
        _classes[percent] = np.array(least)
    return _classes[percent]


#: Sets that share a fragment are paired out if they are so many at most; larger groups are searched by rarest n-grams.
PAIRED = 16
#: Documents signed at once.
ROWS = 1000
#: Words of sketches compared at once.
LOT = 1 << 18


def _node(grams: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix(mix(grams).sum(keepdims=True) ^ np.uint64(len(grams)))[0].view(np.int64))


def fragment_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """Names of the fragments of a set (sorted hashes): linked sets share one at least.

    Sets x and y that link differ in at most h = (|x| + |y|) (100 - percent) / (100 + percent) n-grams. The global
    order of n-grams, that of their hashes, is cut into h + 2 fragments, h taken for the largest sizes of the class. A set
    takes part in its own class, and in the next if a larger partner may be there. Every fragment in which they differ holds
    one of the n-grams they differ in, so a set with more full fragments than its partners may differ from it in has a full one in common
    with each of them. Two sets that both have fewer meet by the first n-grams of either, as many as may be missing, and one.
    """
    n = len(grams)
    edges = classes(percent)
    own = int(np.searchsorted(edges, n, side="right")) - 1
    most = n * 100 // percent
    found = []
    for c in (own, own + 1):
        if c > own and most < edges[c]:
            break
        last = int(edges[c + 1]) - 1
        differ = 2 * last * (100 - percent) // (100 + percent)
        if differ == 0:
            continue  # only equal sets link, and these share a node
        pieces = differ + 2
        at = ((grams >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
        start = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        place = mix(np.array([c], np.uint64))
        found.append(mix(np.add.reduceat(mix(grams), start) ^ mix(place ^ at[start])))
        if len(start) <= (n + min(most, last)) * (100 - percent) // (100 + percent):
            found.append(mix(grams[: n + 1 - -(-percent * n // 100)] ^ mix(~place)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def sketch(grams: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of the n-grams falls into each of 64, 128, 256 ... places, as many as there are n-grams or more.

    An n-gram that only one of two sets has turns one place, so sets differ in at least as many n-grams as in places.
    """
    bits = max(64, 1 << (len(grams) - 1).bit_length())
    count = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _within(percent: int):
    """(a, b, na, nb, sketch of a, sketch of b) to the pairs (a, b) whose sketches leave room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            words = [batch.column(c).value_lengths().to_numpy() for c in (4, 5)]
            flat = [batch.column(c).flatten().to_numpy() for c in (4, 5)]
            start = [np.cumsum(w) - w for w in words]
            turned = np.zeros(len(sizes), np.int64)
            for x, y in set(zip(*map(np.ndarray.tolist, words), strict=True)):
                at = np.flatnonzero((words[0] == x) & (words[1] == y))
                least, some = min(x, y), max(1, LOT // max(x, y))
                for i in range(0, len(at), some):
                    own = at[i : i + some]
                    folded = [np.bitwise_xor.reduce(f[s[own][:, None] + np.arange(w)].reshape(len(own), w // least, least), axis=1) for f, s, w in zip(flat, start, (x, y), strict=True)]
                    turned[own] = np.bitwise_count((folded[0] ^ folded[1]).view(np.uint64)).sum(axis=1)
            near = pa.array((100 + percent) * turned <= (100 - percent) * sizes)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(near) for c in (0, 1)], ["a", "b"])

    return tidy(run)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by their sketches: none that links is left out, and few others stay."""
    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(_within(percent), "a long, b long")


def _gram_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, offsets, words in word_hashes(batch.column(1), lower=True):
        for i in range(len(offsets) - 1):
            yield first + i, shingles(words[offsets[i] : offsets[i + 1]], width)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _signed(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for at in range(0, large.num_rows, ROWS):
                batch, node, size, keys, marks = large.slice(at, ROWS), [], [], [], []
                for _, grams in _gram_sets(batch, width):
                    node.append(_node(grams) if len(grams) else None)
                    size.append(len(grams))
                    keys.append(fragment_keys(grams, percent).view(np.int64) if len(grams) else np.zeros(0, np.int64))
                    marks.append(sketch(grams) if len(grams) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(node, pa.int64()), pa.array(size, pa.int64()), _lists(keys), _lists(marks), *batch.columns[2:]],
                    ["doc_id", "node", "n", "keys", "sketch", *batch.schema.names[2:]],
                )

    return tidy(run)


def _fragments(width: int, parts: int):
    """The sets themselves, a row for each of ``parts`` fragments of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []

        def made() -> pa.RecordBatch:
            node, n, f, grams = zip(*rows, strict=True)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(f, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], ["node", "n", "fragment", "grams"])

        for batch in batches:
            for _, grams in _gram_sets(batch, width):
                if len(grams):
                    name, at = _node(grams), ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                    rows += [(name, len(grams), f, grams[at == f].view(np.int64)) for f in range(parts)]
                if len(rows) > 2000:
                    yield made()
        if rows:
            yield made()

    return tidy(run)


def _overlaps(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(a, b, na, nb, same, apart): what the pairs have in common in the given fragments, and how many n-grams only one of them has."""
    left = fragments.select(F.col("node").alias("a"), F.col("n").alias("na"), "fragment", F.col("grams").alias("ga"))
    right = fragments.select(F.col("node").alias("b"), F.col("n").alias("nb"), "fragment", F.col("grams").alias("gb"))
    both = pairs.join(left, "a").join(right, ["b", "fragment"])
    part = both.select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("ga", "gb")).alias("same"), (F.size("ga") + F.size("gb")).alias("sum"))
    once = part.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("same").alias("same"), F.max("sum").alias("sum"))  # a row read twice counts once
    return once.groupBy("a", "b", "na", "nb").agg(F.sum("same").alias("same"), F.sum(F.col("sum") - 2 * F.col("same")).alias("apart"))


def _linked(pairs: DataFrame, fragments: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) that link: overlaps are counted fragment by fragment and summed per pair.

    Linked sets differ in few n-grams, so most other pairs differ in too many within the first fragment already; only
    pairs that do not are counted in the rest.
    """
    room = (100 + percent) * F.col("apart") <= (100 - percent) * (F.col("na") + F.col("nb"))
    first = scratch.save(_overlaps(pairs, fragments.filter("fragment = 0")).filter(room), f"{name}-open")
    rest = _overlaps(first.select("a", "b"), keep_some(fragments.filter("fragment > 0"), F.col("node"), _ends(first), F.col("node")))
    total = first.union(rest).groupBy("a", "b", "na", "nb").agg(F.sum("same").alias("same"))
    return total.filter(100 * F.col("same") >= percent * (F.col("na") + F.col("nb") - F.col("same"))).select("a", "b")


def _rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets in different components that may link, by their rarest n-grams.

    Among the sets given, n-grams are ordered from rare to common. Linked sets share an n-gram of the first
    n - ceil(percent n / 100) + 1 of each, and from the first that they share on, enough must follow in both.
    N-grams that occur once only take up places.
    """
    rows = sets.select("node", "n", "component", F.explode("grams").alias("gram"))
    often = rows.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    shared = rows.join(often, "gram")
    whole = Window.partitionBy("node")
    placed = shared.withColumn("place", F.col("n") - F.count("*").over(whole) + F.row_number().over(whole.orderBy("df", "gram")) - 1)
    index = placed.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select("gram", "node", "n", "component", "place")
    a = index.select("gram", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("place").alias("pa"))
    b = index.select("gram", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("place").alias("pb"))
    enough = (100 + percent) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= percent * (F.col("na") + F.col("nb"))
    return a.join(b, "gram").filter((F.col("ca") < F.col("cb")) & enough).select("a", "b").distinct()


def _row():
    """A 64-bit name of doc_id and text."""
    return F.xxhash64("doc_id", "text")


def ngram_join(docs: DataFrame, width: int = 3, percent: int = 90, parts: int = 4, carry_row: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A set is the distinct ``width``-word shingles of the text with A-Z lower-cased; of fewer words the whole
    sequence; of none (or null) empty, linked with nothing. Documents link when 100 * intersection >=
    ``percent`` * union; component_id is the smallest doc_id that links reach, and the document's own for an
    empty set. Null doc_ids are ignored in that minimum. Repeated rows link as any equal sets do.

    1. Equal sets become one node. 2. Nodes that share a fragment name (see ``fragment_keys``) are candidates:
    each is tested against the most central node it meets, the one that shares most with others, which joins most of a
    group of near copies without pairing its members. Sketches (see ``sketch``) rule out most candidates, and sets are cut only for the
    rest. 3. Only where a fragment's nodes then still lie in several components, the rest is
    searched by rarest n-grams, across components only. Pairs within a component need no test. No pair that
    links is missed, and no group is capped. N-grams are 64-bit hashes; sets are named by 64 bits. ``carry_row`` adds
    ``row``, the name of doc_id and text together.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    wide = pick(docs, "doc_id", "text").withColumn("row", _row())
    signed = scratch.save(wide.mapInArrow(_signed(width, percent), "doc_id long, node long, n long, keys array<long>, sketch array<long>, row long"), "signed")
    named = scratch.save(repeated_keys(signed.select("keys", "node", "n")), "named")
    rows = scratch.save(signed.drop("keys"), "rows")
    scratch.drop("signed")  # the keys are most of it
    repeated = named.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("key")
    held = scratch.save(named.join(repeated, "key").distinct(), "held")
    scratch.drop("named")
    nodes = scratch.save(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row")), "nodes")
    central = scratch.save(held.join(held.groupBy("key").agg(F.count("*").alias("size")), "key").groupBy("node").agg(F.sum("size").alias("weight")), "central")
    sketches = scratch.save(rows.join(central, "node", "left_semi").select("node", "n", "sketch").dropDuplicates(["node"]), "sketches")

    def cut(some: DataFrame, name: str) -> DataFrame:
        """The fragments of some nodes, and of few others."""
        need = scratch.save(nodes.join(some, "node", "left_semi").select("row"), f"{name}-need")
        made = keep_some(wide, F.col("row"), need, F.col("row")).select("doc_id", "text").mapInArrow(_fragments(width, parts), "node long, n long, fragment int, grams array<long>")
        return scratch.save(made, name, by="fragment")

    near = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    centre = held.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("centre"))
    met = held.join(scratch.save(centre, "centre"), "key").withColumn("m", F.col("centre.n")).filter(near)
    best = met.groupBy("node").agg(F.max("centre")["node"].alias("centre"))
    stars = best.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    stars = scratch.save(_close(stars, sketches, percent), "stars")
    fragments = cut(_ends(stars), "fragments")
    first = scratch.save(_linked(stars, fragments, percent, scratch, "stars"), "first")
    scratch.drop("fragments")
    joined = scratch.save(components(first, scratch, "one"), "joined")
    placed = held.join(joined, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    placed = scratch.save(placed, "placed")
    scratch.drop("held", "central", "centre")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).filter("x < y")
    mixed = scratch.save(mixed.select("key", "size"), "mixed")
    some = placed.join(mixed.filter(F.col("size") <= PAIRED).select("key"), "key")
    other = some.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"))
    small = some.join(other, "key").filter((F.col("component") < F.col("other")) & near).select(F.col("node").alias("a"), "b")
    small = scratch.save(_close(small.distinct(), sketches, percent), "small")
    active = placed.join(mixed.filter(F.col("size") > PAIRED).select("key"), "key", "left_semi").select("node", "component").distinct()
    active = scratch.save(active, "active")
    scratch.drop("placed", "mixed")
    fragments = cut(_ends(small).union(active.select("node")), "more")
    sets = keep_some(fragments, F.col("node"), active, F.col("node")).join(active, "node").dropDuplicates(["node", "fragment"])
    large = _close(_rare_pairs(scratch.save(sets, "sets"), percent), sketches, percent)
    pairs = scratch.save(small.union(large).distinct(), "pairs")
    scratch.drop("sets", "small", "active")
    second = _linked(pairs, fragments, percent, scratch, "pairs")
    final = scratch.save(components(first.union(second), scratch, "two"), "final")

    labelled = nodes.join(final, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    known = scratch.save(labelled.join(ids, "component").select("node", "component_id"), "known")
    scratch.drop("nodes", "sketches", "stars", "fragments-need", "more-need", "more", "first", "joined", "pairs", "final", "stars-open", "pairs-open")
    return rows.join(known, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *["row"] * carry_row
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents whose doc_id is the least of their component, with the columns of ``docs``. A null doc_id stays.

    Rows are judged one by one: of two texts with the same doc_id one may go and the other stay.
    """
    scratch = Scratch(docs.sparkSession, "one")
    copies = ngram_join(docs, carry_row=True, **options).filter("doc_id <> component_id").select("row").distinct()
    docs, back = apart(docs, "doc_id", "text")
    return back(drop_some(docs.withColumn("row", _row()), "row", scratch.save(copies, "copies")))
