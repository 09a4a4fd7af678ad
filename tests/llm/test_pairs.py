"""Substring deduplication and the Jaccard join against brute force."""

import random

import brute
import pytest

from ladderwork.llm import jaccard
from ladderwork.llm.graph import connected_components
from ladderwork.llm.jaccard import Threshold, distinct_documents, jaccard_components, keys_of, rarest, shingle_sets
from ladderwork.llm.substrings import deduplicated, deduplicated_digest, pack, unpack


def texts(seed=3, n=260):
    """Prose with exact and near copies, shared passages, short, empty and null texts."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "Ba ke lo mi Nu ra Sé to".split() for b in "da fe gi ho ju ká".split()]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, out = prose(60), []
    for k in range(n):
        kind = k % 8
        if kind < 2 or not out:
            w = prose(rng.choice([3, 6, 9, 20, 60, 200, 500]))
        elif kind == 2:
            w = list(rng.choice(out))
        elif kind < 6:
            w = list(rng.choice(out))
            for _ in range(rng.choice([1, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind == 6:
            w = prose(20) + passage + prose(30)
        else:
            w = prose(rng.randrange(5))
        out.append(w)
    rows = [(k, rng.choice([" ", "\n", "  "]).join(w)) for k, w in enumerate(out)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, "Ünï"), (n + 4, "word " * 3000), (n + 5, "word " * 3000)]


@pytest.fixture(scope="module")
def rows():
    return texts()


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, block string, sid int").repartition(parts)


def test_substrings(spark, rows):
    got = sorted(tuple(r) for r in deduplicated_digest(frame(spark, rows)).collect())
    assert got == sorted(brute.substrings(rows))


def test_substrings_general(spark, rows):
    got = {r.doc_id: r for r in deduplicated(frame(spark, rows), size=7).collect()}
    for doc, n_words, n_removed, digest in brute.substrings(rows, 7):
        assert (got[doc].n_words, got[doc].n_removed, brute.sha(got[doc].kept)) == (n_words, n_removed, digest)


def test_substrings_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{k}" for k in range(40))
    twice = deduplicated_digest(frame(spark, [(1, text), (1, text), (2, "a")])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in twice) == [(1, 40), (1, 40), (2, 0)]
    assert deduplicated_digest(frame(spark, [])).count() == 0


def test_substrings_with_rows_in_another_order_in_each_pass(spark, rows):
    def shuffled(batches):
        import os

        for batch in batches:
            order = list(range(batch.num_rows))
            random.Random(os.urandom(8)).shuffle(order)
            yield batch.take(order)

    docs = frame(spark, rows + rows[:40], 1).select("doc_id", "text")
    docs = docs.mapInArrow(shuffled, docs.schema)
    spark.conf.set("spark.sql.exchange.reuse", "false")  # each pass deals the texts anew
    try:
        got = sorted(tuple(r) for r in deduplicated_digest(docs).collect())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == sorted(brute.substrings(rows + rows[:40]))


def test_packing():
    import numpy as np

    for values in ([], [0], [5, 6, 2**63], list(range(0, 100000, 7))):
        assert unpack(pack(np.array(values, np.uint64))).tolist() == values


def test_jaccard(spark, rows):
    got = sorted(tuple(r) for r in jaccard_components(frame(spark, rows)).collect())
    assert got == sorted(brute.components(rows))


def test_jaccard_with_spread_components(spark, rows):
    got = sorted(tuple(r) for r in jaccard_components(frame(spark, rows), size=5, num=80, local=600).collect())
    assert got == sorted(brute.components(rows, 5, 80))


def test_jaccard_by_prefixes(spark, rows):
    got = sorted(tuple(r) for r in jaccard_components(frame(spark, rows), prefixes=True).collect())
    assert got == sorted(brute.components(rows))
    got = sorted(tuple(r) for r in jaccard_components(frame(spark, rows), size=5, num=80, local=600, prefixes=True).collect())
    assert got == sorted(brute.components(rows, 5, 80))


def test_a_row_repeated_very_often(spark):
    """More copies of one row than half a block holds."""
    text = " ".join(f"much{k}" for k in range(60))
    near, short = text.replace("much59", "other"), "a short text"
    rows = [(1, text)] * 9000 + [(2, near), (3, "much0 much1 " * 3), (4, short), (4, short)]
    docs = frame(spark, rows)
    got = sorted(tuple(r) for r in deduplicated_digest(docs).collect())
    empty = brute.sha("")
    assert got == [(1, 60, 60, empty)] * 9000 + sorted(brute.substrings([(1, text), (1, text), *rows[9000:]]))[2:]
    assert {tuple(r) for r in jaccard_components(docs, 5, 80, prefixes=True).collect()} == {(1, 56, 1), (2, 56, 1), (3, 2, 3), (4, 1, 4)}
    kept = distinct_documents(docs).groupBy("doc_id").count().collect()
    assert sorted(tuple(r) for r in kept) == [(1, 9000), (3, 1), (4, 2)]


@pytest.mark.parametrize("prefixes", [False, True])
def test_sets_meet_once_however_often_a_row_repeats(spark, monkeypatch, prefixes):
    text = " ".join(f"much{k}" for k in range(60))
    rows = [(1, text)] * 5000 + [(2, text.replace("much59", "other")), (1, "another text of the same id, which links with nothing"), (None, text)]
    met, links = [], jaccard._local_links
    monkeypatch.setattr(jaccard, "_local_links", lambda members, *rest: met.append(members.count()) or links(members, *rest))
    got = sorted(jaccard_components(frame(spark, rows), 5, 80, prefixes=prefixes).collect(), key=str)
    assert sum(met) == 2 and len(got) == 5003
    assert {tuple(r) for r in got} == {(1, 56, 1), (2, 56, 1), (1, 6, 1), (None, 56, 1)}


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    text, other = " ".join(f"a{k}" for k in range(60)), "quite another text that nothing else is like"
    rows = [(1, text), (2, text + " x"), (2, other), (2, other), (3, None), (3, text), (4, other + "!"), (None, text)]
    kept = distinct_documents(frame(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, text), (2, other), (2, other), (3, None), (4, other + "!"), (None, text)], key=str)
    assert kept.columns == ["doc_id", "text", "block", "sid"]


def test_jaccard_edge_cases(spark):
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(5, long), (5, long), (3, long + " x"), (7, None), (8, ""), (9, "one two"), (2, "ONE  two"), (None, long), (11, "one two three")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows)).collect()}
    assert got == {(5, 47, 3), (3, 48, 3), (7, 0, 7), (8, 0, 8), (9, 1, 2), (2, 1, 2), (None, 47, 3), (11, 1, 11)}
    assert jaccard_components(frame(spark, [])).count() == 0
    kept = distinct_documents(frame(spark, rows))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 3, 7, 8, 11]
    assert kept.columns == ["doc_id", "text", "block", "sid"]


def test_linked_sets_share_a_key():
    import numpy as np

    rng = np.random.default_rng(1)
    for num in (80, 85):
        threshold = Threshold(num, 100)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            own = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            other, n = own, len(own)
            while rng.random() < 0.97:  # drop as many, and replace as many, as the threshold allows
                less = other[:-1] if rng.random() < 0.5 else np.append(other[:-1], rng.integers(0, 2**63, 1).astype(np.uint64))
                shared = len(np.intersect1d(own, less))
                if not shared or 100 * shared < num * (n + len(less) - shared):
                    break
                other = np.unique(less)
            common = rng.integers(0, 2**63, 1).astype(np.uint64)[0] % np.uint64(4)  # any choice of frequent shingles
            one, two = (keys_of(x, x % np.uint64(4) <= common, threshold, n % 3) for x in (own, other))
            assert np.intersect1d(one, two).size
            counts = [(x % np.uint64(7)).astype(int) for x in (own, other)]  # any order
            assert np.intersect1d(rarest(own, counts[0], threshold), rarest(other, counts[1], threshold)).size


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 102: 100, 200: 200}


def test_short_texts_are_one_shingle():
    from ladderwork.llm.words import utf8
    import pyarrow as pa

    a, b, c = shingle_sets(*utf8(pa.array(["x y", "X  y", "x y z w"])), 4)
    assert a.tolist() == b.tolist() and len(a) == len(c) == 1 and a[0] != c[0]
