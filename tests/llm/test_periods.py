"""Periodic runs against a plain search over all periods."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from brute import SPACED, sha

from ladderwork.llm import periods
from ladderwork.llm.periods import SquareCatchers, periodic_runs, run_digest
from ladderwork.llm.words import mix


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def repeating(rng, most):
    w, kinds = [], rng.choice([1, 2, 3, 40])
    while len(w) < most:
        part = [rng.randrange(kinds) for _ in range(rng.randint(1, 14))]
        w += part * rng.choice([1, 1, 2, 4, 5, 9])
    return w[: rng.randint(0, most)]


@pytest.mark.parametrize("pieces", ["whole", "words", "mixed"])
def test_catchers(pieces):
    rng = random.Random(5)
    for _ in range(700):
        w = repeating(rng, 130)
        codes, catchers, k = mix(np.array(w, dtype=np.uint64) + np.uint64(9)), SquareCatchers(), 0
        while k < len(codes):
            step = {"whole": len(codes), "words": 1, "mixed": rng.randint(1, 30)}[pieces]
            catchers.append(codes[k : k + step])
            k += step
        assert [tuple(r) for r in catchers.runs().tolist()] == plain_runs(w)


def test_long_repetition_in_small_pieces(monkeypatch):
    codes = mix(np.tile(np.arange(777, dtype=np.uint64), 60)[:40_000])
    codes[20_000] += np.uint64(1)
    catchers = SquareCatchers()
    for k in range(0, len(codes), 1000):
        catchers.append(codes[k : k + 1000])
    assert catchers.runs().tolist() == [[0, 20_000, 777], [20_001, 19_999, 777]]


def plain_digest(doc, text):
    w = SPACED.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs, gone = plain_runs(w), set()
    for s, size, q in runs:
        gone.update(range(s + q, s + size))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)), n)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_query_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wanted = [plain_digest(r.doc_id, r.text) for r in docs.collect()]
    assert any(r[1] for r in wanted)
    assert rows_of(run_digest(docs)) == sorted(map(repr, wanted))


@pytest.mark.parametrize("size", [1 << 20, 200])
def test_awkward_rows(spark, monkeypatch, size):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns, in large and small chunks."""
    monkeypatch.setattr(periods.chunks, "__defaults__", (size,))
    rng, tenth = random.Random(8), [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(None, "a a a a a a"), (1, None), (2, ""), (3, " \n\t "), (4, "a b " * 3 + "x " + "c d " * 4 + "y " + "e f " * 4), (4, "a b " * 3), (5, "one"), (6, "q " * 5), (7, "q " * 6), (8, "é ü " * 5000)]
    rows += [(k, " ".join(map(str, repeating(rng, 90)))) for k in range(60)] + [(k, " ".join(map(str, range(rng.randint(1, 60))))) for k in tenth] + rows[:9]
    docs = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, runs string, n_runs int").repartition(3)
    # Words of the edited documents are all different, so their runs are the edit's own.
    assert rows_of(run_digest(docs)) == sorted(repr(plain_digest(d, t)) for d, t in rows)
    assert run_digest(docs.limit(0)).count() == 0


def test_real_output(spark):
    docs = spark.createDataFrame([(1, "so so so so so so it goes on and on")], "doc_id long, text string")
    r = periodic_runs(docs).first()
    assert r.runs == [(0, 6, 1)] and r.collapsed == "so it goes on and on"
