"""Deleted interpolation against plain counting and plain expectation-maximisation."""

import math
import random
import zlib
from collections import Counter

import pytest
from brute import SPACED, lower

from ladderwork.llm import scoring
from ladderwork.llm.scoring import BUCKETS, PAIRS_FROM, even_weights, scored
from ladderwork.llm.totals import Spread

B, E = ("begin",), ("end",)


def plain_scores(docs, rounds=scoring.ROUNDS):
    crc = lambda d: zlib.crc32(str(d).encode()) if d is not None else 0
    lines = [[B, B, *SPACED.findall(lower(t)), E] for _, t in docs]
    grams = lambda line: [tuple(line[i - 2 : i + 1]) for i in range(2, len(line))]
    learn = [crc(d) % 10 != 0 for d, _ in docs]
    tri, bi, uni = Counter(), Counter(), Counter()
    for line, use in zip(lines, learn):
        if use:
            for g in grams(line):
                tri[g] += 1
                bi[g[1:]] += 1
                uni[g[2]] += 1
    seen, types = sum(uni.values()), len(uni)
    share = 1 / (types + 1)

    def estimates(g, less):
        documents = uni[E] - less[1][E] if less else uni[E]
        c = lambda kind, key: (tri, bi, uni)[3 - kind][key] - ((less[3][key], less[2][key], less[1][key])[3 - kind] if less else 0)
        u, v, w = g
        c1 = c(1, v) if v != B else documents
        c2 = (c(2, (u, v)) if u != B or v != B else documents) if v != B else documents
        total = seen - (sum(less[1].values()) if less else 0)
        bucket = min(PAIRS_FROM + c2.bit_length() - 1, BUCKETS - 1) if c2 > 0 else min(c1.bit_length(), PAIRS_FROM - 1) if c1 > 0 else 0
        return bucket, (share, c(1, w) / total if total > 0 else share, c(2, (v, w)) / c1 if c1 > 0 else 0.0, c(3, g) / c2 if c2 > 0 else 0.0)

    events = []
    for line, (d, _) in zip(lines, docs):
        if crc(d) % 10 and crc(d) // 10 % 10 == 0:
            own = {3: Counter(grams(line)), 2: Counter(g[1:] for g in grams(line)), 1: Counter(g[2] for g in grams(line))}
            events += [estimates(g, own) for g in grams(line)]
    weights, prior, before = even_weights(), even_weights(), None
    for _ in range(rounds if events else 0):
        sums, n, gain = {}, Counter(), 0.0
        for b, f in events:
            p = [weights[b][k] * f[k] for k in range(4)]
            total = sum(p)
            gain += math.log(total)
            n[b] += 1
            s = sums.setdefault(b, [0.0] * 4)
            for k in range(4):
                s[k] += p[k] / total
        for b, s in sums.items():
            weights[b] = [(s[k] + prior[b][k]) / (n[b] + 1) for k in range(4)]
        if before is not None and gain / len(events) - before < scoring.GAIN:
            break
        before = gain / len(events)
    out = []
    for line, use, (d, _) in zip(lines, learn, docs):
        base = score = 0.0
        for g in grams(line):
            b, f = estimates(g, None)
            score += math.log10(sum(weights[b][k] * f[k] for k in range(4)))
            base += math.log10((uni[g[2]] + 0.1) / (seen + 0.1 * (types + 1)))
        out.append((d if d is not None else -1, not use, len(line) - 2, sum(uni[w] > 0 for w in line[2:]), seen, base, score))
    return sorted(out)


def same(docs, rows):
    got = sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in map(tuple, scored(docs).collect()))
    wanted = plain_scores(rows)
    assert len(got) == len(wanted)
    for x, y in zip(got, wanted):
        assert x[:5] == y[:5] and x[5] == pytest.approx(y[5], abs=1e-6) and x[6] == pytest.approx(y[6], rel=1e-6, abs=1e-6)
    return got


def test_query_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = same(docs, [(r.doc_id, r.text) for r in docs.collect()])
    out = [r for r in got if r[1]]
    assert out and sum(r[6] for r in out) > sum(r[5] for r in out)  # better than the base on documents held out


@pytest.mark.parametrize("wide", [2048, 4])
def test_awkward_rows(spark, monkeypatch, wide):
    """Nulls, empty and long texts, repeated rows and clashing columns, with few ranges and with shelves."""
    monkeypatch.setattr(scoring, "Spread", lambda ranges, of: Spread(ranges, wide, 3, of))
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("a b B c d e f G é".split()) for _ in range(rng.randint(0, 40)))) for k in range(300)]
    rows += [(None, "a b c"), (None, None), (400, None), (401, ""), (402, "\n"), (403, "long " * 4000)] + rows[:20]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fold string, block int").repartition(3)
    same(docs, rows)
    assert scored(docs.limit(0)).count() == 0


def test_nothing_to_learn_from(spark):
    out = [k for k in range(60) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(k, "some words here") for k in out]
    same(spark.createDataFrame(rows, "doc_id long, text string"), rows)
