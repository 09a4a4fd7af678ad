"""Plain-Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def contamination(docs, items, window=13):
    known = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            known[tuple(w[k : k + window])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for size in {len(k) for k in known}:
            for k in range(len(w) - size + 1):
                if own := known.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def substrings(docs, size=35):
    texts = [(doc, SPACED.findall(text or "")) for doc, text in docs]
    seen = Counter(tuple(w[k : k + size]) for _, w in texts for k in range(len(w) - size + 1))
    out = []
    for doc, w in texts:
        gone = set()
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        out.append((doc, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def shingles(text, size=4):
    w = SPACED.findall(lower(text))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def components(docs, size=4, num=85, den=100):
    sets = [shingles(text, size) for _, text in docs]
    up = list(range(len(docs)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)):
                shared = len(x & y)
                if den * shared >= num * (len(x) + len(y) - shared):
                    up[root(a)] = root(b)
    least = {}
    for k, (doc, _) in enumerate(docs):
        least[root(k)] = min(least.get(root(k), doc), doc)
    return [(doc, len(sets[k]), least[root(k)]) for k, (doc, _) in enumerate(docs)]
