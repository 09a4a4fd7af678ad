"""Periodic runs: stretches of words that repeat with a short period, found by online dyadic square catching.

Words are appended from left to right. For each power of two L, every completed block of L words sets a catcher that waits
for its block to come back: an appended word completes one more suffix of L words, which is compared with the one catcher
that expects it at a distance of (2L - 1) / 3 to (4L - 2) / 3 words. A stretch of period q and at least four periods holds a
whole block, followed by the same block q words later, of the level whose distances include q, so none is missed. Squares
caught by neighbouring blocks at one distance merge; what they span is compared onwards to both sides, to a maximal run.

An appended piece advances all comparisons of a level as one numpy operation. A catcher keeps one hash, a level the hashes
of its last L suffixes, so the state is a few words for each word of the text, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import SPACED, U64, chunks, joined, mix, release_memory, utf8, words

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words appended at once; cells of a table of comparisons.
PIECE, CELLS = 1 << 18, 1 << 20
_LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


class _Level:
    """Catchers of blocks of `size` words and the hashes of the last suffixes of that size."""

    def __init__(self, size: int):
        self.size, self.near, self.far = size, (2 * size + 1) // 3, (4 * size + 1) // 3 - 1
        self.blocks = np.zeros(0, U64)
        self.tail, self.tail_at = np.zeros(0, U64), 0


class SquareCatchers:
    """Feed words' codes with append(); runs() gives the runs so far. Equal words must have equal codes, others different ones."""

    def __init__(self):
        self.n = 0
        self._codes = np.zeros(0, U64)
        self._levels: list[_Level] = []
        self._ended: list[tuple[int, int, int]] = []  # start, end, period
        self._open: dict[int, tuple[int, int]] = {}  # stretches that reach the last word, by period

    def append(self, codes: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(codes)
        if self.n > len(self._codes):
            self._codes = np.concatenate([self._codes[:before], np.zeros(max(self.n, 2 * before if before else 0) - before, U64)])
        self._codes[before : self.n] = codes
        self._lengthen(before)
        hashes, at, size = self._codes, 0, 1
        for number in range(60):
            size *= 2
            if self.n < size:
                break
            if number == len(self._levels):
                self._levels.append(_Level(size))
            level, low, end = self._levels[number], max(0, before - size + 1), self.n - size + 1
            new = mix(hashes[low - at : end - at] * _LEFT + hashes[low + size // 2 - at : end + size // 2 - at] * _RIGHT)
            first = -(-low // size) * size
            level.blocks = np.concatenate([level.blocks, new[first - low :: size]])
            self._caught(level, low, new)
            hashes, at = np.concatenate([level.tail, new]), level.tail_at if len(level.tail) else low
            keep = max(at, self.n - 2 * size + 1)
            level.tail, level.tail_at = hashes[keep - at :].copy(), keep

    def _agreeing(self, left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
        """How many words agree from each pair of places on, forwards or backwards."""
        got, alive, width = np.zeros(len(left), np.int64), np.arange(len(left)), 8
        while len(alive):
            going = []
            for part in np.array_split(alive, -(-len(alive) * width // CELLS)):
                ahead = (got[part, None] + np.arange(width)) * step
                i, j = left[part, None] + ahead, right[part, None] + ahead
                inside = (i >= 0) & (j < self.n)
                same = inside & (self._codes[np.where(inside, i, 0)] == self._codes[np.where(inside, j, 0)])
                whole = same.all(axis=1)
                got[part] += np.where(whole, width, same.argmin(axis=1))
                going.append(part[whole])
            alive, width = np.concatenate(going), min(2 * width, 1 << 14)
        return got

    def _settle(self, start: int, end: int, period: int) -> None:
        if end == self.n:
            self._open[period] = (start, end)
        elif end - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
            self._ended.append((start, end, period))

    def _lengthen(self, before: int) -> None:
        """Carries stretches that reached the last word over the appended ones."""
        if self._open and self.n > before:
            was, self._open = self._open, {}
            period = np.array(list(was))
            more = self._agreeing(before - period, np.full(len(period), before), 1)
            for (q, (s, e)), k in zip(was.items(), more.tolist()):
                self._settle(s, e + k, q)

    def _known(self, below: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of shorter periods, in order, and the last end of all up to each."""
        runs = [(s, e) for s, e, q in self._ended if q < below] + [(s, e) for q, (s, e) in self._open.items() if q < below and e - s >= max(LEAST_WORDS, LEAST_PERIODS * q)]
        runs.sort()
        start, end = np.array(runs, np.int64).reshape(-1, 2).T
        return start, np.maximum.accumulate(end) if len(end) else end

    def _caught(self, level: _Level, low: int, new: np.ndarray) -> None:
        """Advances the level's catchers over the new suffixes, the first of which starts at word `low`."""
        size = level.size
        skip = max(0, level.near - low)
        place = np.arange(low + skip, low + len(new))
        distance = (place - level.near) % size + level.near
        back = place - distance
        hit = np.flatnonzero((distance <= level.far) & (level.blocks[back // size] == new[skip:]))
        if not len(hit):
            return
        back, distance = back[hit], distance[hit]
        # Inside a run of a shorter period the block comes back at its multiples only.
        start, end = self._known(level.near)
        if len(start):
            at = np.searchsorted(start, back, "right") - 1
            fresh = (at < 0) | (end[at] < back + distance + size)
            back, distance = back[fresh], distance[fresh]
        for q in {*distance.tolist()} & self._open.keys():
            s, e = self._open[q]
            fresh = (distance != q) | (back < s) | (back + q + size > e)
            back, distance = back[fresh], distance[fresh]
        if not len(back):
            return
        order = np.lexsort((back, distance))
        back, distance = back[order], distance[order]
        new_one = np.ones(len(back), bool)
        new_one[1:] = (distance[1:] != distance[:-1]) | (back[1:] != back[:-1] + size)
        first = np.flatnonzero(new_one)
        last = np.append(first[1:], len(back)) - 1
        q, s, e = distance[first], back[first], back[last] + distance[last] + size
        s = s - self._agreeing(s - 1, s - 1 + q, -1)
        e = e + self._agreeing(e - q, e, 1)
        for found in dict.fromkeys(zip(s.tolist(), e.tolist(), q.tolist())):
            self._settle(*found)

    def runs(self) -> np.ndarray:
        """Rows of start, length and smallest period, by start and period. Of stretches over the same words that with the smallest
        period is the run."""
        found = self._ended + [(s, e, q) for q, (s, e) in self._open.items() if e - s >= max(LEAST_WORDS, LEAST_PERIODS * q)]
        least: dict[tuple[int, int], int] = {}
        for s, e, q in found:
            least[s, e] = min(q, least.get((s, e), q))
        return np.array(sorted((s, e - s, q) for (s, e), q in least.items()), np.int64).reshape(-1, 3)


def _tails(first: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Number of the word that stands at each place once the texts with an edit of a tenth repeat a stretch up to their end."""
    out = np.arange(int(first[-1]))
    n = np.diff(first)
    for k in np.flatnonzero((edits >= 0) & (edits % 10 == 0) & (n > 0)).tolist():
        g, size = int(edits[k]) // 10, int(n[k])
        a = g % size
        p = 1 + (size - a) // (3 + g % 8)
        out[first[k] + a : first[k + 1]] = first[k] + a + np.arange(size - a) % p
    return out


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_MADE = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _found(text: pa.Array, edits: np.ndarray) -> pa.StructArray:
    data, offsets = utf8(text)
    counts, sizes, rows, kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)], []
    for i, j in chunks(offsets):
        found = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACED)
        which = _tails(found.first, edits[i:j])
        # A code of its own stands before each text, so no run reaches over it.
        begin = found.first[:-1] + np.arange(j - i)
        codes = np.empty(len(which) + j - i, U64)
        inside = np.ones(len(codes), bool)
        inside[begin] = False
        codes[begin] = mix(np.arange(j - i, dtype=U64) ^ U64(0x5E9A7A7055A7E5))
        codes[inside] = found.hashes(1)[which]
        catchers = SquareCatchers()
        for k in range(0, len(codes), PIECE):
            catchers.append(codes[k : k + PIECE])
        runs = catchers.runs()
        owner = np.searchsorted(begin, runs[:, 0], "right") - 1
        cover = np.zeros(len(codes) + 1, np.int64)
        np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
        np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
        stay = np.flatnonzero(np.cumsum(cover)[:-1][inside] == 0)
        kept += joined(found, which[stay], np.searchsorted(stay, found.first))
        runs[:, 0] -= begin[owner] + 1
        rows.append(runs)
        sizes.append(np.bincount(owner, minlength=j - i))
        counts.append(found.counts)
    rows, ends = np.concatenate(rows), np.append(0, np.cumsum(np.concatenate(sizes)))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, k].copy()) for k in range(3)], fields=list(_RUN)))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(counts), pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], fields=list(_MADE))


_KIND = T.StructType().add("n_words", "long").add("runs", T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))).add("collapsed", "string")


@F.arrow_udf(_KIND)
def _runs_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, edits in batches:
        yield _found(text, edits.fill_null(-1).to_numpy(zero_copy_only=False))
        release_memory()


def periodic_runs(docs: DataFrame, edit: Column | None = None) -> DataFrame:
    """docs' doc_id with n_words, runs (array of start, length, period, by start and period; numbered from word 0) and collapsed
    (the words that no run holds after its first period, joined by one space).

    Words are [^\\x20\\x09-\\x0D]+, unchanged. A run is a stretch with a smallest period q, of 6 words and 4 q words at least,
    that no neighbouring word extends with the same period; runs may overlap. edit: a number h for each row; where h % 10 = 0
    the end of the text is first replaced by a stretch of it that repeats (see the contract of op13).

    One map without an exchange. Null and empty texts have no words, no runs and an empty text; a text is one cell, however
    long; one row per row of docs, so repeated rows stay; other columns of docs are ignored; an empty table gives no rows."""
    edit = F.lit(None).cast("bigint") if edit is None else edit.cast("bigint")
    return docs.select("doc_id", _runs_of(F.col("text"), edit).alias("made")).select("doc_id", "made.*")


def run_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op13. A row without a doc_id is not edited."""
    made = periodic_runs(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    higher = lambda best, x: F.when(best.isNull() | (x.length * best.period > best.length * x.period), x).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), higher)
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x.start.cast("string"), x.length.cast("string"), x.period.cast("string")), F.lit("\n")))
    return made.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
