"""N-gram Jaccard join with count vectors and R-trees.

* Lossless candidates. A set's shingles are hashed into groups. If two sets differ in at most D shingles and there are more
  than D groups, some group has the same shingles in both; if one of them has more than D strong groups, some strong group
  has. A group is strong when it holds two shingles or more, not all of them frequent ones: chance hardly makes two of these
  equal. So a set's keys are its strong groups, or where those are too few all of its groups, for a number of groups that
  its size fixes. Sets that share a key are chained (not paired), which gives candidate components; all others are apart.
  Groups are dealt by a seed, and linked sets share a key under every seed, so a component is keyed again, by its own
  frequencies and another seed, until it falls apart no further.
* Corpus-wide prefixes, in place of the groups where more may differ (`prefixes`): every shingle's frequency is counted by ranges,
  in cells that few shingles share, and a block of texts is answered for its own. Ordered by these, rare ones first, linked
  sets share one of the shingles that each may lack and one more; those of a single text are no keys. Passages that many
  texts share are then keys only of texts that hold little else.
* Prefixes. A task that has a whole component knows all of its frequencies. Ordered by these, rare ones first, linked sets
  share one of the shingles that each may lack and one more, so there sets are chained by these, again until the component
  falls apart no further.
* Bounds. The vector of a set's counts in some groups is a point, and the summed minima of two points bound the shared
  shingles. Inside a component an R-tree of these points, with nested boxes, drops far boxes and
  points, and surviving pairs are verified on their shingles.

A vector alone bounds random texts well but in many dimensions boxes overlap, so an R-tree over the whole corpus would
compare nearly all pairs; the candidate step is what keeps the work in proportion to the corpus.

Frequencies are counted over all texts: each task counts what it holds at a time, and shingles that it has more than once
are summed over tasks. They tell which keys serve, not which sets link; results are the same for any frequencies.

A key is 10 bytes: what is left of its hash beside its range, and a short code of its set. A task chains the sets that share
a key before it sends one of them on, so a key that a third of all sets hold is one entry per batch of a task.

Components beyond LOCAL shingles are not gathered: they are dealt over tasks, and chosen pivots visit all of them, round by
round, until every set outside the largest part has been a pivot. No pair of different parts is then unchecked. LOCAL, PART
and the other sizes below switch plans only, never results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, stars
from .shared import by_ids, free_name, join_frequent, repeated_once, stage
from .totals import SENT as COUNTED_SENT
from .totals import Spread, rows_of, totals
from .words import SPACED_LOWER, U64, chunks, mix, release_memory, utf8, words

#: Least and most dimensions of a tree's count vectors (one for PER_GROUP shingles of its middle set); entries of a tree's node.
GROUPS, MOST_GROUPS, PER_GROUP, LEAF = 64, 1024, 8, 16
#: Shingles in all sets of a component that one task resolves (8 bytes each); sets of a larger one, and pivots, that meet in a task.
LOCAL, PART = 12_000_000, 1024
#: Shingles of small components that share a task's group.
BUNDLE = 2_000_000
#: Shingles that a task counts at once; the most frequent ones, which all tasks know (8 bytes each), and sets that hold one at least.
COUNTED, KNOWN, FREQUENT_FROM = 4_000_000, 500_000, 6
#: Groups beyond those that may differ, so that strong ones are more than those.
SPARE = 1.12
#: Keys that a task gathers before it sends them, and keys a range receives on average.
SEND_KEYS, RANGE_KEYS = 400_000, 1_500_000
#: Bytes of text in a block, shingles in a range and cells for each shingle, on average, where frequencies are counted.
BLOCK_BYTES, RANGE_SHINGLES, CELLS = 6 << 20, 3 << 20, 16
#: Rows that repeat are dealt to a block once if they have together more bytes than this.
REPEATED_BYTES = BLOCK_BYTES // 2
#: Sets of a component from which on it is keyed again; share of its weight that must fall off for that to go on.
KEYED_AGAIN, SHRUNK = 24, 0.1
#: Cells in which a task counts a component's shingles. Those that share a cell count together: any order will do.
TALLY = 1 << 22
#: Bits of a set's name in the candidate graph. Names that collide only join candidates, which are then verified.
CODE = (1 << 48) - 1


class Threshold:
    """Link when den * shared >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least_shared(self, total):
        """Shared shingles that sets of together `total` need at least."""
        return -(-self.num * total // (self.num + self.den))

    def prefix(self, n: int) -> int:
        """Length of the prefix of a set of n: a linked set shares at least the rest and one more."""
        return n + 1 - -(-self.num * n // self.den)

    @lru_cache(maxsize=None)  # noqa: B019
    def band(self, n: int) -> int:
        """Sizes fall into bands so that linked sets are in the same or in neighbouring bands."""
        return int(np.searchsorted(self.starts(n), n, "right")) - 1

    def starts(self, n: int) -> np.ndarray:
        """First sizes of bands, up to one beyond n's neighbour."""
        held = self.__dict__.setdefault("_starts", [1, 2])
        while held[-3 if len(held) > 2 else 0] <= n:
            held.append(max(held[-1] + 1, (held[-1] - 1) * self.den // self.num + 1))
        return np.array(held)

    @lru_cache(maxsize=None)  # noqa: B019
    def groups(self, band: int) -> tuple[int, int]:
        """(groups, groups that may differ) for pairs whose smaller set is in the band."""
        self.starts(1)
        while len(self._starts) < band + 4:
            self.starts(self._starts[-1])
        first, largest = self._starts[band], self._starts[band + 2] - 1
        differ = (self._starts[band + 1] - 1 + largest) * (self.den - self.num) // (self.den + self.num)
        for more in np.arange(1, 2.5, 0.1):
            mean = first / (more * (differ + 1))
            if more * (1 - np.exp(-mean) * (1 + mean)) >= SPARE:
                break
        return int(np.ceil(more * (differ + 1))) if differ else 1, differ


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer words than `size` are one shingle; no words give none."""
    found = words(data, offsets, SPACED_LOWER)
    h = found.hashes(1)
    n = max(len(h) - size + 1, 0)
    step = mix(np.arange(1, size + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    total = np.zeros(n, U64)
    for k in range(size):
        total += h[k : k + n] * step[k]
    total = mix(total)
    out = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(total[a : b - size + 1]))
        elif b > a:
            out.append(mix((h[a:b] * step[: b - a]).sum(keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_id(shingles: np.ndarray) -> int:
    """64-bit name of a set, as a signed number."""
    return int(mix((mix(shingles ^ U64(0x1234567))).sum(keepdims=True) + U64(len(shingles))).view(np.int64)[0]) if len(shingles) else 0


def keys_of(shingles: np.ndarray, frequent: np.ndarray, threshold: Threshold, seed: int = 0) -> np.ndarray:
    """Keys of which linked sets share one, whatever the seed and whichever shingles are frequent."""
    own = threshold.band(len(shingles))
    spread, content, out = mix(shingles ^ U64(0x77 + (seed << 20))), mix(shingles ^ U64(0x99)), []
    for band in (own, own - 1):
        if band < 0:
            continue
        k, differ = threshold.groups(band)
        g = (spread % U64(k)).astype(np.int64)
        total = np.zeros(k, U64)
        np.add.at(total, g, content)
        size = np.bincount(g, minlength=k)
        used = (size > 1) & (np.bincount(g[~frequent], minlength=k) > 0)
        if used.sum() <= differ:
            used = size > 0
            if used.sum() <= differ:  # the groups that agree may all be empty
                out.append(mix(np.array([(1 << 60) | band], U64)))
        names = (np.flatnonzero(used).astype(U64) << U64(16)) | U64(band)
        out.append(mix(total[used] ^ mix(names)))
    return np.concatenate(out)


def rarest(shingles: np.ndarray, counts: np.ndarray, threshold: Threshold) -> np.ndarray:
    """The prefix of a set in the order of counts, rare ones first: linked sets share a shingle of both prefixes, in any order
    that both go by."""
    return shingles[np.lexsort((shingles, counts))[: threshold.prefix(len(shingles))]]


def _chained(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of entries that go on, chain edges): of the entries of a key one goes on, and the others' names are joined to its."""
    order = np.lexsort((names, keys))
    begin, n = _runs(keys[order])
    lead = np.repeat(names[order[begin]], n)
    others = names[order] != lead
    return order[begin], np.unique(np.stack([lead[others], names[order][others]], 1), axis=0)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of runs of equal values."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(ordered)))


def _joined(part: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Parts after x and y are joined pairwise."""
    if not len(x):
        return part
    own = np.unique(np.stack([part[x], part[y]], 1), axis=0)
    star = stars(own)
    to = np.arange(len(part))
    to[star[:, 0]] = star[:, 1]
    return to[part]


READ = "docs binary, sizes binary, sids binary, shingles binary, counts binary"
SENT = "range int, keys binary, edges binary"
ABOUT = "doc_id bigint, n_shingles bigint, sid bigint"
EDGES = "src bigint, dst bigint"


def _rows(schema: str, **columns: list) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), pa.int32() if kind == "int" else pa.binary()) for c, kind in fields], names=[c for c, _ in fields])


def _salted(shingles: np.ndarray, component: int) -> np.ndarray:
    """Shingles as they are named inside a component; sets of different components share none. 0 is no component."""
    return mix(shingles ^ mix(np.array([component], np.int64).view(U64))) if component else shingles


def read_sets(texts: DataFrame, size: int, count: bool = True) -> DataFrame:
    """texts (doc_id, text, component) as written rows of READ: documents with the names of their sets (docs, sizes, sids), and, if
    they are to be counted, shingles (in their components) that a task has met in more sets than one, with how many
    (shingles, counts)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        n_held = 0

        def flush() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            return _rows(READ, shingles=[value[n > 1].tobytes()], counts=[n[n > 1].tobytes()])

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            components = batch.column(2).to_pylist()
            for i, j in chunks(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                ids = np.array([set_id(s) for s in sets], np.int64)
                docs = batch.column(0).slice(i, j - i)
                # A size below zero marks a document without an id.
                about = np.array([len(s) for s in sets], np.int64)
                about[np.array(docs.is_null(), bool)] ^= -1
                yield _rows(READ, docs=[docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], sizes=[about.tobytes()], sids=[ids.tobytes()])
                for c, s, sid in zip(components[i:j], sets, ids.tolist()):
                    if count and len(s) and (c, sid) not in seen:
                        seen.add((c, sid))
                        held.append(_salted(s, c))
                        n_held += len(s)
                if n_held >= COUNTED:
                    yield flush()
                    held.clear()
                    seen.clear()
                    n_held = 0
                    release_memory()
        if held:
            yield flush()
        held.clear()
        release_memory()

    return stage(texts.mapInArrow(read, READ), "sets")


def documents_of(read: DataFrame) -> DataFrame:
    """doc_id, n_shingles and sid of each document."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, sizes, sids in zip(*(c.to_pylist() for c in batch.columns)):
                n = np.frombuffer(sizes, np.int64)
                columns = [pa.array(np.frombuffer(docs, np.int64), mask=n < 0), pa.array(np.where(n < 0, n ^ -1, n)), pa.array(np.frombuffer(sids, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "sid"])

    return read.where("docs is not null").select("docs", "sizes", "sids").mapInArrow(unpack, ABOUT)


def frequent_shingles(read: DataFrame) -> np.ndarray:
    """The KNOWN most frequent shingles, sorted."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shingles, counts in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(shingles, np.int64)), pa.array(np.frombuffer(counts, np.int64))], names=["shingle", "n"])

    met = read.where("shingles is not null").select("shingles", "counts").mapInArrow(unpack, "shingle bigint, n bigint")
    found = met.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    found = stage(found.select("shingle", F.floor(F.log2("n") * 4).cast("int").alias("level")), "frequent_shingles")
    least, total = 1 << 30, 0
    for level, n in sorted(map(tuple, found.groupBy("level").agg(F.count("*")).collect()), reverse=True):
        total += n
        if total > KNOWN:
            break
        least = level
    rows = found.where(F.col("level") >= least).select("shingle").toPandas()
    return np.sort(rows["shingle"].to_numpy(np.int64).view(U64))


def _among(shingles: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(shingles), bool)
    return known[np.minimum(np.searchsorted(known, shingles), len(known) - 1)] == shingles


def _dealt(keys: np.ndarray, codes: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Keys and codes as rows of SENT for their ranges."""
    r = (keys % U64(ranges)).astype(np.int64)
    # 32 bits beside the range: an equal key by chance only makes a candidate that is then checked.
    rest = (keys // U64(ranges)).astype("<u4").view(np.uint8).reshape(-1, 4)
    entry = np.concatenate([rest, codes.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]], 1)
    order = np.argsort(r, kind="stable")
    bounds = np.searchsorted(r[order], np.arange(ranges + 1))
    some = np.flatnonzero(np.diff(bounds))
    for k in range(0, len(some), 64):
        own = some[k : k + 64].tolist()
        yield _rows(SENT, range=own, keys=[np.ascontiguousarray(entry[order[bounds[x] : bounds[x + 1]]]).tobytes() for x in own])


def send_prefixes(texts: DataFrame, bytes_of_text: int, size: int, threshold: Threshold, ranges: int) -> DataFrame:
    """As send_keys: the keys are the shingles of the sets' prefixes, by frequency over all texts (of a component), that other sets
    have, too. Frequencies are those of cells, which all texts see alike: linked sets share a key in any such order, and
    one shingle in CELLS of those that only one set has is a key nevertheless."""
    blocks = max(64, -(-bytes_of_text // BLOCK_BYTES))
    shingles = max(1, bytes_of_text // 6)
    parts = max(16, -(-shingles // RANGE_SHINGLES))
    per = max(1 << 12, -(-CELLS * shingles // parts))
    spread = Spread(parts, of=lambda keys: keys // U64(per))

    def sets_of(block: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(distinct sets, their codes, cell of each shingle of all of them)."""
        sets, codes, met = [], [], set()
        for s, c in zip(_words_of(block.column("text"), size), block.column("component").to_pylist()):
            if len(s) and (c, sid := set_id(s)) not in met:
                met.add((c, sid))
                sets.append(_salted(s, c))
                codes.append(sid & CODE)
        cells = mix(np.concatenate(sets) ^ U64(0x3C3C)) % U64(per * parts) if sets else np.zeros(0, U64)
        return sets, np.array(codes, np.int64), cells

    def send(key: tuple, block: pa.Table) -> pa.Table:
        _, _, cells = sets_of(block)
        cell, n = np.unique(cells, return_counts=True)
        out = rows_of(COUNTED_SENT, spread.send(key[0].as_py(), cell, n))
        release_memory()
        return out

    def choose(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        sets, codes, cells = sets_of(block)
        out = []
        if sets:
            cell, number = np.unique(cells, return_inverse=True)
            count = spread.receive(cell, answers)[0][number]
            keys, at = [], 0
            for s in sets:
                own = count[at : at + len(s)]
                first = np.lexsort((s, own))[: threshold.prefix(len(s))]
                keys.append(s[first[own[first] > 1]])
                at += len(s)
            codes = np.repeat(codes, [len(k) for k in keys])
            keys = np.concatenate(keys)
            on, edges = _chained(keys, codes)
            if len(edges):
                out.append(_rows(SENT, range=[int(edges[0, 0]) % ranges], edges=[np.ascontiguousarray(stars(edges)).tobytes()]))
            out += _dealt(keys[on], codes[on], ranges)
        release_memory()
        return pa.Table.from_batches(out or [_rows(SENT, range=[])])

    dealt = texts.select("text", "component", F.pmod(F.xxhash64("doc_id", "text", "component"), F.lit(blocks)).alias("block")).groupBy("block")
    answers = totals(dealt.applyInArrow(send, COUNTED_SENT), spread)
    return dealt.cogroup(answers.groupBy("block")).applyInArrow(choose, SENT)


def send_keys(texts: DataFrame, known: np.ndarray, size: int, threshold: Threshold, ranges: int, seed: int = 0) -> DataFrame:
    """texts (text, component) as rows of SENT: for each range the keys of sets with the codes of these (keys), and chain edges of
    sets that share a key in a task (edges, to any range). Sets of different components share no key. known: frequent
    shingles."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[tuple[int, int]] = set()
        n_keys = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, codes = (np.concatenate(x) for x in zip(*held))
            on, edges = _chained(keys, codes)
            if len(edges):
                yield _rows(SENT, range=[int(edges[0, 0]) % ranges], edges=[np.ascontiguousarray(stars(edges)).tobytes()])
            yield from _dealt(keys[on], codes[on], ranges)

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            components = batch.column(1).to_pylist()
            for i, j in chunks(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                ids = np.array([set_id(s) for s in sets], np.int64)
                for s, sid, c in zip(sets, ids.tolist(), components[i:j]):
                    if len(s) and (c, sid) not in seen:
                        seen.add((c, sid))
                        own = _salted(s, c)
                        keys = keys_of(own, _among(own, known), threshold, seed)
                        held.append((keys, np.full(len(keys), sid & CODE, np.int64)))
                        n_keys += len(keys)
                if n_keys >= SEND_KEYS:
                    yield from flush()
                    n_keys = 0
                    held.clear()
                    seen.clear()
                    release_memory()
        if held:
            yield from flush()
        held.clear()
        release_memory()

    return texts.select("text", "component").mapInArrow(send, SENT)


def candidate_components(sent: DataFrame) -> DataFrame:
    """code, root for the codes of all sets that share a key with another."""

    def chain(key: tuple, rows: pa.Table) -> pa.Table:
        entry = np.concatenate([np.frombuffer(x or b"", np.uint8).reshape(-1, 10) for x in rows.column("keys").to_pylist()])
        wide = np.zeros((len(entry), 8), np.uint8)
        wide[:, :6] = entry[:, 4:]
        _, edges = _chained(np.ascontiguousarray(entry[:, :4]).view("<u4").ravel(), wide.view("<i8").ravel())
        edges = np.concatenate([edges, *(np.frombuffer(x or b"", np.int64).reshape(-1, 2) for x in rows.column("edges").to_pylist())])
        edges = stars(edges) if len(edges) else edges
        release_memory()
        return pa.table([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["src", "dst"])

    return connected_components(sent.groupBy("range").applyInArrow(chain, EDGES)).withColumnRenamed("node", "code")


class Tree:
    """An R-tree of count vectors: leaves of LEAF points, sorted along the axes of widest spread, and boxes of LEAF boxes above them."""

    def __init__(self, sets: list[np.ndarray], threshold: Threshold):
        self.sets, self.threshold = sets, threshold
        self.size = np.array([len(s) for s in sets], np.int64)
        self.groups = int(np.clip(np.median(self.size) // PER_GROUP, GROUPS, MOST_GROUPS)) if len(sets) else GROUPS
        self.points = np.zeros((len(sets), self.groups), np.int32)
        for k, s in enumerate(sets):
            self.points[k] = self.point(s)
        axes = np.argsort(-self.points.astype(np.float64).std(0))[:3] if len(sets) else np.zeros(0, int)
        self.order = np.lexsort([self.points[:, a] for a in axes[::-1]] + [self.size // 8]) if len(sets) else np.zeros(0, int)
        #: (largest counts, least size, largest size) of each box, from the points up.
        self.levels = [(self.points[self.order], self.size[self.order], self.size[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            top, least, most = self.levels[-1]
            begin = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, begin, axis=0), np.minimum.reduceat(least, begin), np.maximum.reduceat(most, begin)))

    def point(self, shingles: np.ndarray) -> np.ndarray:
        return np.bincount((shingles >> U64(33)).astype(np.int64) % self.groups, minlength=self.groups).astype(np.int32)

    def near(self, shingles: np.ndarray, part: np.ndarray | None = None, own: int = -1) -> np.ndarray:
        """Numbers of the sets that link with these shingles; given the sets' parts, at most one of each part, and none of part own."""
        point, n = self.point(shingles), len(shingles)
        box = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            top, least, most = self.levels[level]
            if level == 0 and part is not None:
                box = box[part[self.order[box]] != own]
            need = self.threshold.least_shared(n + least[box])
            box = box[np.minimum(most[box], n) >= need]
            box = box[np.minimum(top[box], point).sum(1) >= self.threshold.least_shared(n + least[box])]
            if level:
                box = (box[:, None] * LEAF + np.arange(LEAF)).ravel()
                box = box[box < len(self.levels[level - 1][0])]
        out, met = [], set()
        for k in self.order[box].tolist():
            if part is not None and part[k] in met:
                continue
            other = self.sets[k]
            where = np.minimum(np.searchsorted(other, shingles), len(other) - 1)
            if int((other[where] == shingles).sum()) >= self.threshold.least_shared(n + len(other)):
                out.append(k)
                if part is not None:
                    met.add(part[k])
        return np.array(out, np.int64)


class Forest:
    """Union-find."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, k: int, others: np.ndarray) -> None:
        a = self.root(k)
        for o in others.tolist():
            b = self.root(o)
            if a != b:
                a, b = min(a, b), max(a, b)
                self.up[b] = a

    def roots(self) -> np.ndarray:
        while (self.up != (nxt := self.up[self.up])).any():
            self.up = nxt
        return self.up


def resolve(sets: list[np.ndarray], threshold: Threshold) -> np.ndarray:
    """Part of each set (number of its first set) when linked sets are joined. Exact: every pair of different parts has been
    told apart by prefixes, bounded or verified."""
    part = np.arange(len(sets))
    left = [part]
    while left:
        own = left.pop()
        if len(own) < KEYED_AGAIN:
            part[own] = own[_searched([sets[k] for k in own], threshold)]
            continue
        tally = np.zeros(TALLY, np.int32)
        for k in own:
            np.add.at(tally, sets[k] % U64(TALLY), 1)
        keys = [rarest(sets[k], tally[sets[k] % U64(TALLY)], threshold) for k in own]
        _, edges = _chained(np.concatenate(keys), np.repeat(np.arange(len(own)), [len(k) for k in keys]))
        del tally, keys
        label = _joined(np.arange(len(own)), edges[:, 0], edges[:, 1])
        order = np.argsort(label, kind="stable")
        for piece in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            if len(piece) > (1 - SHRUNK) * len(own):
                part[own[piece]] = own[piece][_searched([sets[k] for k in own[piece]], threshold)]
            elif len(piece) > 1:
                left.append(own[piece])
    return part


def _searched(sets: list[np.ndarray], threshold: Threshold) -> np.ndarray:
    """Parts by searches of the sets' R-tree, from its middle on, until every set outside the largest part has searched."""
    n = len(sets)
    forest = Forest(n)
    tree, visited = Tree(sets, threshold), np.zeros(n, bool)
    middle = np.median(tree.points, axis=0)
    queue = [int(np.abs(tree.points - middle).sum(1).argmin())]
    while True:
        for k in queue:
            if visited[k]:
                continue
            visited[k] = True
            part = forest.roots()
            forest.join(k, tree.near(sets[k], part, part[k]))
        part = forest.roots()
        own, size = np.unique(part, return_counts=True)
        rest = np.flatnonzero((part != own[size.argmax()]) & ~visited)
        if not len(rest):
            return part
        queue = rest[:64].tolist()


def _words_of(column: pa.Array, size: int) -> list[np.ndarray]:
    data, offsets = utf8(column)
    return [s for i, j in chunks(offsets) for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)]


LINKS = EDGES


def _with_sizes(members: DataFrame) -> DataFrame:
    """members (component, n, ...) with the number of sets and of shingles of their component."""
    sizes = members.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("weight"))
    return join_frequent(members.drop("sets", "weight"), sizes, "component")


def _local_links(members: DataFrame, total: int, size: int, threshold: Threshold) -> DataFrame:
    """Links (set id, id of the first set of its part) of components of bounded size. A large one is a task's group of its own;
    small ones share groups of about BUNDLE shingles. total: shingles of all."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, component = rows.column("sid").to_numpy(), rows.column("component").to_numpy()
        src, dst = [], []
        order = np.lexsort((ids, component))
        for at in np.split(order, np.flatnonzero(np.diff(component[order])) + 1) if len(order) else []:
            own, first = np.unique(ids[at], return_index=True)
            part = resolve(_words_of(rows.column("text").take(pa.array(at[first])), size), threshold)
            src.append(own[part])
            dst.append(own)
        release_memory()
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table([pa.array(join(src)), pa.array(join(dst))], names=["src", "dst"])

    bundles = max(64, -(-total // BUNDLE))
    alone = F.col("weight") > BUNDLE
    bundle = F.when(alone, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bundles)))
    return members.select("component", "sid", "text", alone.alias("alone"), bundle.alias("bundle")).groupBy("alone", "bundle").applyInArrow(run, LINKS)


def _pivot_links(members: DataFrame, pivots: DataFrame, n_pivots: int, size: int, threshold: Threshold) -> DataFrame:
    """Links between pivots (component, sid) and all members of their components. Members are dealt to parts and pivots to
    slices, and each part meets each slice."""

    def run(key: tuple, own: pa.Table, chosen: pa.Table) -> pa.Table:
        src, dst = [], []
        if len(own) and len(chosen):
            ids = own.column("sid").to_numpy()
            tree = Tree(_words_of(own.column("text"), size), threshold)
            for sid, shingles in zip(chosen.column("sid").to_pylist(), _words_of(chosen.column("text"), size)):
                found = tree.near(shingles)
                found = found[ids[found] != sid]
                src += [sid] * len(found)
                dst += ids[found].tolist()
        return pa.table([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    slices = -(-n_pivots // PART)
    parts = F.ceil(F.col("sets") / PART).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = members.withColumn("part", F.pmod(F.xxhash64("sid"), parts).cast("int")).withColumn("slice", upto(F.lit(slices)))
    sent = members.join(pivots, ["component", "sid"], "left_semi").withColumn("slice", F.pmod(F.xxhash64("sid", F.lit(1)), F.lit(slices)).cast("int"))
    sent = sent.withColumn("part", upto(parts)).select(*[F.col(c).alias(c) for c in ("component", "part", "slice", "sid", "text")])
    keys = ["component", "part", "slice"]
    return dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(run, LINKS)


def _first_of_each(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """component, sid of the first rows of each component; each task keeps no more than that many before rows are gathered."""
    n = F.row_number().over(Window.partitionBy("component").orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).select("component", "sid")


def _large_links(members: DataFrame, size: int, threshold: Threshold, first_pivots: int = 8, round_pivots: int = 256) -> DataFrame:
    """Links that join the parts of components too large for a task. Rounds double their pivots, so they end: at the latest
    when every set has been one."""
    spread = [F.xxhash64("sid"), F.col("sid")]
    links = visited = None
    pivots = _first_of_each(members, spread, first_pivots)
    for turn in numbers():
        pivots = stage(pivots, "pivots")
        n_pivots = pivots.count()
        if not n_pivots:
            return links
        found = stage(_pivot_links(members, pivots, n_pivots, size, threshold), "links")
        links = found if links is None else links.unionByName(found)
        visited = pivots if visited is None else visited.unionByName(pivots)
        if turn == 0:
            # Next those that most first pivots link with: the centre of a group of copies links with all of it.
            counts = found.groupBy(F.col("dst").alias("sid")).agg(F.count("*").alias("links"))
            centre = members.select("component", "sid").join(counts, "sid").join(visited, ["component", "sid"], "left_anti")
            pivots = _first_of_each(centre, [F.desc("links"), F.col("sid")], first_pivots)
            if not pivots.isEmpty():
                continue
        roots = connected_components(links).select(F.col("node").alias("sid"), "root")
        part = stage(members.select("component", "sid").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "parts")
        sizes = part.groupBy("component", "root").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("component").agg(F.max_by("root", F.struct("n", "root")).alias("root"))
        outside = part.join(F.broadcast(largest), ["component", "root"], "left_anti").join(visited, ["component", "sid"], "left_anti")
        pivots = _first_of_each(outside, spread, round_pivots * 2**turn)


def _ranges(bytes_of_text: int, threshold: Threshold) -> int:
    return max(16, -(-int(bytes_of_text / 6 * 4 * (threshold.den - threshold.num) / (threshold.den + threshold.num)) // RANGE_KEYS))


def _prefix_ranges(bytes_of_text: int, threshold: Threshold) -> int:
    return max(16, -(-int(bytes_of_text / 6 * (threshold.den - threshold.num) / threshold.den) // RANGE_KEYS))


def _keyed_again(large: DataFrame, size: int, threshold: Threshold, local: int, prefixes: bool) -> tuple[list[DataFrame], DataFrame | None]:
    """Members of components beyond `local`, keyed again by another seed and the frequencies inside each: (those whose component is small by
    then, those of components that fall apart no further)."""
    done: list[DataFrame] = []
    for seed in numbers(1):
        weight, size_of_text = large.agg(F.sum("n"), F.sum(F.octet_length("text"))).first()
        if not weight:
            return done, None
        texts = large.select(F.lit(0).cast("bigint").alias("doc_id"), "text", "component")
        if prefixes:
            sent = send_prefixes(texts, size_of_text, size, threshold, _prefix_ranges(size_of_text, threshold))
        else:
            sent = send_keys(texts, frequent_shingles(read_sets(texts, size)), size, threshold, _ranges(size_of_text, threshold), seed)
        roots = candidate_components(sent)
        coded = large.select("sid", "n", F.col("sid").bitwiseAND(F.lit(CODE)).alias("code")).join(roots, "code").select("sid", "n", F.col("root").alias("component"))
        named = _with_sizes(stage(coded, "candidates"))
        parted = stage(large.select("sid", "text").join(named, "sid").select("component", "sets", "weight", "sid", "n", "text"), "members")
        done.append(parted.where(F.col("weight") <= local))
        large = parted.where(F.col("weight") > local)
        if (large.agg(F.sum("n")).first()[0] or 0) > (1 - SHRUNK) * weight:
            return done, large


def jaccard_components(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100, local: int = LOCAL, prefixes: bool = False) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their shingle sets.

    docs: doc_id, text; other columns are ignored. Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. The set: distinct
    shingles of `size` words; of fewer words the whole sequence is one shingle; without words it is empty and links with
    nothing. Documents link when den * shared >= num * union. One row per row of docs: doc_id, n_shingles, component_id
    (smallest doc_id of its component; its own when it links with nothing). Rows that repeat a doc_id are rows of their
    own; a null doc_id is never a component's id (null where no other row of its component has one) but links as others
    do. A very long text is one set in one task. An empty table gives no rows. Sets are named by 64 bits. prefixes: candidates
    share shingles of corpus-wide prefixes instead of groups; the rows are the same.
    """
    return _components(docs, Threshold(num, den), size, local, prefixes).select("doc_id", "n_shingles", "component_id")


def _sids(column: pa.Array, size: int) -> pa.Array:
    return pa.array([set_id(s) for s in _words_of(column, size)], pa.int64())


def _rows_of_ids(docs: DataFrame, ids: DataFrame, about: DataFrame) -> DataFrame:
    """doc_id, text of the rows with these ids. Rows that repeat are one row: only ids of several rows are looked at for that,
    and tasks drop what they have twice before they send it, so other texts stay where they are."""
    rows = by_ids(docs, ids, "doc_id", "left_semi")
    counts = about.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    several = stage(counts.where("rows > 1").select("doc_id"), "several")
    if several.isEmpty():
        return rows
    return by_ids(rows, several, "doc_id", "left_anti").unionByName(by_ids(rows, several, "doc_id", "left_semi").distinct())


def _components(docs: DataFrame, threshold: Threshold, size: int, local: int, prefixes: bool) -> DataFrame:
    """jaccard_components with the sid of each row's set."""
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = docs.withColumn("component", F.lit(0).cast("bigint"))
    read = read_sets(texts, size, count=not prefixes)
    about = stage(documents_of(read), "documents")
    if prefixes:
        once = repeated_once(docs, REPEATED_BYTES)
        texts = texts if once is None else once.withColumn("component", F.lit(0).cast("bigint"))
        sent = send_prefixes(texts, total, size, threshold, _prefix_ranges(total, threshold))
    else:
        sent = send_keys(texts, frequent_shingles(read), size, threshold, _ranges(total, threshold))
    first = about.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.count("*").alias("copies"))
    named = first.withColumn("code", F.col("sid").bitwiseAND(F.lit(CODE))).join(candidate_components(sent), "code").select("sid", "doc_id", "n", F.col("root").alias("component"))
    named = stage(_with_sizes(stage(named, "candidates")), "candidates")

    def sid_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _sids(batch.column(1), size)], names=["doc_id", "text", "sid"])

    # A document's row is found by its id; the set id parts rows that share one. Sets without ids are found by theirs alone.
    made = "doc_id bigint, text string, sid bigint"
    wanted = _rows_of_ids(docs, named, about).mapInArrow(sid_of, made)
    kept = ["component", "sets", "weight", "sid", "n", "text"]
    members = wanted.join(named, ["doc_id", "sid"]).select(*kept)
    if not named.where("doc_id is null").isEmpty():
        texts = docs.where("doc_id is null").mapInArrow(sid_of, made).groupBy("sid").agg(F.first("text").alias("text"))
        members = members.unionByName(texts.join(named.where("doc_id is null"), "sid").select(*kept))
    small, links = [members.where(F.col("weight") <= local)], None
    total = int(named.agg(F.sum("n")).first()[0] or 0)
    if not named.where(F.col("weight") > local).isEmpty():
        large = stage(members.where(F.col("weight") > local).dropDuplicates(["component", "sid"]).select("component", "sid", "n", "text"), "members")
        done, rest = _keyed_again(large, size, threshold, local, prefixes)
        small += done
        if rest is not None:
            links = _large_links(rest, size, threshold)
    for part in small:
        found = _local_links(part, total, size, threshold)
        links = found if links is None else links.unionByName(found)
    roots = stage(connected_components(links).withColumnRenamed("node", "sid"), "roots")
    # Each set that links or has copies gets its component's smallest id; the root and a set with many copies are keys of many rows.
    labelled = stage(first.join(roots, "sid", "left").where("root is not null or copies > 1").select("sid", F.coalesce("root", "sid").alias("root"), "doc_id"), "labels")
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = join_frequent(labelled.select("sid", "root"), least, "root").select("sid", "component_id")
    joined = join_frequent(about, labels, "sid")
    return joined.select("doc_id", "sid", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def distinct_documents(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without rows that a smaller doc_id of their component stands for. Rows that share a doc_id are each judged by their
    own text, and both stay if they are of one component; rows of a null doc_id stay; documents without words stay."""
    rows = _components(docs, Threshold(num, den), size, LOCAL, True)
    gone = stage(rows.where("doc_id <> component_id").select("doc_id", "sid").distinct(), "gone")
    # Ids of which some rows go and others stay: there the texts decide, elsewhere the ids alone.
    parted = stage(by_ids(rows, gone, "doc_id", "left_semi").where("doc_id = component_id").select("doc_id").distinct(), "parted")
    kept = by_ids(docs, gone, "doc_id", "left_anti").select(*docs.columns)
    if parted.isEmpty():
        return kept
    sid = free_name(docs, "sid")
    sid_of = F.pandas_udf(lambda texts: _sids(pa.Array.from_pandas(texts, type=pa.string()), size).to_pandas(), "bigint")
    some = by_ids(docs, parted, "doc_id", "left_semi").withColumn(sid, sid_of("text"))
    left = some.join(gone.withColumnRenamed("sid", sid), ["doc_id", sid], "left_anti")
    return kept.unionByName(left.select(*docs.columns))
