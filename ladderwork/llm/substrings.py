"""Substring deduplication with a count-min prefilter.

Windows of consecutive words are counted over the whole corpus without moving the text more than once:

1. Texts are dealt to blocks by a hash. Each block makes partial count-min sketches of its windows' hashes; the sketch is
   cut into ranges of the hash space, and a block sends each range's counters (sorted distinct cells, packed) to it.
2. A range sums the blocks' sketches and answers each block with one bit per window it sent: estimated repeated or not.
   Estimates are never too low, so no repeated window is lost.
3. A block sends only windows estimated repeated, with 128-bit hashes and places, again one entry per distinct window,
   so a window that a third of all documents hold costs a range one entry per block. A range groups them exactly and
   answers with the places of those that really repeat.
4. Each block removes the words that repeated windows cover.

Ranges and blocks grow in number with the corpus, not in size. So that a block's row for a range doesn't shrink, more than
WIDE ranges are reached in two levels: a block sends to spans of ranges, and a shelf of blocks that has one span of all of
them merges what they sent, deals it to the ranges, and deals the answers to its blocks. The dealt texts are one exchange
that all three passes read.
Rows that repeat so often that they would fill a block are dealt twice, which makes all of their windows repeated, and what is left
of one of the two is given to all of them.
A block's rows arrive in any order, and in another one in each pass, so passes that name or use places sort them first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import repeated_once
from .words import SPACED, U64, chunks, mix, utf8, windows, words

#: Bytes of text in a block and windows in a range, on average.
BLOCK_BYTES, RANGE_WINDOWS = 6 << 20, 3 << 20
#: Rows that repeat are dealt twice if they have together more bytes than this, half a block.
REPEATED_BYTES = BLOCK_BYTES // 2
#: Cells of each of the sketch's two rows for each window.
CELLS = 4
#: Ranges that blocks send to directly; blocks of a shelf.
WIDE, SHELF = 2048, 1024


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as compressed differences, byte plane by byte plane."""
    gaps = np.diff(sorted_values, prepend=sorted_values[:1] * 0).astype("<u8")
    planes = gaps.view(np.uint8).reshape(-1, 8).T
    used = max((k + 1 for k in range(8) if planes[k].any()), default=0)
    return bytes([used]) + np.uint32(len(gaps)).tobytes() + pa.compress(np.ascontiguousarray(planes[:used]).tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    used, n = packed[0], int(np.frombuffer(packed, "<u4", 1, 1)[0])
    planes = np.zeros((8, n), np.uint8)
    if used and n:
        raw = pa.decompress(packed[5:], decompressed_size=used * n, codec="zstd", asbytes=True)
        planes[:used] = np.frombuffer(raw, np.uint8).reshape(used, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel())


def _block_windows(columns: list[pa.Array], size: int) -> Iterator[tuple]:
    """For each chunk of a block's texts: (first row, words, window hashes, second hash maker, numbers of first words)."""
    data, offsets = utf8(columns)
    for i, j in chunks(offsets):
        found = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACED)
        yield i, j, found


def _hashed(text: pa.Array, size: int, seeds: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(window hashes for each seed, place of each window's first word in the block, words of each text)."""
    hashes: list[list[np.ndarray]] = [[] for _ in seeds]
    places, counts, base = [], [], 0
    for _, _, found in _block_windows(text, size):
        for k, seed in enumerate(seeds):
            h, at = windows(found.hashes(seed), found.first, size, seed)
            hashes[k].append(h)
        places.append(at + base)
        counts.append(found.counts)
        base += int(found.first[-1])
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return [join(h, U64) for h in hashes], join(places, np.int64), join(counts, np.int64)


class _Sketch:
    """Where a window's hash is counted: a span of ranges, a range in it, and there a cell in each of two rows. A span is one
    range where blocks send to ranges directly."""

    def __init__(self, ranges: int, cells: int, width: int = 1):
        self.ranges, self.cells, self.width, self.spans = ranges, cells, width, -(-ranges // width)

    def range_of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> U64(32)) % U64(self.ranges)).astype(np.int64)

    def rows(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the hashes, numbered over the ranges of their span."""
        first = (self.range_of(h) % self.width).astype(U64) * U64(self.cells)
        return first + mix(h ^ U64(0xA5A5)) % U64(self.cells), first + mix(h ^ U64(0x5A5A5A)) % U64(self.cells)

    def by_span(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(span, numbers of its hashes), of every span that has any."""
        r = self.range_of(h) // self.width
        order = np.argsort(r.astype(np.uint16 if self.spans < 65536 else np.int64), kind="stable")
        bounds = np.searchsorted(r[order], np.arange(self.spans + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            yield int(k), order[bounds[k] : bounds[k + 1]]

    def parts(self, sorted_values: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, slice]]:
        """(range in its span, places of its values) where `of` names the range of each of the values, in order."""
        bounds = np.searchsorted(of, np.arange(self.width + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            yield int(k), slice(bounds[k], bounds[k + 1])


def _in_order(block: pa.Table) -> pa.Table:
    """A block's rows by doc_id and text. Rows equal in both are alike, so each word has the same place in every pass."""
    return block.sort_by([("doc_id", "ascending"), ("text", "ascending")])


SENT = "range int, block bigint, once_a binary, more_a binary, once_b binary, more_b binary"
ANSWER = "block bigint, range int, bits_a binary, bits_b binary"
ASKED = "range int, block bigint, known boolean, one binary, two binary, place binary, several binary"
PLACES = "block bigint, places binary"


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _counted(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, whether they are in more than one list)."""
    value, n = np.unique(np.concatenate(lists), return_counts=True) if lists else (np.zeros(0, U64), np.zeros(0, np.int64))
    return value, n > 1


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by both hashes, whether a window in that order is the first of its kind)."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    return order, new


class _Shelf:
    """What the blocks of a shelf sent to a span, as one block's rows for each of its ranges, and answers taken back to the blocks."""

    def __init__(self, sketch: _Sketch):
        self.sketch = sketch

    def _cells(self, sent: pa.Table, row: str) -> tuple[np.ndarray, np.ndarray]:
        """Cells that the blocks name, and whether more than one window of theirs is in the cell."""
        more = [unpack(x) for x in sent.column(f"more_{row}").to_pylist()]
        value, several = _counted([unpack(x) for x in sent.column(f"once_{row}").to_pylist()] + more + more)
        return value, several

    def send(self, key: tuple, sent: pa.Table) -> pa.Table:
        width, cells = self.sketch.width, U64(self.sketch.cells)
        rows: dict[int, list[bytes]] = {}
        for n, row in enumerate("ab"):
            value, several = self._cells(sent, row)
            for r, at in self.sketch.parts(value, (value // cells).astype(np.int64)):
                own = value[at] % cells
                packed = rows.setdefault(r, [b"", b"", b"", b""])
                packed[2 * n : 2 * n + 2] = [pack(own[~several[at]]), pack(own[several[at]])]
        span, block = key[1].as_py(), key[0].as_py() * self.sketch.spans + key[1].as_py()
        return _rows(SENT, [(span * width + r, block, *packed) for r, packed in rows.items()])

    def answer(self, key: tuple, sent: pa.Table, answers: pa.Table) -> pa.Table:
        span, cells = key[1].as_py(), U64(self.sketch.cells)
        hot = []
        for row in "ab":
            value, several = self._cells(sent, row)
            said = dict(zip(answers.column("range").to_pylist(), answers.column(f"bits_{row}").to_pylist()))
            for r, at in self.sketch.parts(value, (value // cells).astype(np.int64)):
                own = several[at]
                own[~own] = np.unpackbits(np.frombuffer(said[span * self.sketch.width + r], np.uint8), count=int((~own).sum())).astype(bool)
            hot.append((value, several))
        out = []
        for block, *once in zip(*(sent.column(c).to_pylist() for c in ("block", "once_a", "once_b"))):
            bits = [np.packbits(several[np.searchsorted(value, unpack(x))]).tobytes() for x, (value, several) in zip(once, hot)]
            out.append((block, span, *bits))
        return _rows(ANSWER, out)

    def _windows(self, asked: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(blocks' rows, both hashes of their distinct windows by range, whether a window is in more than one place, and for each
        row the numbers of its windows)."""
        rows = [r for r in asked.to_pylist() if not r["known"]]
        one = np.concatenate([unpack(r["one"]) for r in rows] or [np.zeros(0, U64)])
        two = np.concatenate([np.frombuffer(r["two"], "<u8") for r in rows] or [np.zeros(0, U64)])
        n = [len(r["two"]) // 8 for r in rows]
        several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=k) for r, k in zip(rows, n)] or [np.zeros(0, np.uint8)]).astype(np.int64)
        order, new = _distinct(one, two)
        number = np.empty(len(one), np.int64)
        number[order] = np.cumsum(new) - 1
        one, two = one[order][new], two[order][new]
        total = np.bincount(number, 1 + several, minlength=len(one))
        by_range = np.argsort(self.sketch.range_of(one), kind="stable")
        place = np.empty(len(one), np.int64)
        place[by_range] = np.arange(len(one))
        return rows, one[by_range], two[by_range], (total > 1)[by_range], np.split(place[number], np.cumsum(n)[:-1]) if rows else []

    def ask(self, key: tuple, asked: pa.Table) -> pa.Table:
        span, block = key[1].as_py(), key[0].as_py() * self.sketch.spans + key[1].as_py()
        _, one, two, several, _ = self._windows(asked)
        out = []
        for r, at in self.sketch.parts(one, self.sketch.range_of(one) - span * self.sketch.width):
            out.append((span * self.sketch.width + r, block, False, pack(one[at]), two[at].tobytes(), np.arange(at.start, at.stop).astype("<u4").tobytes(), np.packbits(several[at]).tobytes()))
        return _rows(ASKED, out)

    def tell(self, key: tuple, asked: pa.Table, places: pa.Table) -> pa.Table:
        rows, _, _, told, numbers = self._windows(asked)
        for packed in places.column("places").to_pylist():
            told[unpack(packed).astype(np.int64)] = True
        out = [(r["block"], r["place"]) for r in asked.to_pylist() if r["known"]]
        for r, own in zip(rows, numbers):
            tell = told[own] & ~np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(own)).astype(bool)
            if tell.any():
                out.append((r["block"], pack(np.sort(np.frombuffer(r["place"], "<u4")[tell]).astype(np.uint64))))
        return _rows(PLACES, out)


def repeated_places(dealt: DataFrame, size: int, ranges: int, cells: int, wide: int = WIDE, shelf: int = SHELF) -> DataFrame:
    """Places (numbers of first words in the block) of windows whose words also start anywhere else. dealt: block, doc_id, text.
    Places count a block's words in the order of its rows by doc_id and text. More ranges than `wide` are reached through
    shelves of so many blocks."""
    sketch = _Sketch(ranges, cells, 1 if ranges <= wide else int(np.sqrt(ranges)))

    def send(key: tuple, block: pa.Table) -> pa.Table:
        (h,), _, _ = _hashed(block.column("text"), size, (1,))
        out = []
        for r, at in sketch.by_span(h):
            packed = []
            for row in sketch.rows(h[at]):
                cell, n = np.unique(row, return_counts=True)
                packed += [pack(cell[n == 1]), pack(cell[n > 1])]
            out.append((r, key[0].as_py(), *packed))
        return _rows(SENT, out)

    def merge(key: tuple, sent: pa.Table) -> pa.Table:
        cols = [sent.column(c).to_pylist() for c in ("block", "once_a", "more_a", "once_b", "more_b")]
        answers: list[list[bytes]] = []
        for once, more in ((cols[1], cols[2]), (cols[3], cols[4])):
            count = np.zeros(cells, np.uint8)
            for a, b in zip(once, more):
                a = unpack(a).astype(np.int64)
                count[a] = np.minimum(count[a] + 1, 2)
                count[unpack(b).astype(np.int64)] = 2
            answers.append([np.packbits(count[unpack(a).astype(np.int64)] > 1).tobytes() for a in once])
        return _rows(ANSWER, [(b, key[0].as_py(), x, y) for b, x, y in zip(cols[0], *answers)])

    def ask(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        (one, two), places, _ = _hashed(_in_order(block).column("text"), size, (1, 2))
        said = {r: (a, b) for r, a, b in zip(answers.column("range").to_pylist(), answers.column("bits_a").to_pylist(), answers.column("bits_b").to_pylist())}
        out, known = [], []
        for r, at in sketch.by_span(one):
            maybe = np.ones(len(at), bool)
            for row, bits in zip(sketch.rows(one[at]), said[r]):
                cell, back, n = np.unique(row, return_inverse=True, return_counts=True)
                hot = n > 1  # the block alone has counted two
                hot[~hot] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int((~hot).sum())).astype(bool)
                maybe &= hot[back]
            at = at[maybe]
            if not len(at):
                continue
            order, new = _distinct(one[at], two[at])
            at = at[order]
            group = np.cumsum(new) - 1
            several = np.bincount(group) > 1
            known.append(places[at[several[group]]])
            at = at[new]
            out.append((r, key[0].as_py(), False, pack(one[at]), two[at].tobytes(), places[at].astype("<u4").tobytes(), np.packbits(several).tobytes()))
        if known and len(found := np.sort(np.concatenate(known))):
            out.append((key[0].as_py() % sketch.spans, key[0].as_py(), True, b"", b"", pack(found), b""))
        return _rows(ASKED, out)

    def group(key: tuple, asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        out = [(r["block"], r["place"]) for r in rows if r["known"]]
        rows = [r for r in rows if not r["known"]]
        if rows:
            one = np.concatenate([unpack(r["one"]) for r in rows])
            two = np.concatenate([np.frombuffer(r["two"], "<u8") for r in rows])
            place = np.concatenate([np.frombuffer(r["place"], "<u4") for r in rows])
            n = np.array([len(r["two"]) // 8 for r in rows])
            several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=k) for r, k in zip(rows, n)]).astype(bool)
            owner = np.repeat(np.arange(len(rows)), n)
            order, new = _distinct(one, two)
            begin = np.flatnonzero(new)
            total = np.add.reduceat(1 + several[order].astype(np.int64), begin)
            tell = np.zeros(len(order), bool)
            tell[order] = np.repeat(total > 1, np.diff(np.append(begin, len(order))))
            tell &= ~several  # the block knows of those itself
            bounds = np.append(0, np.cumsum(n))
            for k, r in enumerate(rows):
                own = place[bounds[k] : bounds[k + 1]][tell[bounds[k] : bounds[k + 1]]]
                if len(own):
                    out.append((r["block"], pack(np.sort(own).astype(np.uint64))))
        return _rows(PLACES, out)

    sent = dealt.groupBy("block").applyInArrow(send, SENT)
    if sketch.width == 1:
        answers = sent.groupBy("range").applyInArrow(merge, ANSWER)
        asked = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, ASKED)
        return asked.groupBy("range").applyInArrow(group, PLACES)
    # A shelf's name to a range is its number and the span's in one.
    by_shelf = lambda rows: rows.groupBy(F.expr(f"block div {shelf}").alias("shelf"), F.col("range").alias("span"))
    named = lambda rows: rows.groupBy(F.expr(f"block div {sketch.spans}").alias("shelf"), F.expr(f"cast(block % {sketch.spans} as int)").alias("span"))
    shelves = _Shelf(sketch)
    answers = by_shelf(sent).applyInArrow(lambda key, rows: shelves.send(key, rows), SENT).groupBy("range").applyInArrow(merge, ANSWER)
    answers = by_shelf(sent).cogroup(named(answers)).applyInArrow(lambda key, rows, said: shelves.answer(key, rows, said), ANSWER)
    asked = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, ASKED)
    places = by_shelf(asked).applyInArrow(lambda key, rows: shelves.ask(key, rows), ASKED).groupBy("range").applyInArrow(group, PLACES)
    return by_shelf(asked).cogroup(named(places)).applyInArrow(lambda key, rows, said: shelves.tell(key, rows, said), PLACES)


def deduplicated(docs: DataFrame, size: int = 35) -> DataFrame:
    """Removes every word that is covered by a window of `size` words whose word sequence also starts anywhere else.

    docs: doc_id, text; other columns are ignored. Words are [^\\x20\\x09-\\x0D]+, unchanged; windows are judged on the
    input. One row per row of docs: doc_id, n_words, n_removed, kept (kept words joined by one space). Null and empty
    texts have no words and an empty `kept`; texts shorter than a window lose nothing; repeated rows repeat each other's
    windows; an empty table gives no rows.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(64, -(-total // BLOCK_BYTES))
    ranges = max(64, -(-(total // 6) // RANGE_WINDOWS))
    cells = max(1 << 12, CELLS * (total // 6) // ranges)
    docs = docs.select("doc_id", "text")
    once = repeated_once(docs, REPEATED_BYTES)
    counted = once is not None
    if counted:
        docs = once.withColumn("copies", F.explode(F.expr("if(copies > 1, array(copies, 0), array(copies))")))
    dealt = docs.select("*", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    places = repeated_places(dealt, size, ranges, cells)

    def remove(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        starts = [unpack(p).astype(np.int64) for p in answers.column("places").to_pylist()]
        starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        block = _in_order(block)
        n_words, n_removed, kept, base = [], [], [], 0
        for i, j, found in _block_windows(block.column("text"), size):
            n = int(found.first[-1])
            cover = np.zeros(n + size + 1, np.int32)
            own = starts[(starts >= base) & (starts < base + n)] - base
            np.add.at(cover, own, 1)
            np.add.at(cover, own + size, -1)
            gone = np.cumsum(cover)[:n] > 0
            base += n
            stay = np.flatnonzero(~gone)
            left = np.searchsorted(stay, found.first)
            n_words.append(found.counts)
            n_removed.append(found.counts - np.diff(left))
            # Kept words with one space after each, in one gather; a text's last space is dropped.
            size_of = found.length[stay] + 1
            end = np.cumsum(size_of)
            within = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - size_of, size_of)
            at = within + np.repeat(found.start[stay], size_of)
            text = found.data[np.minimum(at, max(len(found.data) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
            text[end - 1] = 0x20
            bounds = np.append(0, end)[left]
            raw = text.tobytes()
            kept += [raw[s : max(s, e - 1)] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        columns = [block.column("doc_id"), pa.array(join(n_words), pa.int64()), pa.array(join(n_removed), pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        copies = [block.column("copies")] if counted else []
        return pa.table(columns + copies, names=["doc_id", "n_words", "n_removed", "kept", "copies"][: len(columns + copies)])

    result = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    blocks_of = dealt.groupBy("block").cogroup(places.groupBy("block"))
    if not counted:
        return blocks_of.applyInArrow(remove, result)
    # The second of two dealt has no copies to speak for.
    spoken = blocks_of.applyInArrow(remove, result + ", copies bigint").where("copies > 0")
    return spoken.select("doc_id", "n_words", "n_removed", "kept", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("col")


def deduplicated_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op4."""
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
