"""Corpus-wide totals of keys that blocks of rows count, answered to each block for its own keys.

A block sends its distinct 64-bit keys with their counts, cut into ranges of the key space; a range sums what all blocks sent
and answers each block with the totals of its keys, in the block's order. So a key that every text holds costs a range one
entry per block, and a block gets exactly what it asked for. Keys and counts travel packed: sorted differences, compressed.

Ranges grow in number with the corpus, not in size. More than `wide` of them are reached in two levels: blocks send to spans
of ranges, and a shelf of blocks sums what its blocks sent to a span before it deals that to the ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64

#: Ranges that blocks send to directly; blocks of a shelf.
WIDE, SHELF = 2048, 1024
SENT = "range int, block bigint, keys binary, counts binary"
ANSWER = "block bigint, range int, totals binary, extra binary"
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def pack_counts(values: np.ndarray) -> bytes:
    """Numbers of 0 and more in any order, byte plane by byte plane."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = max((k + 1 for k in range(8) if planes[k].any()), default=0)
    return bytes([used]) + np.uint32(len(values)).tobytes() + pa.compress(np.ascontiguousarray(planes[:used]).tobytes(), codec="zstd", asbytes=True)


def unpack_counts(packed: bytes) -> np.ndarray:
    used, n = packed[0], int(np.frombuffer(packed, "<u4", 1, 1)[0])
    planes = np.zeros((8, n), np.uint8)
    if used and n:
        planes[:used] = np.frombuffer(pa.decompress(packed[5:], decompressed_size=used * n, codec="zstd", asbytes=True), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Distinct keys in order: the first, and the differences byte plane by byte plane, each plane compressed by itself."""
    gaps = np.diff(keys).astype("<u8").view(np.uint8).reshape(-1, 8).T
    planes = [pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True) if x.any() else b"" for x in gaps]
    return np.uint32(len(keys)).tobytes() + keys[:1].astype("<u8").tobytes() + np.array([len(x) for x in planes], "<u4").tobytes() + b"".join(planes)


def unpack_keys(packed: bytes) -> np.ndarray:
    n = int(np.frombuffer(packed, "<u4", 1)[0])
    if not n:
        return np.zeros(0, U64)
    sizes, at = np.frombuffer(packed, "<u4", 8, 12).tolist(), 44
    planes = np.zeros((8, n), np.uint8)
    for k, size in enumerate(sizes):
        if size:
            planes[k, 1:] = np.frombuffer(pa.decompress(packed[at : at + size], decompressed_size=n - 1, codec="zstd", asbytes=True), np.uint8)
        at += size
    steps = np.ascontiguousarray(planes.T).view("<u8").ravel()
    steps[0] = np.frombuffer(packed, "<u8", 1, 4)[0]
    return np.cumsum(steps)


def rows_of(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], _KINDS[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, for each value its number among them, how often each is there)."""
    order = np.argsort(values, kind="stable")
    own = values[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    number = np.empty(len(own), np.int64)
    number[order] = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    return own[begin], number, np.diff(np.append(begin, len(own)))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, their sums, for each key its number among them)."""
    own, number, _ = distinct(keys)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, number, counts)
    return own, total, number


class Spread:
    """Which range, and which span of ranges, a key belongs to. `of` gives the numbers that are dealt out, by default the keys."""

    def __init__(self, ranges: int, wide: int = WIDE, shelf: int = SHELF, of: Callable[[np.ndarray], np.ndarray] | None = None):
        self.ranges, self.shelf, self.width, self.of = ranges, shelf, 1 if ranges <= wide else int(np.sqrt(ranges)), of
        self.spans = -(-ranges // self.width)

    def range_of(self, keys: np.ndarray) -> np.ndarray:
        return ((self.of(keys) if self.of else keys) % U64(self.ranges)).astype(np.int64)

    def parts(self, keys: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the part of so many ranges, places of its keys in their order), of every part that has any."""
        part = self.range_of(keys) // width
        order = np.argsort(part, kind="stable")
        held, begin = np.unique(part[order], return_index=True)
        for k, at in zip(held.tolist(), np.split(order, begin[1:]) if len(held) else []):
            yield k, at

    def send(self, block: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
        """Rows of SENT for a block's distinct keys in order."""
        return [(k, block, pack_keys(keys[at]), pack_counts(counts[at])) for k, at in self.parts(keys, self.width)]

    def receive(self, keys: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
        """Totals of a block's distinct keys in order, and what `extra` gave for them."""
        said = {r: (t, x) for r, t, x in zip(*(answers.column(c).to_pylist() for c in ("range", "totals", "extra")))}
        total, extra = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k, at in self.parts(keys, self.width):
            total[at] = unpack_counts(said[k][0])
            if said[k][1]:
                extra[at] = unpack_counts(said[k][1])
        return total, extra


def _merged(sent: pa.Table) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(blocks, how many keys each sent, distinct keys, sums, number of each sent key)."""
    keys = [unpack_keys(x) for x in sent.column("keys").to_pylist()]
    counts = [unpack_counts(x) for x in sent.column("counts").to_pylist()]
    own, total, number = summed(np.concatenate(keys), np.concatenate(counts))
    return sent.column("block").to_pylist(), [len(k) for k in keys], own, total, number


def totals(sent: DataFrame, spread: Spread, extra: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, report: Callable[[np.ndarray, np.ndarray], tuple[int, ...]] | None = None) -> DataFrame:
    """ANSWER for each row of SENT. extra(keys, sums) of a range gives a number for each of its keys, which is answered too.
    report(keys, sums) gives numbers of a range itself, in a row of their own with a negative block."""

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        blocks, sizes, own, total, number = _merged(rows)
        more = extra(own, total) if extra else None
        out = []
        for block, at in zip(blocks, np.split(number, np.cumsum(sizes)[:-1])):
            out.append((block, key[0].as_py(), pack_counts(total[at]), pack_counts(more[at]) if extra else b""))
        if report:
            out.append((-1 - key[0].as_py(), key[0].as_py(), pack_counts(np.array(report(own, total))), b""))
        return rows_of(ANSWER, out)

    if spread.width == 1:
        return sent.groupBy("range").applyInArrow(merge, ANSWER)

    name = lambda key: key[0].as_py() * spread.spans + key[1].as_py()  # noqa: E731  # of a shelf and span, to a range

    def collect(key: tuple, rows: pa.Table) -> pa.Table:
        _, _, own, total, _ = _merged(rows)
        return rows_of(SENT, [(k, name(key), pack_keys(own[at]), pack_counts(total[at])) for k, at in spread.parts(own, 1)])

    def pass_on(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        blocks, sizes, own, _, number = _merged(rows)
        said = {r: (t, x) for r, t, x in zip(*(answers.column(c).to_pylist() for c in ("range", "totals", "extra")))}
        total, more = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for k, at in spread.parts(own, 1):
            total[at] = unpack_counts(said[k][0])
            if extra:
                more[at] = unpack_counts(said[k][1])
        return rows_of(ANSWER, [(block, key[1].as_py(), pack_counts(total[at]), pack_counts(more[at]) if extra else b"") for block, at in zip(blocks, np.split(number, np.cumsum(sizes)[:-1]))])

    by_shelf = sent.groupBy(F.expr(f"floor(block / {spread.shelf})").alias("shelf"), F.col("range").alias("span"))
    said = by_shelf.applyInArrow(lambda key, rows: collect(key, rows), SENT).groupBy("range").applyInArrow(merge, ANSWER)
    by_name = said.where("block >= 0").groupBy(F.expr(f"block div {spread.spans}").alias("shelf"), F.expr(f"cast(block % {spread.spans} as int)").alias("span"))
    out = by_shelf.cogroup(by_name).applyInArrow(lambda key, rows, answers: pass_on(key, rows, answers), ANSWER)
    return out.unionByName(said.where("block < 0")) if report else out
