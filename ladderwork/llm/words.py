"""Words of Arrow text columns as numpy arrays: positions, owners and hashes, without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text bytes taken at once; temporaries are about 40 times as large.
CHUNK_BYTES = 1 << 20


@lru_cache(maxsize=1)
def _libc():
    """The process itself, whose symbols include the allocator's."""
    try:
        return ctypes.CDLL(None)
    except (OSError, TypeError):
        return None


def release_memory() -> None:
    """Gives freed memory back to the system: a Python worker lives on from task to task, beside others."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_MULTIPLIERS: dict[int, np.ndarray] = {}


def _multipliers(n: int, seed: int) -> np.ndarray:
    held = _MULTIPLIERS.get(seed)
    if held is None or len(held) < n:
        held = multipliers(max(n, 256), seed)
        if len(held) <= 1 << 20:
            _MULTIPLIERS[seed] = held
    return held[:n]


def byte_classes(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, value of the byte) for each byte; lower maps A-Z only."""
    word = np.ones(256, dtype=bool)
    word[list(separators)] = False
    value = np.arange(256, dtype=np.uint8)
    if lower:
        value[65:91] += 32
    return word, value


#: Words of letters, digits and all that is not ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = byte_classes(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90)), lower=True)
#: Words between ASCII white space: [^\x20\x09-\x0D]+.
SPACED = byte_classes(b"\x20\x09\x0a\x0b\x0c\x0d", lower=False)
SPACED_LOWER = byte_classes(b"\x20\x09\x0a\x0b\x0c\x0d", lower=True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and len + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    data: np.ndarray  #: bytes of the chunk
    value: np.ndarray  #: the class's byte values (lower-casing)
    start: np.ndarray  #: of each word, in data
    length: np.ndarray
    first: np.ndarray  #: number of the first word of each document, and at the end the number of all

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int, which: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of all words, or of those numbered. Two seeds give independent hashes."""
        start, length = (self.start, self.length) if which is None else (self.start[which], self.length[which])
        if not len(start):
            return np.zeros(0, U64)
        base = np.cumsum(length) - length
        at = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(base, length)
        coefficient = _multipliers(int(length.max()), seed)[at]
        at += np.repeat(start, length)
        coefficient *= self.value[self.data[at]].astype(U64) + U64(1)
        return mix(np.add.reduceat(coefficient, base))


def words(data: np.ndarray, offsets: np.ndarray, classes: tuple[np.ndarray, np.ndarray]) -> Words:
    """The words of each document; none runs over the end of a document."""
    is_word, value = classes
    inside = is_word[data]
    n = len(data)
    edges = np.zeros(n + 1, dtype=bool)
    edges[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edges[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edges[1:n]
    start = np.flatnonzero(begins)
    return Words(data, value, start, np.flatnonzero(ends) + 1 - start, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, first: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its first word) of each run of `size` words inside a document."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes))
    at = np.flatnonzero(left[:n] >= size)
    coefficient = multipliers(size, seed)
    total = np.zeros(n, U64)
    for k in range(size):
        total += hashes[k : k + n] * coefficient[k]
    return mix(total[at]), at


def joined(found: Words, which: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The words numbered, joined by one space, as one text for each two neighbouring bounds (places in `which`)."""
    size = found.length[which] + 1
    end = np.cumsum(size)
    at = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - size - found.start[which], size)
    text = found.data[np.minimum(at, max(len(found.data) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
    text[end - 1] = 0x20
    edges, raw = np.append(0, end)[bounds], text.tobytes()
    return [raw[s : max(s, e - 1)] for s, e in zip(edges[:-1].tolist(), edges[1:].tolist())]


def texts(values: list[bytes], mask: np.ndarray | None = None) -> pa.Array:
    return pa.array(values, pa.binary(), mask=mask).cast(pa.string())
