"""Alignment of two tokenizers' tokens over a corpus, with each distinct text tokenised and aligned once.

Equal texts meet by a shuffle of the full texts and become one with a multiplicity. Each distinct text is encoded by both
tokenizers; byte offsets where tokens of both end cut it into groups. What is kept of it, in a written table, are its
measures and its distinct pairs of linked ids. Counts of pairs, in documents, are sums over the distinct texts weighted by
multiplicity; they go back to the texts, and the texts' measures to the rows by a digest of the text.

A text is cut into units before single spaces (those with a visible character behind and no space in front). Neither
tokenizer has a token over such a place: the byte-level one starts a piece there, and no piece of the other holds a word mark
after another character (checked). So tokens, groups and links of a unit are the same wherever it stands, and the distinct
units of a chunk of texts are encoded once.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MARK
from .shared import join_frequent, stage
from .substrings import pack, unpack
from .totals import SENT, Spread, pack_counts, rows_of, totals, unpack_counts
from .words import SPACED, U64, Words, chunks, mix, release_memory, utf8

#: Bytes of text in a chunk; entries of a range of pairs, on average.
CHUNK_BYTES, RANGE_ENTRIES = 3 << 20, 1 << 20
#: Bytes after a space before which a text is cut: visible ASCII, and first bytes of characters none of which is white space.
_VISIBLE = np.isin(np.arange(256), [*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)])

ALIGNED = "block bigint, texts binary, measures binary, digests binary, copies binary, pairs binary, weights binary, which binary, times binary, ends binary"
MEASURES = "key binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, the others
    for characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class _Side:
    """Ids of a batch of units, and the bytes of each id."""

    def __init__(self, of_id: list[bytes | None]):
        self.known = np.array([b is not None for b in of_id])
        self.size = np.array([len(b or b"") for b in of_id], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(b or b"" for b in of_id), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        return self.bytes[np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - size - self.at[ids], size)]


class ByteSide(_Side):
    """A byte-level tokenizer file; strings of its special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        names = {k: name for name, k in self.model.get_vocab().items()}
        table = _byte_level()
        super().__init__([bytes(table[c] for c in names[k]) if k in names and all(c in table for c in names[k]) else None for k in range(max(names) + 1)])

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(units, add_special_tokens=False)]


class PieceSide(_Side):
    """A SentencePiece model file, which puts a space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        of_id: list[bytes | None] = []
        for k in range(self.model.vocab_size()):
            text = self.model.id_to_piece(k)
            if self.model.is_byte(k):
                of_id.append(bytes([int(text[3:-1], 16)]))
            elif self.model.is_control(k) or self.model.is_unused(k) or self.model.is_unknown(k):
                of_id.append(None)
            else:
                of_id.append(text.replace(MARK.decode(), " ").encode())
                if MARK.decode() in text.lstrip(MARK.decode()):
                    raise ValueError("a piece holds a word mark after another character")
        super().__init__(of_id)

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode([x[1:] for x in units], num_threads=1)


_SIDES: dict[tuple, _Side] = {}


def _side(kind: type, path: str) -> _Side:
    """Loaded once in each Python worker."""
    if (kind, path) not in _SIDES:
        _SIDES[kind, path] = kind(path)
    return _SIDES[kind, path]


def _units(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Units of texts that begin with a space each."""
    space = data == 0x20
    begins = np.zeros(len(data), bool)
    begins[1:-1] = space[1:-1] & ~space[:-2] & _VISIBLE[data[2:]]
    begins[offsets[:-1]] = True
    start = np.flatnonzero(begins)
    return Words(data, SPACED[1], start, np.diff(np.append(start, len(data))), np.searchsorted(start, offsets))


class Aligned:
    """Distinct units: ids of both sides, groups and links. Of a unit that a side doesn't spell exactly nothing is kept."""

    def __init__(self, units: list[bytes], a: ByteSide, b: PieceSide):
        texts = [x.decode() for x in units]
        wanted, length = np.frombuffer(b"".join(units), np.uint8), np.array([len(x) for x in units], np.int64)
        self.good = np.ones(len(units), bool)
        ids, counts = [], []
        for side in (a, b):
            lists = side.encode(texts)
            n = np.array([len(x) for x in lists], np.int64)
            own = np.fromiter((k for x in lists for k in x), np.int64, int(n.sum()))
            owner = np.repeat(np.arange(len(units)), n)
            self.good[owner[~side.known[own]]] = False
            self.good &= np.bincount(owner, side.size[own], minlength=len(units)).astype(np.int64) == length
            same = np.repeat(self.good, length)
            keep = self.good[owner]
            differs = np.flatnonzero(same)[side.spelled(own[keep]) != wanted[same]]
            self.good[np.searchsorted(np.cumsum(length), differs, "right")] = False
            ids.append(own)
            counts.append(n)
        good = self.good
        ids = [x[np.repeat(good, n)] for x, n in zip(ids, counts)]
        self.n = [np.where(good, n, 0) for n in counts]
        ends = [np.cumsum(side.size[x]) for side, x in zip((a, b), ids)]
        mark = np.zeros(int(length[good].sum()) + 1, np.int8)
        for e in ends:
            mark[e] += 1
        cut = np.flatnonzero(mark == 2)
        group = [np.searchsorted(cut, e) for e in ends]
        in_group = [np.bincount(g, minlength=len(cut)) for g in group]
        bytes_to = np.cumsum(np.where(good, length, 0))
        self.n_groups = np.diff(np.searchsorted(cut, np.append(0, bytes_to), "right"))
        # Links: each A token with each B token of its group.
        per_a = in_group[1][group[0]]
        first_b = np.cumsum(in_group[1]) - in_group[1]
        left = np.repeat(ids[0], per_a)
        right = ids[1][np.arange(len(left)) - np.repeat(np.cumsum(per_a) - per_a - first_b[group[0]], per_a)]
        self.links = left.astype(U64) << U64(16) | right.astype(U64)
        owner_a = np.repeat(np.arange(len(units)), self.n[0])
        self.n_links = np.bincount(owner_a, per_a, minlength=len(units)).astype(np.int64)
        self.spelled = self._written(ids, group, np.repeat(np.arange(len(units)), self.n[1]), owner_a)

    @staticmethod
    def _written(ids: list[np.ndarray], group: list[np.ndarray], owner_b: np.ndarray, owner_a: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Groups as text, each with a semicolon behind, and the end of each unit's in it (as pairs of unit and end)."""
        token, side = np.concatenate(ids), np.repeat([0, 1], [len(x) for x in ids])
        groups, owner = np.concatenate(group), np.concatenate([owner_a, owner_b])
        order = np.lexsort((side, groups))
        token, side, groups, owner = token[order], side[order], groups[order], owner[order]
        last = np.ones(len(token), bool)
        last[:-1] = (groups[1:] != groups[:-1]) | (side[1:] != side[:-1])
        digits = 5
        shown, text = np.ones((len(token), digits + 1), bool), np.empty((len(token), digits + 1), np.uint8)
        for k in range(digits):
            power = 10 ** (digits - 1 - k)
            text[:, k] = token // power % 10 + 48
            shown[:, k] = (token >= power) | (power == 1)
        text[:, digits] = np.where(~last, ord(","), np.where(side == 0, ord("|"), ord(";")))
        return text[shown].tobytes(), np.bincount(owner, shown.sum(axis=1), minlength=int(owner.max()) + 1 if len(owner) else 0).astype(np.int64)


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, how often each is there)."""
    own = np.sort(values)
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    begin = np.flatnonzero(new)
    return own[begin], np.diff(np.append(begin, len(own)))


def _aligned_chunk(block: int, keys: list[bytes], copies: np.ndarray, data: np.ndarray, offsets: np.ndarray, a: ByteSide, b: PieceSide) -> tuple:
    """A row of ALIGNED for some distinct texts."""
    n = len(keys)
    spaced = np.full(len(data) + n, 0x20, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = data
    units = _units(spaced, offsets + np.arange(n + 1))
    one, two = units.hashes(11), units.hashes(12)
    _, at, which = np.unique(one, return_index=True, return_inverse=True)
    if (two[at][which] != two).any() or (units.length[at][which] != units.length).any():
        at = which = np.arange(len(one))  # two units share a hash: take each for itself
    raw = spaced.tobytes()
    made = Aligned([raw[s : s + k] for s, k in zip(units.start[at].tolist(), units.length[at].tolist())], a, b)
    owner = units.owner()
    good = np.ones(n, bool)
    good[owner[~made.good[which]]] = False
    total = lambda x: np.where(good, np.bincount(owner, x[which], minlength=n).astype(np.int64), 0)
    measures = np.concatenate([total(x) for x in (*made.n, made.n_groups, made.n_links)])
    text, sizes = made.spelled
    ends = np.cumsum(sizes).tolist()
    parts = [text[e - s : e] for s, e in zip(sizes.tolist(), ends)] + [b""] * (len(at) - len(sizes))
    first, number, digests = units.first.tolist(), which.tolist(), []
    for k in range(n):
        digests.append(hashlib.sha256(b"".join([parts[u] for u in number[first[k] : first[k + 1]]])[:-1]).digest() if good[k] else b"\0" * 32)
    # Distinct pairs of each text with how often it has them, by way of its distinct units.
    pairs, _ = _unique(made.links)
    of_link, link_at = np.searchsorted(pairs, made.links), np.cumsum(made.n_links) - made.n_links
    keep = good[owner]
    text_unit, often = _unique(owner[keep] * len(at) + which[keep])
    unit = text_unit % len(at)
    size = made.n_links[unit]
    link = of_link[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - link_at[unit], size)]
    code = np.repeat(text_unit // len(at), size) * max(1, len(pairs)) + link
    order = np.argsort(code, kind="stable")
    code, often = code[order], np.repeat(often, size)[order]
    begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    times = np.add.reduceat(often, begin) if len(begin) else np.zeros(0, np.int64)
    owner, link = code[begin] // max(1, len(pairs)), code[begin] % max(1, len(pairs))
    weight = np.zeros(len(pairs), np.int64)
    np.add.at(weight, link, copies[owner])
    held = weight > 0  # pairs of texts that were left out are not counted
    link = (np.cumsum(held) - 1)[link]
    step = np.diff(link, prepend=0)
    ends = np.bincount(owner, minlength=n)
    heads = np.cumsum(ends)[ends > 0] - ends[ends > 0]
    step[heads] = link[heads]
    return block, b"".join(keys), pack_counts(measures), b"".join(digests), pack_counts(copies), pack(pairs[held]), pack_counts(weight[held]), pack_counts(step), pack_counts(times), pack_counts(ends)


def _pair_sums(own: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The highest sum among the pairs of the same A id, for each pair. Pairs are in order, so those of an id lie together."""
    a = own >> U64(16)
    begin = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    return np.repeat(np.maximum.reduceat(total, begin), np.diff(np.append(begin, len(a))))


def aligned_texts(texts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Rows of ALIGNED: one for each chunk of distinct texts (text, copies, key)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _side(ByteSide, byte_path), _side(PieceSide, piece_path)
        block = TaskContext.get().partitionId() << 20
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys, copies = batch.column("key").to_pylist(), batch.column("copies").to_numpy()
            for i, j in chunks(offsets, CHUNK_BYTES):
                row = _aligned_chunk(block, keys[i:j], copies[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], a, b)
                yield from rows_of(ALIGNED, [row]).to_batches()
                block += 1
            release_memory()

    return texts.select("text", "copies", "key").mapInArrow(align, ALIGNED)


def alignment_measures(aligned: DataFrame, entries: int) -> DataFrame:
    """MEASURES of each distinct text of the written chunks, which hold so many pairs in all."""
    spread = Spread(max(16, -(-entries // RANGE_ENTRIES)), of=lambda keys: mix(keys >> U64(16)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, weights in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "weights"))):
                yield from rows_of(SENT, spread.send(block, unpack(pairs), unpack_counts(weights))).to_batches()

    kinds = pa.schema([("key", pa.binary())] + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])

    def measure(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        count, highest = spread.receive(unpack(row["pairs"]), answers)
        n_a, n_b, n_groups, n_links = unpack_counts(row["measures"]).reshape(4, -1)
        step, times, ends = (unpack_counts(row[c]) for c in ("which", "times", "ends"))
        owner = np.repeat(np.arange(len(ends)), ends)
        begin = np.cumsum(ends) - ends
        link = np.cumsum(step)
        before = (link - step)[np.minimum(begin, max(0, len(link) - 1))] if len(link) else np.zeros(len(ends), np.int64)
        link -= np.repeat(before, ends)
        best = np.zeros(len(ends), np.int64)
        sums = np.zeros(len(ends), np.int64)
        np.add.at(best, owner, times * (count[link] == highest[link]))
        np.add.at(sums, owner, times * count[link])
        texts, digests = row["texts"], row["digests"]
        spelled = [digests[32 * k : 32 * k + 32].hex() if n else "" for k, n in enumerate(n_a.tolist())]
        return pa.table([pa.array([texts[32 * k : 32 * k + 32] for k in range(len(ends))], pa.binary()), *(pa.array(x) for x in (n_a, n_b, n_groups, n_links, best, sums)), pa.array(spelled, pa.string())], schema=kinds)

    sent = aligned.select("block", "pairs", "weights").mapInArrow(send, SENT)
    answers = totals(sent, spread, extra=_pair_sums)
    return aligned.drop("weights", "copies").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(measure, MEASURES)


def alignment_report(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """The contract's columns of op11: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    One row per row of docs, so repeated rows stay and count as documents of their own. Null and empty texts, and texts that
    a tokenizer doesn't spell exactly, have zeros and an empty groups_sha256, and link nothing. A text is one cell, however
    long; a unit without single spaces is encoded whole. Equal texts that are a large share of all rows are one row before
    the texts are shuffled, and get their measures by a broadcast of the frequent texts' rows. Columns of docs other than
    doc_id and text are ignored; an empty table gives no rows."""
    key = F.when(F.octet_length("text") > 0, F.unhex(F.sha2("text", 256)))
    texts = docs.where(F.octet_length("text") > 0).groupBy("text").agg(F.count("*").alias("copies")).withColumn("key", F.unhex(F.sha2("text", 256)))
    aligned = stage(aligned_texts(texts, byte_path, piece_path), "aligned")
    # The header of a packed column holds how many numbers it has, little-endian.
    header = F.hex(F.substring("pairs", 2, 4))
    entries = aligned.agg(F.sum(F.conv(F.concat(*[F.substring(header, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("bigint"))).first()[0] or 0
    measures = stage(alignment_measures(aligned, entries), "measures")
    rows = stage(docs.select("doc_id", key.alias("key")), "rows")
    out = join_frequent(rows, measures, "key")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return out.select("doc_id", *counts, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
