"""SentencePiece encoding and decoding with an Aho-Corasick automaton that drives a single-pass Viterbi search.

The automaton is built over the bytes of all pieces. A text is read once from left to right; at each position the
output links of the automaton's state name all pieces that end there, and each relaxes the best score of that position.
The segmentation of the highest total score wins (of equal ones the one whose last piece is longest, from the end on).
Characters that no piece covers cost `UNKNOWN_COST` below the lowest score and become byte pieces.

No piece holds a word mark after another character (checked), so the best segmentation of a text is that of its marked
words one by one: each distinct word of a batch is searched once, all of them in step, as numpy rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import U64, Words, byte_classes, chunks, release_memory, utf8

MARK = "▁".encode()
UNKNOWN_COST = 10.0
#: Vocabularies of merges give runs of marks a score below this. Such a piece counts 0.5 more than an unknown character.
LOWEST_SCORE = -1e8
#: Bytes of a word that is searched by itself.
LONG = 4096
#: Cells of a table of words that are searched in step.
CELLS = 200_000
#: Bytes of text, or ids, taken at once.
CHUNK_BYTES, CHUNK_IDS = 1 << 19, 1 << 18
_ANY = byte_classes(b"", lower=False)


def load_pieces(path: str) -> list[tuple[bytes, float, str]]:
    """(bytes, score, kind) of each id of a SentencePiece model file; kind is piece, byte, control or unknown."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for k in range(model.vocab_size()):
        text = model.id_to_piece(k)
        if model.is_byte(k):
            out.append((bytes([int(text[3:-1], 16)]), 0.0, "byte"))
        elif model.is_control(k) or model.is_unused(k):
            out.append((b"", 0.0, "control"))
        elif model.is_unknown(k):
            out.append((b"", 0.0, "unknown"))
        else:
            out.append((text.encode(), model.get_score(k), "piece"))
    return out


class Vocabulary:
    """Bytes of the pieces, for decoding."""

    def __init__(self, pieces: list[tuple[bytes, float, str]]):
        plain = [b.replace(MARK, b" ") if kind == "piece" else b for b, _, kind in pieces]
        self.size = np.array([len(b) for b in plain])
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(plain), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Texts of the id lists."""
        out = []
        for i, j in chunks(offsets, CHUNK_IDS):
            own = ids[offsets[i] : offsets[j]]
            size = self.size[own]
            end = np.cumsum(size)
            take = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - size, size) + np.repeat(self.at[own], size)
            data = self.bytes[take].tobytes()
            at = np.append(0, end)[offsets[i : j + 1] - offsets[i]]
            out += [data[s + 1 : e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
        return out


class Automaton:
    """Transitions completed over failure links, the longest piece that ends in each state, and the next output link.

    Transitions are a table with a row for each state that a longer piece goes on from; other states move as the state that
    their failure link names, and share its row."""

    def __init__(self, pieces: list[tuple[bytes, float, str]]):
        self.pieces, self._sequences = pieces, None
        self.score = np.array([s for _, s, _ in pieces], np.float64)
        usable = [k for k, (b, s, kind) in enumerate(pieces) if kind == "piece" and b]
        if any(MARK in pieces[k][0].lstrip(MARK) or (MARK in pieces[k][0] and not pieces[k][0].startswith(MARK)) for k in usable):
            raise ValueError("a piece holds a word mark after another character")
        self.length = np.array([len(b) for b, _, _ in pieces], np.int64)
        self.byte_id = np.zeros(256, np.int32)
        for k, (b, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_id[b[0]] = k
        self.byte_id[0xFE] = self.byte_id[MARK[0]]  # how `_marked` writes a mark character of the text itself
        self.unknown = float(min((self.score[k] for k in usable if self.score[k] > LOWEST_SCORE), default=0.0) - UNKNOWN_COST)
        self.score[self.score <= LOWEST_SCORE] = self.unknown + 0.5
        child: dict[int, int] = {}
        ends, depth = [-1], [0]
        for k in usable:
            node = 0
            for byte in pieces[k][0]:
                edge = node << 8 | byte
                node = child.setdefault(edge, len(ends))
                if node == len(ends):
                    ends.append(-1)
                    depth.append(depth[edge >> 8] + 1)
            if ends[node] < 0 or self.score[k] > self.score[ends[node]]:
                ends[node] = k
        n = len(ends)
        edge, node = np.fromiter(child.keys(), np.int64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        del child
        source, byte = edge >> 8, edge & 255
        #: The row of each state in `goto`; 0 is the root's.
        self.row = np.full(n, -1, np.int32)
        inner = np.unique(np.append(0, source))
        self.row[inner] = np.arange(len(inner))
        self.goto = np.zeros((len(inner), 256), np.int32)
        fail = np.zeros(n, np.int32)
        self.ends = np.array(ends, np.int32)
        #: The state itself or the nearest one along failure links where a piece ends; 0 is none.
        self.output = np.zeros(n, np.int32)
        self.next_output = np.zeros(n, np.int32)
        level_of = np.array(depth)
        for level in range(int(level_of.max()) + 1):
            own = np.flatnonzero(level_of == level)
            if level:
                self.next_output[own] = self.output[fail[own]]
                self.output[own] = np.where(self.ends[own] >= 0, own, self.next_output[own])
                leaves = own[self.row[own] < 0]
                self.row[leaves] = self.row[fail[leaves]]
                going = np.setdiff1d(own, leaves)
                self.goto[self.row[going]] = self.goto[self.row[fail[going]]]
                at = np.flatnonzero(level_of[source] == level)
                fail[node[at]] = self.goto[self.row[fail[source[at]]], byte[at]]
            else:
                at = np.flatnonzero(source == 0)
            self.goto[self.row[source[at]], byte[at]] = node[at]

    def best(self, texts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts as rows of bytes (padded). Ids of all rows one after the other, and how many each row has."""
        n, most = texts.shape
        score = np.full((n, most + 1), -np.inf)
        score[:, 0] = 0
        back = np.zeros((n, most + 1), np.int32)  # id of the last piece, or -1 for an unknown character
        state = np.zeros(n, np.int32)
        char_start = np.zeros(n, np.int64)
        by_length = np.argsort(-length, kind="stable")
        alive_n = np.searchsorted(-length[by_length], -np.arange(1, most + 1), "right")
        for p in range(most):
            live = by_length[: alive_n[p]]
            byte = texts[live, p]
            lead = (byte & 0xC0) != 0x80
            char_start[live[lead]] = p
            state[live] = self.goto[self.row[state[live]], byte]
            # A whole character ends here: it may stand as unknown.
            following = np.where(p + 1 < length[live], texts[live, min(p + 1, most - 1)], 0)
            closing = live[(following & 0xC0) != 0x80]
            value = score[closing, char_start[closing]] + self.unknown
            score[closing, p + 1] = value
            back[closing, p + 1] = -1
            at = self.output[state[live]]
            rows = live
            while True:
                keep = at > 0
                rows, at = rows[keep], at[keep]
                if not len(rows):
                    break
                piece = self.ends[at]
                value = score[rows, p + 1 - self.length[piece]] + self.score[piece]
                better = value > score[rows, p + 1]
                score[rows[better], p + 1] = value[better]
                back[rows[better], p + 1] = piece[better]
                at = self.next_output[at]
        # Walk back from the ends, all rows in step.
        found_row, found_id, found_at = [], [], []
        at, rows = length.copy(), np.flatnonzero(length > 0)
        while len(rows):
            piece = back[rows, at[rows]]
            known = piece >= 0
            found_row.append(rows[known])
            found_id.append(piece[known])
            found_at.append(at[rows[known]])
            at[rows[known]] -= self.length[piece[known]]
            other = rows[~known]
            if len(other):
                begin = at[other] - 1
                while (deep := (texts[other, begin] & 0xC0) == 0x80).any():
                    begin[deep] -= 1
                for k in range(4):
                    inside = begin + k < at[other]
                    found_row.append(other[inside])
                    found_id.append(self.byte_id[texts[other[inside], begin[inside] + k]])
                    found_at.append(begin[inside] + k + 1)
                at[other] = begin
            rows = rows[at[rows] > 0]
        if not found_row:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        row, ids, place = (np.concatenate(x) for x in (found_row, found_id, found_at))
        order = np.lexsort((place, row))
        return ids[order].astype(np.int32), np.bincount(row, minlength=n)

    def best_of_long(self, word: bytes) -> list[int]:
        """Ids of one long word, as `best` gives them, in a plain loop over its bytes: no row of a table is as wide as the word."""
        goto, row, ends, output, onward, length, score_of = self._plain()
        score, back, state, start = [0.0] + [0.0] * len(word), [0] * (len(word) + 1), 0, 0
        for p, byte in enumerate(word):
            if byte & 0xC0 != 0x80:
                start = p
            state = goto[row[state] << 8 | byte]
            best, piece = -np.inf, 0
            if p + 1 == len(word) or word[p + 1] & 0xC0 != 0x80:
                best, piece = score[start] + self.unknown, -1
            at = output[state]
            while at > 0:
                k = ends[at]
                value = score[p + 1 - length[k]] + score_of[k]
                if value > best:
                    best, piece = value, k
                at = onward[at]
            score[p + 1], back[p + 1] = best, piece
        out, at = [], len(word)
        while at > 0:
            if back[at] >= 0:
                out.append(back[at])
                at -= length[back[at]]
                continue
            begin = at - 1
            while word[begin] & 0xC0 == 0x80:
                begin -= 1
            out += [int(self.byte_id[x]) for x in reversed(word[begin:at])]
            at = begin
        return out[::-1]

    def _plain(self) -> tuple:
        """The automaton as plain sequences, made when the first long word comes."""
        if self._sequences is None:
            view = lambda x: memoryview(np.ascontiguousarray(x).ravel())
            self._sequences = (view(self.goto), view(self.row), view(self.ends), view(self.output), view(self.next_output), self.length.tolist(), self.score.tolist())
        return self._sequences

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, len + 1 offsets)."""
        marked, firsts = _marked(data, offsets)
        # A word begins at a mark that follows no mark, and at the start of a text.
        is_mark = marked == 0xFF
        begins = np.zeros(len(marked), bool)
        begins[1:] = is_mark[1:] & ~is_mark[:-1]
        begins[firsts[:-1][np.diff(firsts) > 0]] = True
        start = np.flatnonzero(begins)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        length = np.diff(np.append(start, len(marked)))
        held = Words(marked, _ANY[1], start, length, np.searchsorted(start, firsts))
        one, two = held.hashes(11), held.hashes(12)
        _, at, which = np.unique(one, return_index=True, return_inverse=True)
        if (two[at][which] != two).any() or (length[at][which] != length).any():
            at = which = np.arange(len(start))
        ids, counts = self._words(marked, start[at], length[at])
        from_id = np.cumsum(counts) - counts
        n = counts[which]
        total = np.cumsum(n)
        take = np.arange(int(total[-1])) - np.repeat(total - n, n) + np.repeat(from_id[which], n)
        return ids[take], np.append(0, total)[held.first]

    def _words(self, marked: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in the given order. Words of like length are searched together, in bounded tables."""
        marks = np.append(0, np.cumsum(marked == 0xFF))
        real = length + 2 * (marks[start + length] - marks[start])
        order = np.argsort(real, kind="stable")
        by_size = real[order]
        parts, counts, i = [], np.zeros(len(start), np.int64), 0
        while i < len(order):
            j = i + 1
            if by_size[i] > LONG:
                own = marked[start[order[i]] : start[order[i]] + length[order[i]]].tobytes().replace(b"\xff", MARK)
                ids = self.best_of_long(own)
                parts.append(np.array(ids, np.int32))
                counts[order[i]] = len(ids)
                i = j
                continue
            wide = int(np.searchsorted(by_size, by_size[i] * 1.25 + 2, "right"))
            j = max(j, min(wide, i + CELLS // int(by_size[wide - 1])))
            rows = order[i:j]
            most = int(real[rows].max())
            table = np.zeros((len(rows), most), np.uint8)
            own = np.repeat(np.arange(len(rows)), length[rows])
            at = np.arange(len(own)) - np.repeat(np.cumsum(length[rows]) - length[rows], length[rows]) + np.repeat(start[rows], length[rows])
            byte = marked[at]
            size = np.where(byte == 0xFF, 3, 1)
            place = np.cumsum(size) - size
            place -= np.repeat(place[np.cumsum(length[rows]) - length[rows]], length[rows])
            table[own, place] = np.where(byte == 0xFF, MARK[0], byte)
            mark = byte == 0xFF
            table[own[mark], place[mark] + 1] = MARK[1]
            table[own[mark], place[mark] + 2] = MARK[2]
            # A mark character of the text itself is no word mark: 0xFE stands for its first byte, so no piece matches it.
            ids, n = self.best(table, real[rows].astype(np.int64))
            parts.append(ids)
            counts[rows] = n
            i = j
        ids = np.concatenate(parts)
        at = np.zeros(len(start), np.int64)
        at[order] = np.cumsum(counts[order]) - counts[order]
        total = np.cumsum(counts)
        return ids[np.arange(int(total[-1])) - np.repeat(total - counts, counts) + np.repeat(at, counts)], counts


def _marked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with one byte 0xFF before each that isn't empty and for each space, and the first byte of a mark character of
    the text as 0xFE (UTF-8 has neither byte)."""
    size = np.diff(offsets)
    some = (size > 0).astype(np.int64)
    firsts = np.append(0, np.cumsum(size + some))
    out = np.full(int(firsts[-1]), 0xFF, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(some), size)] = np.where(data == 0x20, 0xFF, data)
    if len(out) > 2:
        own = np.flatnonzero((out[:-2] == MARK[0]) & (out[1:-1] == MARK[1]) & (out[2:] == MARK[2]))
        out[own] = 0xFE
    return out, firsts


_BUILT: dict[tuple, Automaton | Vocabulary] = {}


def _digest(pieces: list[tuple[bytes, float, str]]) -> str:
    """Of all pieces, so that vocabularies that differ anywhere have different ones."""
    return hashlib.sha256(repr(pieces).encode()).hexdigest()


def _built(kind: type, pieces: list[tuple[bytes, float, str]], digest: str) -> Automaton | Vocabulary:
    """Built once in each Python worker."""
    key = kind, digest
    if key not in _BUILT:
        if len(_BUILT) > 3:
            _BUILT.clear()
        _BUILT[key] = kind(pieces)
    return _BUILT[key]


def _encoded(automaton: Automaton, column: pa.Array) -> pa.ListArray:
    data, offsets = utf8(column)
    parts, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for i, j in chunks(offsets, CHUNK_BYTES):
        ids, at = automaton.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append(ids)
        ends.append(at[1:] + ends[-1][-1])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(parts), pa.int32()), mask=column.is_null() if column.null_count else None)


def _decoded(vocabulary: Vocabulary, column: pa.Array) -> pa.Array:
    size = np.array(column.value_lengths().fill_null(0), np.int64)
    out = vocabulary.decode(column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size)))
    mask = np.array(column.is_null())
    return pa.array([None if null else b.decode("utf-8", "replace") for b, null in zip(out, mask)], pa.string())


def encoder(pieces: list[tuple[bytes, float, str]]):
    """Column function: text to array<int> of piece ids. Null gives null, an empty text no ids."""
    digest = _digest(pieces)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield _encoded(_built(Automaton, pieces, digest), column)
            release_memory()

    return encode_pieces


def decoder(pieces: list[tuple[bytes, float, str]]):
    """Column function: array<int> of piece ids to text. Null gives null; bytes that are no UTF-8 become U+FFFD."""
    digest = _digest(pieces)

    @F.arrow_udf(T.StringType())
    def decode_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield _decoded(_built(Vocabulary, pieces, digest), column)

    return decode_pieces


def both_ways(pieces: list[tuple[bytes, float, str]]):
    """Column function: text to its piece_ids and the text decoded from them, in one step; null gives nulls."""
    digest = _digest(pieces)
    kind = pa.struct([("piece_ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    @F.arrow_udf(T.StructType().add("piece_ids", T.ArrayType(T.IntegerType())).add("decoded", "string"))
    def encode_and_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            ids = _encoded(_built(Automaton, pieces, digest), column)
            yield pa.StructArray.from_arrays([ids, _decoded(_built(Vocabulary, pieces, digest), ids)], fields=list(kind))
            release_memory()

    return encode_and_decode


def tokenized(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with piece_ids (array<int>) and n_tokens; columns of these names are replaced, all others kept.

    Null texts have null ids and 0 tokens, empty texts no ids and 0 tokens; a very long text is encoded whole; repeated rows
    get equal ids; an empty table gives no rows."""
    out = docs.withColumn("piece_ids", encoder(load_pieces(model_path))("text"))
    return out.withColumn("n_tokens", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("bigint"))


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_sha256 (of comma-joined ids), decoded_sha256 (of the decoded text) and exact (text equals its decoded ids).

    Columns of docs other than doc_id and text are ignored. Null texts count as empty in the digests and are exact; one row
    per row of docs, so repeated rows stay and an empty table gives none."""
    made = docs.select("doc_id", "text", both_ways(load_pieces(model_path))("text").alias("made")).select("doc_id", "text", "made.*")
    return made.select(
        "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_chars"), F.coalesce(F.size("piece_ids"), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.coalesce("piece_ids", F.array().cast("array<int>")), ","), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"), F.col("text").eqNullSafe(F.col("decoded")).alias("exact"),
    )
