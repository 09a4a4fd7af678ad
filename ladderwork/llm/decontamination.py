"""Benchmark decontamination with a positional inverted index that is sharded by document.

1. Test items are taken in blocks of a bounded number of words. The words of some blocks, bounded in number too, are a
   vocabulary, whose hashes go to the tasks.
2. One pass over the training texts for each vocabulary stores, shard by shard, the positions of its terms: `index`.
3. Document frequencies, summed over shards, order the terms of each test window from the rarest.
4. Each shard intersects the posting lists, offset-adjusted, from the rarest term on: `search`. Rows never leave
   their shard, so a passage that a third of all documents hold makes no large group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_ids, free_name, stage
from .words import ALNUM, chunks, utf8, words

#: Words of test items that one block, and so one broadcast, holds; distinct words of the blocks that one pass over the texts serves.
BLOCK_WORDS, PASS_WORDS = 250_000, 2_000_000
#: Words of training text in a shard.
SHARD_WORDS = 2_000_000
#: Candidates held at once while a shard is searched.
CANDIDATES = 2_000_000

INDEX = "doc_id array<bigint>, n_words array<bigint>, origin array<bigint>, term array<int>, df array<bigint>, position array<int>"


@dataclass
class Block:
    """Windows of some test items. term and offset are padded with -1 and, after `order`, sorted from the rarest term."""

    item: np.ndarray
    length: np.ndarray
    term: np.ndarray
    offset: np.ndarray
    vocabulary: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, items: list[tuple[int, str | None]], window: int) -> Block:
        data, offsets = utf8(pa.array([text for _, text in items], pa.string()))
        found = words(data, offsets, ALNUM)
        one, two = found.hashes(1), found.hashes(2)
        known, at, term = np.unique(one, return_index=True, return_inverse=True)
        counts, firsts, owner, length = found.counts, [], [], []
        for k, n in enumerate(counts):
            starts = np.arange(found.first[k], found.first[k] + max(1, n - window + 1)) if n else np.zeros(0, int)
            firsts.append(starts)
            owner.append(np.full(len(starts), items[k][0], np.int64))
            length.append(np.full(len(starts), min(n, window)))
        firsts, owner, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, owner, length))
        step = np.arange(window)
        inside = step[None, :] < length[:, None]
        at_word = np.minimum(firsts[:, None] + step, max(len(one) - 1, 0))
        terms = np.where(inside, term[at_word] if len(one) else -1, -1)
        return cls(owner, length, terms.astype(np.int32), np.where(inside, step, -1).astype(np.int16), (known, two[at]))

    def order(self, df: np.ndarray) -> Block:
        rank = np.where(self.term >= 0, df[self.term] if len(df) else 0, np.iinfo(np.int64).max)
        by = np.argsort(rank, axis=1, kind="stable")
        return Block(self.item, self.length, np.take_along_axis(self.term, by, 1), np.take_along_axis(self.offset, by, 1), self.vocabulary)


def blocks(items: DataFrame, window: int, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """Test items in blocks of a bounded number of words, read one after the other."""
    held: list[tuple[int, str | None]] = []
    size = 0
    for row in items.select("item_id", "text").toLocalIterator():
        n = len(row["text"] or "") // 2 + 1
        if held and size + n > most:
            yield Block.of(held, window)
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += n
    yield Block.of(held, window)


def passes(items: DataFrame, window: int) -> Iterator[list[Block]]:
    """Blocks that share a pass over the texts; their terms are numbers of one vocabulary."""

    def merged(group: list[Block]) -> list[Block]:
        known, at = np.unique(np.concatenate([b.vocabulary[0] for b in group]), return_index=True)
        vocabulary = known, np.concatenate([b.vocabulary[1] for b in group])[at]
        for b in group:
            number = np.append(np.searchsorted(known, b.vocabulary[0]), -1)  # the last is what padding, -1, names
            b.term, b.vocabulary = number[b.term].astype(np.int32), vocabulary
        return group

    held: list[Block] = []
    for block in blocks(items, window):
        if held and sum(len(b.vocabulary[0]) for b in [*held, block]) > PASS_WORDS:
            yield merged(held)
            held = []
        held.append(block)
    yield merged(held)


def index(docs: DataFrame, vocabulary: tuple[np.ndarray, np.ndarray], gap: int) -> DataFrame:
    """One row per shard: its documents, where their positions begin, and the positions of each term. `gap` parts documents."""
    known, second = vocabulary

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def shard() -> pa.RecordBatch:
            ids, counts, origins, terms, places = [], [], [], [], []
            base = gap
            for doc_ids, n, first, term, word in held:
                origin = base + first[:-1] + gap * np.arange(len(n))
                owner = np.searchsorted(first, word, "right") - 1
                ids += doc_ids
                counts.append(n)
                origins.append(origin)
                terms.append(term)
                places.append(origin[owner] + word - first[owner])
                base += int(first[-1]) + gap * len(n)
            term, place = np.concatenate(terms), np.concatenate(places)
            by = np.argsort(term, kind="stable")
            own, df = np.unique(term, return_counts=True)
            row = [ids, np.concatenate(counts), np.concatenate(origins), own.astype(np.int32), df.astype(np.int64), place[by].astype(np.int32)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            names = [x.split()[0] for x in INDEX.split(", ")]
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k)) for x, k in zip(row, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in chunks(offsets):
                found = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
                if len(found.start) and len(known):
                    one = found.hashes(1)
                    at = np.minimum(np.searchsorted(known, one), len(known) - 1)
                    hit = np.flatnonzero(known[at] == one)
                    hit = hit[found.hashes(2, hit) == second[at[hit]]]
                    term = at[hit]
                else:
                    hit = term = np.zeros(0, np.int64)
                held.append((ids[i:j], found.counts, found.first, term, hit))
                size += int(found.first[-1]) + gap * (j - i)
                if size >= SHARD_WORDS:
                    yield shard()
                    held, size = [], 0
        if held:
            yield shard()

    return docs.select("doc_id", "text").mapInArrow(build, INDEX)


def document_frequencies(shards: DataFrame, n_terms: int) -> np.ndarray:
    """Postings of each term of the vocabulary over all shards: as many numbers as the block has terms."""
    rows = shards.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("n")).toPandas()
    df = np.zeros(n_terms, np.int64)
    df[rows["term"].to_numpy(int)] = rows["n"].to_numpy(np.int64)
    return df


def _occurrences(block: Block, keys: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, position of its start) whose terms all stand within `slop` words of their places."""
    if not len(keys) or not len(block.item):
        return
    rarest = block.term[:, 0].astype(np.int64)
    low = np.searchsorted(keys, rarest << 32)
    n = np.searchsorted(keys, (rarest + 1) << 32) - low
    total, i = np.cumsum(n), 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + CANDIDATES, "right")))
        w = np.repeat(np.arange(i, j), n[i:j])
        within = np.arange(len(w)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j])
        start = (keys[low[w] + within] & 0xFFFFFFFF) - block.offset[w, 0]
        for k in range(1, block.term.shape[1]):
            if not len(w):
                break
            term = block.term[w, k].astype(np.int64)
            want = (term << 32) + start + block.offset[w, k]
            at = np.minimum(np.searchsorted(keys, want - slop), len(keys) - 1)
            ok = (term < 0) | ((keys[at] >= want - slop) & (keys[at] <= want + slop))
            w, start = w[ok], start[ok]
        yield w, start
        i = j


def search(shards: DataFrame, block: Block, slop: int) -> DataFrame:
    """Per document of the index: hit runs [start, end) in words, items with exact and with near occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, n_words, origin, term, df, position = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) if c else batch.column(0)[row].values for c in range(6))
                keys = (np.repeat(term.astype(np.int64), df) << 32) | position
                end = int(origin[-1] + n_words[-1]) + 1 if len(origin) else 1
                cover = np.zeros(end + 1, np.int32)
                exact, near = [], []
                for w, start in _occurrences(block, keys, 0):
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + block.length[w], -1)
                    exact.append(np.stack([np.searchsorted(origin, start, "right") - 1, block.item[w]], 1))
                if slop:
                    for w, start in _occurrences(block, keys, slop):
                        near.append(np.stack([np.searchsorted(origin, start + block.offset[w, 0], "right") - 1, block.item[w]], 1))
                covered = (np.cumsum(cover) > 0).astype(np.int8)
                step = np.diff(covered, prepend=0)
                begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                owner = np.searchsorted(origin, begins, "right") - 1
                n = len(origin)
                run_offsets = np.searchsorted(owner, np.arange(n + 1))
                runs = pa.StructArray.from_arrays([pa.array(begins - origin[owner], pa.int64()), pa.array(ends - origin[owner], pa.int64())], ["start", "end"])
                columns = [ids, pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(run_offsets, pa.int32()), runs)]
                for pairs in (exact, near):
                    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
                    columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(n + 1)), pa.int32()), pa.array(pairs[:, 1], pa.int64())))
                for i in range(0, n, 5000):
                    yield pa.RecordBatch.from_arrays([c.slice(i, 5000) if isinstance(c, pa.Array) else c for c in columns], names=["doc_id", "n_words", "runs", "items", "near_items"])

    return shards.mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,end:bigint>>, items array<bigint>, near_items array<bigint>")


def benchmark_matches(docs: DataFrame, items: DataFrame, window: int = 13, slop: int = 3) -> DataFrame:
    """Exact phrase and proximity matches of test items in documents.

    docs: doc_id, text; items: item_id, text; more columns are ignored. A window is `window` consecutive words of an
    item (all of a shorter one). Exact: its words in sequence. Near: each word within `slop` words of its place. One row
    per row of docs: doc_id, n_words, runs (hit words, as disjoint [start, end)), items, near_items (sorted ids).
    Null and empty texts have no words and no hits; items without words match nothing; repeated doc_ids keep a row each;
    an item_id of null is skipped; empty tables give no rows or no hits.
    """
    groups = passes(items.where("item_id is not null"), window)
    first, second = next(groups), next(groups, None)
    if second is None and len(first) == 1:
        return next(_block_matches(docs, first, window, slop))
    # Each block has its own search, so rows need a name that all agree on.
    named = stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    rows, found = named.select(F.col("row").alias("doc_id"), "text"), None
    for group in chain([first], [second] if second else [], groups):
        for one in _block_matches(rows, group, window, slop):
            found = one if found is None else found.unionByName(one)
    merged = found.groupBy(F.col("doc_id").alias("row")).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )
    disjoint = F.aggregate("runs", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), _join_runs)
    return named.select("row", "doc_id").join(merged, "row").select("doc_id", "n_words", disjoint.alias("runs"), "items", "near_items")


def _block_matches(docs: DataFrame, group: list[Block], window: int, slop: int) -> Iterator[DataFrame]:
    """Matches of each block of a pass; the texts are read once."""
    shards = stage(index(docs, group[0].vocabulary, gap=window + slop + 1), "postings")
    df = document_frequencies(shards, len(group[0].vocabulary[0]))
    for block in group:
        yield search(shards, block.order(df), slop)


def _join_runs(done, run):
    """Adds a run, sorted by start, to disjoint ones."""
    head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    return F.when((F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["end"] < run["start"]), F.concat(done, F.array(run))).otherwise(
        F.concat(head, F.array(F.struct(F.try_element_at(done, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(done, F.lit(-1))["end"], run["end"]).alias("end"))))
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, slop: int = 3, share: int = 20) -> DataFrame:
    """`benchmark_matches` with n_hit, n_items and the verdict: contaminated when n_hit > 0 and share * n_hit >= n_words."""
    found = benchmark_matches(docs, items, window, slop)
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("bigint"), "n_near_items": F.size("near_items").cast("bigint")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Rows of docs that are not contaminated, as they are. The verdict is of a text, by 64 bits of its hash, so rows without an
    id, and rows that share one, are judged by their own texts. Null and empty texts are clean; empty tables are kept."""
    name = free_name(docs, "text_code")
    coded = docs.withColumn(name, F.xxhash64("text"))
    gone = contamination(coded.select(F.col(name).alias("doc_id"), "text"), items, window, 0, share).where("contaminated").select(F.col("doc_id").alias(name))
    return by_ids(coded, gone, name, "left_anti").select(*docs.columns)


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns of op1."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated", "n_near_items")
