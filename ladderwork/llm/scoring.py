"""Language-model scoring by deleted interpolation of word n-grams.

The probability of a token is a mixture of its maximum-likelihood estimates after two words, one word and none, and of one
even share for each known token and the unknown one. The mixture's weights depend on how often the context was seen, in
buckets of powers of two, and are learned by expectation-maximisation on held-out counts: a tenth of the documents learned
from is scored with the counts of all others, each document's own occurrences deleted.

Counting moves each text once, bundled by task and block and compressed. A block sends its distinct words, pairs and triples
as packed hashes to ranges, which sum them over the corpus and answer each block with the totals (see `totals`). The block
then knows the corpus counts of all its tokens, which are written, packed. Weights and scores are learned and computed from
that table alone. Words are named by 62 bits; pairs and triples by 18 bits more than the number of tokens needs, so fewer than one in
200,000 are counted together with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage
from .totals import SENT, Spread, pack_counts, rows_of, totals, unpack_counts
from .words import SPACED_LOWER, U64, chunks, mix, release_memory, utf8, words

#: Bytes of text in a block and keys in a range, on average.
BLOCK_BYTES, RANGE_KEYS = 5 << 20, 2 << 20
#: Bits of a pair's or triple's name beyond those that number all tokens.
SPARE_BITS = 18
#: Rounds of expectation-maximisation at most; they end when a round gains less (in nats a token).
ROUNDS, GAIN = 25, 1e-4
#: Buckets: no context seen; one word seen so often (powers of two); two words seen so often.
BUCKETS, PAIRS_FROM = 64, 32
#: Folds of documents: not learned from; weights; counts only.
OUT, WEIGHTS, COUNTS = 0, 1, 2
_BEGIN, _END = U64(0xB5297A4D3F84D5B5), U64(0x68E31DA4A3D7C1F9)
_BY_PLACE = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)]

COUNTED = "block bigint, doc_ids array<bigint>, folds binary, tokens binary, c1 binary, c2 binary, c3 binary, own1 binary, own2 binary, own3 binary, types bigint, seen bigint"
EVENTS = "bucket int, f1 float, f2 float, f3 float, n bigint"
BUNDLES = "block bigint, bundle binary"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _keys(text: pa.Array, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(names of each token's word, pair and triple; tokens of each text). The last token of a text is its end."""
    data, offsets = utf8(text)
    out: list[list[np.ndarray]] = [[], [], []]
    tokens = []
    for i, j in chunks(offsets):
        found = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACED_LOWER)
        n = found.counts
        # Each text: two begins, its words, one end.
        line = np.full(len(found.start) + 3 * (j - i), _BEGIN, U64)
        at = found.first[:-1] + 3 * np.arange(j - i)
        line[at + n + 2] = _END
        line[np.arange(len(found.start)) + np.repeat(3 * np.arange(j - i) + 2, n)] = found.hashes(1)
        is_token = np.ones(len(line), bool)
        is_token[at] = is_token[at + 1] = False
        place = np.flatnonzero(is_token)
        total = np.zeros(len(place), U64)
        for k in range(3):
            total += line[place - k] * _BY_PLACE[k]
            name = mix(total + U64(k))
            out[k].append((name >> U64(2) if k == 0 else name >> U64(64 - bits)) | U64(k << 62))
        tokens.append(n + 1)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return [join(x, U64) for x in out], join(tokens, np.int64)


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = np.sort(values)
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return own[begin], np.diff(np.append(begin, len(own)))


def _spread(bits: int, ranges: int) -> Spread:
    """Ranges are intervals of the names of words, of pairs or of triples, so that names in one lie close together."""
    share = np.array([-(-ranges // 6), -(-5 * ranges // 12), -(-5 * ranges // 12)], U64)
    before = np.cumsum(share) - share

    def number(keys: np.ndarray) -> np.ndarray:
        low, kind = keys & U64((1 << 62) - 1), (keys >> U64(62)).astype(np.int64)
        top = np.where(kind == 0, low >> U64(30), low >> U64(bits - 32))
        return before[kind] + (top * share[kind] >> U64(32))

    return Spread(int(share.sum()), of=number)


def _bundled(docs: DataFrame) -> DataFrame:
    """Rows of BUNDLES for docs (doc_id, text, fold, block): a task's documents of a block as one compressed value."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("doc_id")
            known, number = np.array(ids.is_valid()).astype(np.uint8), ids.fill_null(0).to_numpy(zero_copy_only=False)
            fold, block = batch.column("fold").to_numpy().astype(np.uint8), batch.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            held, begin = np.unique(block[order], return_index=True)
            out = []
            for own in np.split(order, begin[1:]) if len(held) else []:
                head = np.uint32(len(own)).tobytes() + number[own].astype("<i8").tobytes() + np.diff(offsets)[own].astype("<i8").tobytes() + known[own].tobytes() + fold[own].tobytes()
                raw = head + b"".join([data[offsets[k] : offsets[k + 1]].tobytes() for k in own.tolist()])
                out.append(np.uint32(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True))
            yield pa.record_batch([pa.array(held, pa.int64()), pa.array(out, pa.binary())], names=["block", "bundle"])
            release_memory()

    return docs.mapInArrow(bundle, BUNDLES)


def _unbundled(bundles: pa.ChunkedArray) -> tuple[list[int | None], np.ndarray, pa.Array]:
    """(doc_ids, folds, texts) of a block's bundles, in the order of doc_ids and texts that any order of bundles gives."""
    rows = []
    for x in bundles.to_pylist():
        raw = pa.decompress(x[4:], decompressed_size=int(np.frombuffer(x, "<u4", 1)[0]), codec="zstd", asbytes=True)
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        number, size = np.frombuffer(raw, "<i8", 2 * n, 4).reshape(2, n)
        known, fold = np.frombuffer(raw, np.uint8, 2 * n, 4 + 16 * n).reshape(2, n)
        at = 4 + 18 * n + np.append(0, np.cumsum(size))
        rows += zip(known.tolist(), number.tolist(), fold.tolist(), (raw[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())))
    rows.sort()
    return [d if k else None for k, d, _, _ in rows], np.array([r[2] for r in rows], np.int64), pa.array([r[3] for r in rows], pa.large_binary()).cast(pa.large_string())


def _known(keys: list[np.ndarray]) -> list[np.ndarray]:
    return [_unique(k)[0] for k in keys]


def _own(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each token how often its document has its key."""
    order = np.lexsort((keys, owner))
    key, doc = keys[order], owner[order]
    begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    size = np.diff(np.append(begin, len(key)))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(size, size)
    return out


def _doc_counts(docs: DataFrame) -> tuple[DataFrame, Spread, int, int]:
    """(bundles of dealt documents, spread of keys over ranges, bits of a pair's name, blocks whose documents give the weights)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tokens = max(1 << 12, total // 5)
    bits = min(62, max(40, int(tokens).bit_length() + SPARE_BITS))
    blocks = max(40, -(-total // BLOCK_BYTES))
    apart = blocks // 10
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))
    fold = F.when(crc % 10 == 0, OUT).when(F.floor(crc / 10) % 10 == 0, WEIGHTS).otherwise(COUNTS)
    slot = F.xxhash64("doc_id", "text")
    block = F.when(fold == WEIGHTS, F.pmod(slot, F.lit(apart))).otherwise(apart + F.pmod(slot, F.lit(blocks - apart)))
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", fold.alias("fold"), block.cast("bigint").alias("block"))
    return _bundled(dealt), _spread(bits, max(32, -(-2 * tokens // RANGE_KEYS))), bits, apart


def token_counts(docs: DataFrame) -> DataFrame:
    """COUNTED: for each block the corpus counts of its tokens' words, pairs and triples over the documents learned from, for
    documents of the weights' fold also the documents' own counts; and a row for each range with its known words (types)
    and their occurrences (seen)."""
    dealt, spread, bits, apart = _doc_counts(docs)

    def send(key: tuple, block: pa.Table) -> pa.Table:
        _, folds, text = _unbundled(block.column("bundle"))
        keys, tokens = _keys(text, bits)
        learn = np.repeat(folds != OUT, tokens)
        parts, counts = [], []
        for k in keys:
            own, _ = _unique(k)
            part, n = _unique(k[learn])
            count = np.zeros(len(own), np.int64)
            count[np.searchsorted(own, part)] = n
            parts.append(own)
            counts.append(count)
        return rows_of(SENT, spread.send(key[0].as_py(), np.concatenate(parts), np.concatenate(counts)))

    def report(own: np.ndarray, total: np.ndarray) -> tuple[int, ...]:
        words = total[: int(np.searchsorted(own, U64(1 << 62)))]
        return int((words > 0).sum()), int(words.sum())

    def receive(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        number = key[0].as_py()
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 8, pa.int64(), pa.int64()]
        names = [x.split()[0] for x in COUNTED.split(", ")]
        if number < 0:
            types, seen = unpack_counts(answers.column("totals").to_pylist()[0]).tolist()
            row = [number, [], *[b""] * 8, types, seen]
        else:
            ids, folds, text = _unbundled(block.column("bundle"))
            keys, tokens = _keys(text, bits)
            known = _known(keys)
            total, _ = spread.receive(np.concatenate(known), answers)
            bounds = np.append(0, np.cumsum([len(x) for x in known]))
            count = [pack_counts(total[bounds[k] : bounds[k + 1]][np.searchsorted(known[k], keys[k])]) for k in range(3)]
            own = [b""] * 3
            if number < apart:
                owner = np.repeat(np.arange(len(tokens)), tokens)
                own = [pack_counts(_own(k, owner)) for k in keys]
            row = [number, ids, pack_counts(folds), pack_counts(tokens), *count, *own, 0, 0]
        return pa.table([pa.array([x], kind) for x, kind in zip(row, kinds)], names=names)

    answers = totals(dealt.groupBy("block").applyInArrow(send, SENT), spread, report=report)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(receive, COUNTED)


def _estimates(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, tokens: np.ndarray, documents: np.ndarray, seen: np.ndarray, share: float) -> tuple[np.ndarray, ...]:
    """(bucket, estimates after no word, one word and two words) of each token, from the counts of its word, pair and triple,
    the documents that began, and the tokens seen. share is the even share, the estimate of words where none were seen."""
    first = np.cumsum(tokens) - tokens
    context1, context2 = np.empty_like(c1), np.empty_like(c2)
    context1[1:], context2[1:] = c1[:-1], c2[:-1]
    context1[first] = context2[first] = documents
    divided = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    level = lambda x: np.frexp(x.astype(np.float64))[1] - 1
    bucket = np.where(context2 > 0, np.minimum(PAIRS_FROM + level(context2), BUCKETS - 1), np.where(context1 > 0, np.minimum(1 + level(context1), PAIRS_FROM - 1), 0))
    f1 = np.where(seen > 0, c1 / np.maximum(seen, 1), share)
    return bucket, f1, divided(c2, context1), divided(c3, context2)


def even_weights() -> np.ndarray:
    """Weights of the even share and of the estimates after no, one and two words, for each bucket: equal where the context was seen."""
    out = np.zeros((BUCKETS, 4))
    out[0, :2], out[1:PAIRS_FROM, :3], out[PAIRS_FROM:] = 1 / 2, 1 / 3, 1 / 4
    return out


def _counted(row: dict, own: bool) -> tuple[np.ndarray, ...]:
    tokens = unpack_counts(row["tokens"])
    counts = [unpack_counts(row[c]) for c in ("c1", "c2", "c3")]
    documents = counts[0][np.cumsum(tokens) - 1]  # how often a text ended
    if not own:
        return tokens, documents, *counts
    own = [unpack_counts(row[c]) for c in ("own1", "own2", "own3")]
    return tokens, documents - 1, *[a - b for a, b in zip(counts, own)]


def held_out_events(counted: DataFrame, seen: int, types: int) -> DataFrame:
    """EVENTS: how often each bucket met each vector of estimates in the weights' fold, a document's own counts deleted."""
    share = 1 / (types + 1)

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, documents, *counts = _counted(row, own=True)
                bucket, *f = _estimates(*counts, tokens, documents, np.repeat(seen - tokens, tokens), share)
                order = np.lexsort((*f, bucket))
                columns = [bucket[order], *(x[order].astype(np.float32) for x in f)]
                begin = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in columns], axis=0)))
                n = np.diff(np.append(begin, len(order)))
                yield pa.record_batch([pa.array(columns[0][begin].astype(np.int32)), *(pa.array(x[begin]) for x in columns[1:]), pa.array(n, pa.int64())], names=["bucket", "f1", "f2", "f3", "n"])

    return counted.where("octet_length(own1) > 0").select("tokens", "c1", "c2", "c3", "own1", "own2", "own3").mapInArrow(events, EVENTS)


def _mixture(weights: np.ndarray, share: float) -> list[Column]:
    of = lambda k: F.element_at(F.lit(weights[:, k].tolist()), F.col("bucket") + 1)
    return [of(0) * F.lit(share), of(1) * F.col("f1"), of(2) * F.col("f2"), of(3) * F.col("f3")]


def learned_weights(events: DataFrame, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of each bucket by expectation-maximisation: a round is one aggregate over the events. A bucket's even weights count
    as one event more, so no weight of a context that was seen gets to zero, and buckets without events keep them."""
    weights, prior, before = even_weights(), even_weights(), None
    for _ in range(rounds):
        parts = _mixture(weights, 1 / (types + 1))
        mixed = events.select("bucket", "n", *[p.alias(f"p{k}") for k, p in enumerate(parts)]).withColumn("p", F.col("p0") + F.col("p1") + F.col("p2") + F.col("p3"))
        sums = mixed.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("p")).alias("gain"), *[F.sum(F.col("n") * F.col(f"p{k}") / F.col("p")).alias(f"s{k}") for k in range(4)]).collect()
        if not sums:
            break
        for r in sums:
            weights[r.bucket] = (np.array([r.s0, r.s1, r.s2, r.s3]) + prior[r.bucket]) / (r.n + 1)
        gain = sum(r.gain for r in sums) / sum(r.n for r in sums)
        if before is not None and gain - before < GAIN:
            break
        before = gain
    return weights


def scored(docs: DataFrame) -> DataFrame:
    """SCORES: one row per row of docs with its number of tokens, those known, the tokens learned from, the add-a-tenth unigram score
    and the model's log10 probability of the text.

    Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, then one end. Documents whose crc32(doc_id as text) % 10 is 0, and rows
    without a doc_id, are held out: nothing is learned from them. Null and empty texts are their end alone; repeated rows stay, and
    are learned from as often as they are there; without documents to learn from each token has probability 1 of one kind; columns
    other than doc_id and text are ignored; an empty table gives no rows. A text is one cell, however long."""
    counted = stage(token_counts(docs), "counted")
    types, seen = [int(x or 0) for x in counted.where("block < 0").agg(F.sum("types"), F.sum("seen")).first()]
    events = stage(held_out_events(counted, seen, types), "events")
    weights, share = learned_weights(events, types), 1 / (types + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, documents, c1, c2, c3 = _counted(row, own=False)
                bucket, f1, f2, f3 = _estimates(c1, c2, c3, tokens, documents, np.full(len(c1), seen), share)
                own = weights[bucket]
                p = own[:, 0] * share + own[:, 1] * f1 + own[:, 2] * f2 + own[:, 3] * f3
                first = np.cumsum(tokens) - tokens
                total = lambda x: np.add.reduceat(x, first)
                base = np.log10((c1 + 0.1) / (seen + 0.1 * (types + 1)))
                out = unpack_counts(row["folds"]) == OUT
                yield pa.record_batch(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(out), pa.array(tokens), pa.array(total((c1 > 0).astype(np.int64))), pa.array(np.full(len(tokens), seen)), pa.array(total(base)), pa.array(total(np.log10(p)))],
                    names=[x.split()[0] for x in SCORES.split(", ")],
                )

    return counted.where("block >= 0").select("doc_ids", "folds", "tokens", "c1", "c2", "c3").mapInArrow(score, SCORES)
