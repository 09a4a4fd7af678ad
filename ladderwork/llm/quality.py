"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are one-hot, so a learned filter of width W is W tables of 256 weights and a convolution is W table look-ups.
A text is covered by chunks of CHUNK bytes that overlap by half. In a chunk each filter's responses are pooled (maximum,
mean, squared mean); learned units over these pools answer for the chunk; the units are max-pooled over all chunks of
the whole text and combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, stage
from .words import chunks, release_memory, utf8

WIDTH, STEP, FILTERS, UNITS, CHUNK = 6, 2, 16, 24, 256
HALF = CHUNK // 2
#: Labelled rows the network is fitted on at most, and bytes of their whole texts together: the driver holds that many.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 24 << 20


@dataclass
class Network:
    tables: np.ndarray  #: WIDTH x 256 x FILTERS
    centre: np.ndarray  #: of the pools
    scale: np.ndarray
    units: np.ndarray  #: pools x UNITS
    unit_bias: np.ndarray
    out: np.ndarray  #: UNITS
    bias: float
    log: list = field(default_factory=list)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text of a batch."""
        result = np.empty(len(offsets) - 1)
        for i, j in chunks(offsets, 1 << 16):
            pools, owner = chunk_pools(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], self.tables)
            answer = np.maximum(((pools - self.centre) / self.scale) @ self.units + self.unit_bias, 0)
            best = np.maximum.reduceat(answer, np.searchsorted(owner, np.arange(j - i)))
            result[i:j] = 1 / (1 + np.exp(-np.clip(best @ self.out + self.bias, -30, 30)))
        return result


def cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts padded with zero bytes to whole half chunks, at least two each: (bytes, half chunks of each text, first of each)."""
    size = np.diff(offsets)
    halves = np.maximum(2, -(-size // HALF))
    first = np.cumsum(halves) - halves
    padded = np.zeros(int(halves.sum()) * HALF + WIDTH, np.uint8)
    at = np.arange(len(data)) + np.repeat(first * HALF - offsets[:-1], size)
    padded[at] = data
    return padded, halves, first


def responses(padded: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """half chunks x positions x filters; a filter may look WIDTH - STEP bytes into the next half chunk."""
    n = (len(padded) - WIDTH) // STEP
    total = tables[0][padded[0 : n * STEP : STEP]]
    for k in range(1, WIDTH):
        total += tables[k][padded[k : k + n * STEP : STEP]]
    np.maximum(total, 0, out=total)
    return total.reshape(-1, HALF // STEP, tables.shape[2])


def chunk_pools(data: np.ndarray, offsets: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pools of each chunk, text of each chunk). A chunk is two neighbouring half chunks."""
    padded, halves, first = cells(data, offsets)
    r = responses(padded, tables)
    top, mean = r.max(1), r.mean(1)
    last = np.zeros(len(top), bool)
    last[first + halves - 1] = True
    left = np.flatnonzero(~last)
    top, mean = np.maximum(top[left], top[left + 1]), (mean[left] + mean[left + 1]) / 2
    return np.concatenate([top, mean, mean * mean], 1), np.repeat(np.arange(len(halves)), halves - 1)


def fit(texts: list[str | None], labels: list[int], seed: int = 7, steps: int = 320, batch: int = 64, rate: float = 3e-3) -> Network:
    """Adam on the log loss over whole texts; the rarer label weighs as much as the other. Without both labels the score is their
    share. A step's gradient goes through each unit's winning chunk of each text, found over all of its chunks."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    share = float(y.mean()) if len(y) else 0.5
    raw = [np.frombuffer((text or "").encode(), np.uint8) for text in texts]
    pools = 3 * FILTERS
    net = Network(
        rng.normal(0, 0.5, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(pools, np.float32), np.ones(pools, np.float32),
        rng.normal(0, 1 / np.sqrt(pools), (pools, UNITS)).astype(np.float32), np.full(UNITS, 0.1, np.float32), rng.normal(0, 0.3, UNITS).astype(np.float32), 0.0,
    )
    if not len(y) or not 0 < share < 1:
        net.out[:] = 0
        net.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return net
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))

    def joined(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([raw[k] for k in rows] or [np.zeros(0, np.uint8)]), np.concatenate([[0], np.cumsum([len(raw[k]) for k in rows])]).astype(np.int64)

    some, _ = chunk_pools(*joined(rng.permutation(len(raw))[:300]), net.tables)
    net.centre, net.scale = some.mean(0), some.std(0) + 1e-3
    names = ("tables", "units", "unit_bias", "out")
    moment = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names} | {"bias": [0.0, 0.0]}
    step = 0
    for _ in range(max(1, min(60, -(-steps * batch // len(raw))))):
        lost = 0.0
        for rows in np.array_split(rng.permutation(len(raw)), max(1, len(raw) // batch)):
            data, offsets = joined(rows)
            padded, halves, first = cells(data, offsets)
            r = responses(padded, net.tables)
            last = np.zeros(len(r), bool)
            last[first + halves - 1] = True
            left = np.flatnonzero(~last)
            owner = np.repeat(np.arange(len(rows)), halves - 1)
            top, mean = r.max(1), r.mean(1)
            right_wins = top[left + 1] > top[left]
            m = (mean[left] + mean[left + 1]) / 2
            z = (np.concatenate([np.maximum(top[left], top[left + 1]), m, m * m], 1) - net.centre) / net.scale
            a = np.maximum(z @ net.units + net.unit_bias, 0)
            start = np.searchsorted(owner, np.arange(len(rows)))
            best = np.maximum.reduceat(a, start)
            p = 1 / (1 + np.exp(-np.clip(best @ net.out + net.bias, -30, 30)))
            w = weight[rows]
            lost -= float((w * np.where(y[rows] > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum())
            d = (w * (p - y[rows]) / len(rows)).astype(np.float32)
            grad = {"out": best.T @ d + 1e-4 * net.out, "bias": float(d.sum())}
            is_best = (a == best[owner]) & (a > 0)
            won = np.flatnonzero(is_best.any(1))
            da = is_best[won] * (d[:, None] * net.out)[owner[won]]
            grad["units"] = z[won].T @ da + 1e-4 * net.units
            grad["unit_bias"] = da.sum(0)
            dz = (da @ net.units.T) / net.scale
            d_top, d_mean = dz[:, :FILTERS], (dz[:, FILTERS : 2 * FILTERS] + 2 * m[won] * dz[:, 2 * FILTERS :]) / 2
            # Half chunks of winning chunks, and the gradient of each of their positions.
            used, at = np.unique(np.concatenate([left[won], left[won] + 1]), return_inverse=True)
            per_half = np.zeros((len(used), FILTERS), np.float32)
            np.add.at(per_half, at, np.concatenate([d_mean, d_mean]))
            dr = np.repeat(per_half[:, None] / (HALF // STEP), HALF // STEP, 1)
            seen = r[used]
            top_at = seen.argmax(1)
            half, f = np.nonzero(d_top)
            which = np.searchsorted(used, left[won[half]] + right_wins[won[half], f])
            np.add.at(dr, (which, top_at[which, f], f), d_top[half, f])
            dr *= seen > 0
            flat = dr.reshape(-1, FILTERS)
            busy = np.flatnonzero(flat.any(1))
            place = (used[:, None] * (HALF // STEP) + np.arange(HALF // STEP)).ravel()[busy] * STEP
            flat, g = flat[busy], np.zeros_like(net.tables)
            for k in range(WIDTH):
                by = padded[place + k]
                order = np.argsort(by, kind="stable")
                own, begin = np.unique(by[order], return_index=True)
                if len(own):
                    g[k][own] = np.add.reduceat(flat[order], begin)
            grad["tables"] = g + 1e-5 * net.tables
            step += 1
            for k, x in grad.items():
                m1, m2 = moment[k]
                m1, m2 = 0.9 * m1 + 0.1 * x, 0.999 * m2 + 0.001 * x * x
                moment[k] = [m1, m2]
                change = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, getattr(net, k) - change)
        net.log.append(lost / len(raw))
    # The loss weighs both labels alike; move the bias halfway to their true shares, since wrong rejections lose clean text.
    net.bias = float(net.bias + 0.5 * np.log(share / (1 - share)))
    return net


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Fits on whole texts of labelled rows that are not held out: the sample_rows of the lowest hashes of their ids, so any
    partitioning draws the same, and of these, in that order, those that fit into sample_bytes together. Rows of no label,
    of labels that contradict each other or of an unknown document are left out; of rows that share an id the first text
    counts; a null text is empty."""
    usable = labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    agreed = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").select("doc_id", "quality")
    chosen = agreed.withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(sample_rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = stage(found.groupBy("doc_id", "quality", "rank").agg(F.min("text").alias("text")), "labelled")
    kept, total = [], 0
    for row in texts.select("doc_id", F.octet_length("text").alias("size")).orderBy("rank", "doc_id").collect():
        if total + row["size"] <= sample_bytes:
            kept.append((row["doc_id"],))
            total += row["size"]
    ids = docs.sparkSession.createDataFrame(kept, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    rows = texts.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text", "quality").toPandas().sort_values("doc_id", kind="stable")
    return fit(rows["text"].tolist(), rows["quality"].tolist())


def score(net: Network):
    """Column function: probability of label 1 for a text; null counts as empty."""

    @F.arrow_udf(T.DoubleType())
    def quality_score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(net.scores(*utf8(column)), pa.float64())
            release_memory()

    return quality_score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 if score >= threshold); columns of these names are replaced. Labels,
    lang, source and doc_id are no inputs of the score; null and empty texts score alike; a very long text is scored whole;
    repeated rows score alike; an empty table gives no rows."""
    scored = docs.withColumn("score", score(train(docs, labels))("text"))
    return scored.withColumns({"held_out": held_out("doc_id"), "predicted": (F.col("score") >= threshold).cast("int")})


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows of docs whose text scores at least the threshold, as they are, whatever their columns are called. Null and empty
    texts are judged as empty; repeated rows stay or go together; an empty table stays empty."""
    name = free_name(docs, "quality_score")
    return docs.withColumn(name, score(train(docs, labels))("text")).where(F.col(name) >= threshold).select(*docs.columns)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns of op5."""
    return classify(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")
