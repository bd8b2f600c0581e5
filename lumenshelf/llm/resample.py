"""Importance resampling: draw documents that look like a target, by hashed word n-grams.

Two passes over the texts, in Arrow batches. The first counts features by bucket, one vector of `buckets` numbers a
partition (np.bincount); treeReduce adds the vectors up on the executors, so that few reach the driver. The second looks
up each feature's gain in a broadcast vector and adds the gains up by document (np.bincount with weights). The draw is by
Gumbel scores: the highest of weight + noise. Scores are whole numbers within a fixed range, so a histogram of them, of at
most SCORES rows, tells which score is the last one drawn and how many documents stand above each; only documents at or
above it are sorted, within equal scores. The noise spreads documents of equal weight: no score holds more than one in
2,700 of them, but for rows that share an id.

Results: text null, empty or without words has no features and weight 0. Rows with a null id count as if the id were an
empty text, and come last among equal scores. Repeated rows count once each. Where the target has no features, every
bucket counts as not seen there. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, row_chunks, small
from .common import Scratch

SCORES = 200_000  # gains lie within 1000 * ln(2^63) on either side, the noise within 26,000
CHUNK = 1 << 20

#: Words are runs of digits, letters (lower-cased) and bytes above 127.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


CRC = _crc_table()


def crc_on(state: np.ndarray, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes of each slice, from the states before them; all slices at once, a byte a turn."""
    state = state.copy()
    live, k = np.flatnonzero(length > 0), 0
    while live.size:
        s = state[live]
        state[live] = CRC[(s ^ buf[start[live] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
        k += 1
        live = live[length[live] > k]
    return state


def features(texts: list[bytes], width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of each run of 1 to `width` consecutive words, and the number of words of each text."""
    raw = b"\n".join(texts).translate(LOWER) + b"\n"
    buf = np.frombuffer(raw, np.uint8)
    inside = WORD[buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edge[0::2], edge[1::2]
    doc_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    doc = np.searchsorted(doc_end, start, "right")
    state = crc_on(np.full(len(start), 0xFFFFFFFF, np.uint32), buf, start, end - start)
    found, rows = [state], [doc]
    blank = np.uint32(32)
    for n in range(1, width):  # runs of n words go on with a space and the next word
        state = state[: max(0, len(start) - n)]
        same = doc[: len(state)] == doc[n:]
        spaced = CRC[(state ^ blank) & np.uint32(255)] ^ (state >> np.uint32(8))
        state = crc_on(spaced, buf, start[n:], (end - start)[n:])
        found.append(state[same])
        rows.append(doc[: len(state)][same])
    bucket = (np.concatenate(found) ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % buckets
    return bucket, np.concatenate(rows), np.bincount(doc, minlength=len(texts))


def bucket_counts(df: DataFrame, text: str = "text", width: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in small(batches):
            raw = [x or b"" for x in batch.column(0).to_pylist()]
            for a, b in row_chunks(raw, CHUNK):
                total += np.bincount(features(raw[a:b], width, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])

    def add(x: bytes, y: bytes) -> bytes:
        return (np.frombuffer(x, np.int64) + np.frombuffer(y, np.int64)).tobytes()

    vectors = df.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "n binary").rdd.map(lambda r: bytes(r[0]))
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return np.frombuffer(vectors.treeReduce(add), np.int64)


def bucket_gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket shares, target to own, rounded down."""
    n = float(len(own))
    up, down = (target + 1.0) * (float(own.sum()) + n), (own + 1.0) * (float(target.sum()) + n)
    return np.array([math.floor(1000 * math.log(x)) for x in (up / down).tolist()], np.float64)


def weights(df: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text", width: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight): weight is the mean gain of a text's features, rounded down."""
    buckets = len(gains)
    held = df.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in small(batches):
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            for a, b in row_chunks(raw, CHUNK):
                bucket, row, words = features(raw[a:b], width, buckets)
                n = np.bincount(row, minlength=b - a)
                total = np.bincount(row, weights=gain[bucket], minlength=b - a).astype(np.int64)
                cols = [batch.column(0).slice(a, b - a), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_features", "weight"])

    return df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "id long, n_words long, n_features long, weight long")


def noise(doc_id: str, seed: int):
    """Thousandths of a Gumbel variate that the id and the seed fix, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(df: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, width: int = 1, buckets: int = 10_000, min_words: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank), one row for each row of df. Of the N texts with at least `min_words` words the
    floor(percent * N / 100) with the highest scores are drawn, by rank 1, 2, ...; the others' rank is null."""
    store = Scratch(df.sparkSession, "resample")
    gains = bucket_gains(bucket_counts(df, text, width, buckets), bucket_counts(target, text, width, buckets))
    scored = store.keep(weights(df, gains, doc_id, text, width).withColumn("score", F.col("weight") + noise("id", seed)))
    fits = F.col("n_words") >= min_words
    seen = sorted(((r["score"], r["count"]) for r in scored.where(fits).groupBy("score").count().collect()), reverse=True)  # at most SCORES rows
    wanted = percent * sum(n for _, n in seen) // 100
    above, upto = [], 0
    for score, n in seen:
        if upto >= wanted:
            break
        above.append((score, upto))
        upto += n
    out = ["id", "n_features", "weight", "score", "rank"]
    if not above:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*out)
    table = df.sparkSession.createDataFrame(pa.table({"score": pa.array([s for s, _ in above], pa.int64()), "above": pa.array([n for _, n in above], pa.int64())}))
    low = above[-1][0]
    equal = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight")
    high = scored.where(fits & (F.col("score") >= low)).join(F.broadcast(table), "score").withColumn("rank", F.col("above") + F.row_number().over(equal))
    drawn = high.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")).cast("long"))
    rest = scored.where(~fits | (F.col("score") < low)).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*out).union(rest.select(*out))
