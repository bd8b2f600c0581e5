"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every five-word shingle hash below a fixed fraction of the hash space, whatever the text's length, so
sketches of very unequal texts can be merged and compared, also for containment. So that short texts have a sketch too, it
always keeps the LEAST smallest hashes: its threshold is the larger of the fixed one and its LEAST-th hash. Two sketches
are compared below the lower of their thresholds, where both are complete.

Results: text null or without words: the empty sketch, alike (1) to another empty one only. Equal texts have equal sketches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import U, Words, bounds, row_chunks, small
from .common import Scratch

FRACTION = 1 / 64
LEAST = 16
WIDTH = 5
TOP = 2**64 - 1


def sketches(texts: list[bytes], fraction: float = FRACTION, least: int = LEAST, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted kept hashes of each text."""
    h, row = Words(texts).shingles(width)
    edge = bounds(row, len(texts))
    limit = U(int(fraction * 2.0**64))
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        all_of = np.unique(h[a:b])
        out.append(all_of[: max(least, int(np.searchsorted(all_of, limit)))])
    return out


def threshold(s: np.ndarray, fraction: float = FRACTION, least: int = LEAST) -> int:
    """The sketch holds all hashes of its text up to this one."""
    return TOP if len(s) < least else max(int(fraction * 2.0**64), int(s[least - 1]))


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    both = np.union1d(a, b)
    return both[both <= U(min(threshold(a), threshold(b)))]


def _common(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    t = U(min(threshold(a), threshold(b)))
    a, b = a[: np.searchsorted(a, t, "right")], b[: np.searchsorted(b, t, "right")]
    return len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if not len(a) and not len(b):
        return 1.0
    both, m, n = _common(a, b)
    return both / (m + n - both) if m + n - both else 0.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    both, m, _ = _common(a, b)
    return both / m if m else 0.0


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s or ""), "<u8")


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns, with `fingerprint`; a column of that name is replaced."""
    kept = [c for c in df.columns if c != "fingerprint"]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            raw = [x or b"" for x in batch.column(len(kept)).to_pylist()]
            for a, b in row_chunks(raw):
                made = [to_text(s) for s in sketches(raw[a:b])]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(made, pa.string())], names=[*kept, "fingerprint"])

    return df.select(*kept, F.col(text).cast("binary").alias("_t")).mapInArrow(run, schema)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(df: DataFrame, per_range: int = 2000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text and its edited text (its last third replaced by the start of the next text, by descending id; after the
    last the first), fingerprinted and compared.

    Texts are dealt once, by ranges of ids; the first text of each range also goes to the range before it, so no window
    runs over all rows. Null ids count as smallest; texts of one id follow each other by their hash.
    """
    spark = df.sparkSession
    store = Scratch(spark, "fingerprint")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    parts = max(1, min(20000, n // per_range))
    ids = rows.select(key.cast("double").alias("k"))
    # quantiles are doubles: near the ends of 64 bits they are held within them; any cuts do
    cuts = sorted({max(-(2**63), min(2**63 - 1, int(x))) for x in ids.approxQuantile("k", [i / parts for i in range(1, parts)], 0.1 / parts if parts < 1000 else 1e-4)}) if parts > 1 else []
    cut_table = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("long")
    def range_of(k):
        return pd.Series(len(cut_table.value) - np.searchsorted(cut_table.value, k.to_numpy(np.int64), "right"))

    dealt = rows.select("doc_id", "t", key.alias("k"), range_of(key).alias("g"))
    # The first row of each range, by descending id, then by hash: one row a range (parts of them).
    firsts = store.keep(dealt.groupBy("g").agg(F.max("k").alias("k")))
    wanted = firsts.select(F.row_number().over(Window.orderBy("g")).alias("place"), "g", "k")
    count = firsts.count()
    nexts = wanted.select("g", "k", F.when(F.col("place") == 1, F.lit(count)).otherwise(F.col("place") - 1).alias("place"))
    guests = nexts.join(wanted.select("place", F.col("g").alias("to")), "place").select("k", F.col("to"), F.col("g").alias("own"))
    lent = guests.collect()  # at most 20,000 rows of three numbers
    at_k: dict[int, int] = {r["k"]: r["to"] for r in lent}
    lend = spark.sparkContext.broadcast(at_k)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            k = batch.column("k").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([False] * len(k))], names=[*batch.schema.names, "guest"])
            pick = [i for i, x in enumerate(k) if x in lend.value]
            if pick:
                some = batch.take(pa.array(pick))
                to = pa.array([lend.value[k[i]] for i in pick], pa.int64())
                cols = [to if name == "g" else some.column(name) for name in some.schema.names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([True] * len(pick))], names=[*batch.schema.names, "guest"])

    spread = dealt.mapInArrow(deal, "doc_id long, t string, k long, g long, guest boolean")
    sorted_rows = (
        spread.withColumn("tie", F.xxhash64("t"))
        .repartition("g")
        .sortWithinPartitions("g", "guest", F.desc("k"), "tie", "t")
        .select("doc_id", F.col("t"), "g", "guest")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose next is still to come
        for batch in small(batches):
            pairs: list[tuple[int | None, str, str]] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                _, t, g, guest = row
                if held is not None and held[2] == g:
                    pairs.append((held[0], held[1], t))
                held = None if guest else row
            yield from compare(pairs)

    def compare(pairs: list[tuple[int | None, str, str]]) -> Iterator[pa.RecordBatch]:
        a = size = 0
        for i, (_, t, u) in enumerate(pairs):
            size += len(t) + len(u)
            if size > 1 << 21 or i == len(pairs) - 1:
                yield results(pairs[a : i + 1])
                a, size = i + 1, 0

    def results(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        own, edited = [], []
        for _, t, u in pairs:
            k = len(t) // 3
            own.append(t.encode())
            edited.append((t[: len(t) - k] + u[:k]).encode())
        a, b = sketches(own), sketches(edited)
        # the next text mostly is the next row's own
        c = [a[i + 1] if i + 1 < len(pairs) and pairs[i + 1][1] == u else sketches([u.encode()])[0] for i, (_, _, u) in enumerate(pairs)]
        cols = [
            pa.array([p[0] for p in pairs], pa.int64()),
            pa.array([len(p[1]) for p in pairs], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
            pa.array([to_text(s) for s in a]),
            pa.array([to_text(s) for s in b]),
            pa.array([likeness(x, y) for x, y in zip(a, b, strict=True)], pa.float64()),
            pa.array([likeness(x, y) for x, y in zip(a, c, strict=True)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCHEMA.split(", ")])

    return sorted_rows.mapInArrow(run, SCHEMA)
