"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts (language, bucket) in each task and adds them up in one shuffle of at most languages x buckets rows a task;
the log-probability matrix has that fixed bound and is broadcast. Prediction sums matrix rows over all n-grams of a text.

Results: text null or without a letter: `und`, score 0. Rows whose language is null teach nothing; a corpus with no
labelled row gives `und`, score 0 for all. Ties go to the first language in order. Repeated rows and null ids are kept as
they are; columns named lang_pred or score are replaced, all others kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import U, mix, row_chunks, small
from .common import fresh

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
PIECE = 1 << 18  # bytes, or code points of a longer text, that are counted at a time
LANGUAGES = 1000  # the matrix has at most LANGUAGES x BUCKETS cells


def clean(text: str | Column) -> Column:
    """Lower case; each run of anything but letters and marks is one space."""
    return F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), r"[^\p{L}\p{M}]+", " ")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, the text of each). A text is framed by spaces."""
    framed = [(b" " + t + b" ").decode("utf-8", "replace") for t in texts]
    size = np.fromiter(map(len, framed), np.int64, len(texts))
    return _grams(np.frombuffer("".join(framed).encode("utf-32-le"), np.uint32), size, size)


def _grams(cp: np.ndarray, size: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end, the n-grams that begin at one of the first `own` places of each."""
    end = np.cumsum(size)
    last = np.repeat(end, size)  # where the text of each code point ends
    until = np.repeat(end - size + own, size)
    at = np.arange(len(cp))
    out, where = [], []
    h = np.zeros(len(cp), U)
    for n in range(1, max(ORDERS) + 1):
        m = len(cp) - n + 1
        if m <= 0:
            break
        h = h[:m] * U(0x110001) + cp[n - 1 :] + U(1)
        if n in ORDERS:
            ok = (at[:m] + n <= last[:m]) & (at[:m] < until[:m])
            out.append((mix(h[ok]) & U(BUCKETS - 1)).astype(np.int32))
            where.append(np.searchsorted(end, at[:m][ok], "right"))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out).astype(np.int64), np.concatenate(where)


def pieces(raw: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, buckets, text of each) of some texts at a time; a text of more than PIECE bytes comes in several pieces, so that
    what a task holds doesn't grow with it."""
    for a, b in row_chunks(raw, PIECE):
        if b - a > 1 or len(raw[a]) <= PIECE:
            yield a, b, *grams(raw[a:b])
            continue
        text = (b" " + raw[a] + b" ").decode("utf-8", "replace")
        for i in range(0, len(text), PIECE):
            part = np.frombuffer(text[i : i + PIECE + max(ORDERS) - 1].encode("utf-32-le"), np.uint32)
            yield a, b, *_grams(part, np.array([len(part)]), np.array([min(PIECE, len(part))]))


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(x, return_counts=True)


def train(df: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, matrix of log-probabilities by bucket and language), from all rows with a language."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    names = sorted(r[0] for r in rows.select(lang).distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    place = {x: i for i, x in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS), np.int64)
        for batch in small(batches):
            raw = [x or b"" for x in batch.column(0).to_pylist()]
            tag = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for a, _, bucket, row in pieces(raw):
                np.add.at(total.reshape(-1), *_counted(tag[a + row] * BUCKETS + bucket))
        one, two = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int32()), pa.array(two, pa.int32()), pa.array(total[one, two], pa.int64())], names=["l", "b", "n"])

    found = rows.select(clean(text).cast("binary").alias("t"), lang).mapInArrow(count, "l int, b int, n long")
    sums = found.groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas() if names else pd.DataFrame({"l": [], "b": [], "n": []})
    counts = np.zeros((BUCKETS, len(names)))
    counts[sums["b"].to_numpy(int), sums["l"].to_numpy(int)] = sums["n"]
    total = counts.sum(axis=0) + smoothing * BUCKETS
    return names, np.log(counts + smoothing) - np.log(total)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """All columns, with lang_pred and score: the posterior probability under equal priors, evidence taken per 64 n-grams."""
    names, matrix = model
    shared = df.sparkSession.sparkContext.broadcast(matrix.astype(np.float32))
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    told = fresh(df, "_told")[0]
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    k = len(names)

    def some(raw: list[bytes], table: np.ndarray) -> pa.StructArray:
        best, score = np.full(len(raw), -1), np.zeros(len(raw))
        if k and raw:
            n, like = np.zeros(len(raw), np.int64), np.zeros((len(raw), k))
            for a, b, bucket, row in pieces(raw):
                n[a:b] += np.bincount(row, minlength=b - a)
                for j in range(k):
                    like[a:b, j] += np.bincount(row, weights=table[bucket, j], minlength=b - a)
            like /= np.maximum(1, n / 64)[:, None]
            p = np.exp(like - like.max(axis=1, keepdims=True))
            best[:], score[:] = p.argmax(axis=1), 1 / p.sum(axis=1)
        no = np.array([not t.strip() for t in raw], bool) | (best < 0)
        score[no] = 0
        lang = ["und" if x else names[i] for x, i in zip(no.tolist(), best.tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], names=["lang_pred", "score"])

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [some([x or b"" for x in texts.slice(a, 512).to_pylist()], shared.value) for a in range(0, len(texts), 512)]
            yield pa.concat_arrays(parts) if parts else some([], shared.value)

    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    cleaned = F.when(has_letter, clean(text)).cast("binary")
    # Only the cleaned text goes to Python, only the two values come back. Called nondeterministic, or a filter on them would
    # be moved below and each text predicted twice.
    return df.select(*kept, run.asNondeterministic()(cleaned).alias(told)).select(*kept, F.col(told)["lang_pred"].alias("lang_pred"), F.col(told)["score"].alias("score"))
