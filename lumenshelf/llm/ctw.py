"""LM scoring by context-tree weighting.

A text is its lower-cased words, each followed by one space, the last by an end byte. Each byte is eight binary decisions, most
significant first; each decision has a context tree over the DEPTH bytes before it. A node's weighted probability mixes
its Krichevsky-Trofimov estimate with the product of its children's, one half each, so the prediction for a bit mixes the
estimates of all depths by their posterior weights. Contexts that the training texts don't have are left out of the
mixture for both values of a bit alike. The code length of a text is the sum over its bits.

Texts are dealt to blocks of about BLOCK_BYTES. A block sends each distinct (context, byte) and each distinct word once, with
its training count; counts are added up by key, trees are worked out per two last context bytes, and each block gets back
the values of its own keys, with which it scores its texts. So what is shuffled grows with the corpus, and no table of the
whole corpus is ever in one place. Words are named by 64-bit hashes.

Results: text null, empty or without words is just the end. Without training texts every bit has probability 1/2. Repeated
rows are scored each, and count each in training. Rows with null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import U, Words, mix, ragged, row_chunks, signed
from .common import Scratch

DEPTH = 5
BLOCK_BYTES = 24 << 20
CHUNK = 1 << 18
SEEN = "block long, kind int, key long, n long"


def encode(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, Words]:
    """(codes, row of each, words): a code holds `depth` bytes of context, the last lowest, above the byte itself."""
    w = Words(texts)
    n = len(texts)
    size = w.end - w.start + 1
    empty = np.flatnonzero(w.counts == 0)
    total = np.bincount(w.doc, weights=size, minlength=n).astype(np.int64) + depth
    total[empty] = depth + 1
    first = np.cumsum(total) - total
    out = np.full(int(total.sum()), 10, np.uint8)
    if len(size):
        within = np.cumsum(size) - size
        at = first[w.doc] + depth + within - within[w.first[w.doc]]
        body = size - 1
        out[ragged(at, body)] = w.buf[ragged(w.start, body)]
        last = np.r_[w.doc[1:] != w.doc[:-1], True]
        out[(at + body)[~last]] = 32
    code = np.zeros(len(out), U)
    for back in range(depth, -1, -1):
        code[depth:] |= out[depth - back : len(out) - back].astype(U) << U(8 * back)
    take = ragged(first + depth, total - depth)
    return code[take], np.repeat(np.arange(n), total - depth), w


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1/2, by Stirling's series eight places further."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    a, b = n0.astype(np.float64), n1.astype(np.float64)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - 2 * 0.5723649429247001


HALF = np.log(0.5)


def bits(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(8, n) arrays: the prefix of earlier bits with a leading 1, and the bit."""
    b = np.arange(8)[:, None]
    return (1 << b) | (sym >> (8 - b)), (sym >> (7 - b)) & 1


class Level:
    """The nodes of one depth: sorted ids (context and bit prefix), counts, weighted log-probability, weight of the children."""

    def __init__(self, ids: np.ndarray, bit: np.ndarray, n: np.ndarray):
        self.ids, self.at = np.unique(ids, return_inverse=True)
        self.at = self.at.reshape(ids.shape)
        one = np.bincount(self.at.ravel(), (n * bit).ravel(), len(self.ids))
        self.n = np.stack([np.bincount(self.at.ravel(), np.broadcast_to(n, bit.shape).ravel(), len(self.ids)) - one, one])
        self.kt = log_kt(self.n[0], self.n[1])
        self.weighted = self.kt
        self.deeper = np.zeros(len(self.ids))

    def mix(self, child: Level, parent_of: np.ndarray) -> None:
        below = np.bincount(parent_of, child.weighted, len(self.ids))
        self.weighted = np.logaddexp(HALF + self.kt, HALF + below)
        self.deeper = np.exp(HALF + below - self.weighted)

    def estimate(self, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each decision: whether the node was seen, the estimate of its bit, the weight of deeper nodes."""
        n0, n1 = self.n[0][self.at], self.n[1][self.at]
        return n0 + n1 > 0, (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1), self.deeper[self.at]


def levels(code: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[dict[int, Level], np.ndarray]:
    """Levels top..depth of the trees of all codes, which share their last `top` context bytes or stand for all; and the bits."""
    ctx, sym = code >> 8, code & 255
    prefix, bit = bits(sym)
    out: dict[int, Level] = {}
    for d in range(depth, top - 1, -1):
        ids = ((ctx & ((1 << 8 * d) - 1)) << 8) | prefix
        now = out[d] = Level(ids, bit, n)
        if d < depth:
            child = out[d + 1]
            up = np.empty(len(child.ids), np.int64)
            up[child.at.ravel()] = now.at.ravel()
            now.mix(child, up)
    return out, bit


def blend(pred: np.ndarray, known: np.ndarray, seen: np.ndarray, own: np.ndarray, deeper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One depth further up."""
    mixed = np.where(known, (1 - deeper) * own + deeper * pred, own)
    return np.where(seen, mixed, pred), known | seen


class Roots:
    """Depths 1 and 0, from the sums over depth 2: arrays by last byte and prefix."""

    def __init__(self, rows: pd.DataFrame):
        n, w = np.zeros((2, 256, 256)), np.zeros((256, 256))
        x, p = rows["x"].to_numpy(int), rows["prefix"].to_numpy(int)
        n[0, x, p], n[1, x, p], w[x, p] = rows["n0"], rows["n1"], rows["w"]
        self.n1, self.n0 = n, n.sum(axis=1)
        kt = log_kt(n[0], n[1])
        one = np.logaddexp(HALF + kt, HALF + w)
        self.deeper1 = np.exp(HALF + w - one)
        below = np.where(n.sum(axis=0) > 0, one, 0).sum(axis=0)
        zero = np.logaddexp(HALF + log_kt(self.n0[0], self.n0[1]), HALF + below)
        self.deeper0 = np.exp(HALF + below - zero)

    def finish(self, pred: np.ndarray, known: np.ndarray, x: np.ndarray, prefix: np.ndarray, bit: np.ndarray) -> np.ndarray:
        for n, deeper in ((self.n1[:, x, prefix], self.deeper1[x, prefix]), (self.n0[:, prefix], self.deeper0[prefix])):
            pred, known = blend(pred, known, n.sum(axis=0) > 0, (np.where(bit, n[1], n[0]) + 0.5) / (n.sum(axis=0) + 1), deeper)
        return pred


class Table:
    """Open addressing over distinct 64-bit keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys) * 2 + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self.home(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & (len(self.slots) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, all of which are there."""
        at = self.home(keys)
        out = self.slots[at]
        todo = np.flatnonzero(self.keys[out] != keys)
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            out[todo] = self.slots[at[todo]]
            todo = todo[self.keys[out[todo]] != keys[todo]]
        return out


class Counts:
    """Counts by key. Parts are added up once they outgrow what is held, so memory follows the distinct keys."""

    def __init__(self, least: int = 1 << 18):
        self.keys, self.n = np.zeros(0, U), np.zeros(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting, self.least = 0, least

    def add(self, keys: np.ndarray, weight: int) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n * weight))
        self.waiting += len(k)
        if self.waiting > max(self.least, len(self.keys)):
            self.fold()

    def fold(self) -> Counts:
        keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
        n = np.concatenate([self.n, *(x for _, x in self.parts)])
        self.parts, self.waiting = [], 0
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else order
        self.keys, self.n = keys[first], np.add.reduceat(n, first) if len(keys) else n
        return self


def _text_chunks(texts: pa.ChunkedArray) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows with their texts; only one range is held as Python objects."""
    size = pc.binary_length(texts).to_numpy()
    for a, b in row_chunks(size, CHUNK, int):
        yield a, b, texts.slice(a, b - a).to_pylist()


def score(df: DataFrame, train: str | Column, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of df: (doc_id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte).
    train: whether a row's text is learned from (null: no). score and base_score are log10 probabilities."""
    spark = df.sparkSession
    store = Scratch(spark, "ctw")
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(train) if isinstance(train, str) else train, F.lit(False)).alias("learn"))
    size, n_train = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count(F.when(F.col("learn"), 1))).first()
    n_blocks = max(1, -(-size // block_bytes))
    dealt = rows.select(F.pmod(F.xxhash64("id", "t"), F.lit(n_blocks)).alias("block"), "id", "learn", F.col("t").cast("binary").alias("t"))

    def survey(group: pa.Table) -> pa.Table:
        block = group["block"][0].as_py()
        learn = group["learn"].to_numpy()
        codes, words = Counts(), Counts()
        for a, b, raw in _text_chunks(group["t"]):
            code, row, w = encode(raw)
            for got, keys, rows_of in ((codes, code, row), (words, w.hash, w.doc)):
                tag = learn[a:b][rows_of]
                got.add(keys[tag], 1)
                got.add(keys[~tag], 0)
        (k0, n0), (k1, n1) = ((x.keys, x.n) for x in (codes.fold(), words.fold()))
        pa.default_memory_pool().release_unused()
        kind = np.r_[np.zeros(len(k0), np.int32), np.ones(len(k1), np.int32)]
        return pa.table([pa.array(np.full(len(kind), block)), pa.array(kind), pa.array(signed(np.r_[k0, k1])), pa.array(np.r_[n0, n1])], names=["block", "kind", "key", "n"])

    seen = store.keep(dealt.groupBy("block").applyInArrow(survey, SEEN))
    store.release()
    totals = store.keep(seen.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    grams, words = totals.where("kind = 0"), totals.where("kind = 1")
    n_words, n_distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    n_all, n_distinct = n_words + n_train, n_distinct + (1 if n_train else 0)
    pair = F.shiftright(F.col("key"), 8).bitwiseAND(0xFFFF)

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        code = group["key"].to_numpy(np.int64)
        two = levels(code, group["n"].to_numpy(np.int64), DEPTH, 2)[0][2]
        return pd.DataFrame({"x": (two.ids >> 8) & 255, "prefix": two.ids & 255, "n0": two.n[0], "n1": two.n[1], "w": two.weighted})

    by_pair = grams.withColumn("pair", pair).groupBy("pair")
    upper = by_pair.applyInPandas(sums, "x long, prefix long, n0 double, n1 double, w double")
    roots = spark.sparkContext.broadcast(Roots(upper.groupBy("x", "prefix").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("w").alias("w")).toPandas()))  # 65,536 rows at most

    def predict(group: pd.DataFrame) -> pd.DataFrame:
        code = group["key"].to_numpy(np.int64)
        found, bit = levels(code, group["n"].to_numpy(np.int64), DEPTH, 2)
        pred, known = np.full(bit.shape, 0.5), np.zeros(bit.shape, bool)
        for d in range(DEPTH, 1, -1):
            pred, known = blend(pred, known, *found[d].estimate(bit))
        prefix = bits(code & 255)[0]
        pred = roots.value.finish(pred, known, np.broadcast_to((code >> 8) & 255, prefix.shape), prefix, bit)
        return pd.DataFrame({"kind": 0, "key": code, "value": np.log10(pred).sum(axis=0)})

    # log-probabilities of codes, counts of words
    values = by_pair.applyInPandas(predict, "kind int, key long, value double")
    both = store.keep(values.union(words.select("kind", "key", F.col("n").cast("double").alias("value"))))
    store.drop(totals)
    store.release()
    back = seen.select("block", "kind", "key").join(both, ["kind", "key"])
    scale = n_all + 0.1 * (n_distinct + 1)
    end_base = float(np.log10((n_train + 0.1) / scale))

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right["kind"].to_numpy()
        key, value = right["key"].to_numpy(), right["value"].to_numpy()
        code_of, word_of = (Table(key[kind == k].view(U)) for k in (0, 1))
        code_value, word_known = value[kind == 0], value[kind == 1] > 0
        word_value = np.log10((value[kind == 1] + 0.1) / scale)
        out = []
        for a, b, raw in _text_chunks(left["t"]):
            n = b - a
            code, row, w = encode(raw)
            at = word_of.find(w.hash) if len(w.hash) else np.zeros(0, np.int64)
            out.append([w.counts + 1, np.bincount(w.doc, word_known[at], n) + (n_train > 0), np.bincount(w.doc, word_value[at], n) + end_base, np.bincount(row, code_value[code_of.find(code)], n), np.bincount(row, minlength=n)])
        tokens, hits, base_score, total, size = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0)] * 5
        pa.default_memory_pool().release_unused()
        cols = [left["id"], left["learn"], pa.array(tokens.astype(np.int64)), pa.array(hits.astype(np.int64)), pa.array(np.full(len(left), n_all)), pa.array(base_score), pa.array(total), pa.array(size.astype(np.int64)), pa.array(-total / np.log10(2) / size)]
        return pa.table(cols, names=names)

    names = ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    schema = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(judge, schema)
