"""Embedding near-dedup: an epsilon grid order join.

Vectors are rotated to their principal dimensions and sorted by grid cells of side epsilon on the leading ones. The sorted
sequence is cut into blocks of about BLOCK_BYTES; pairs of blocks whose bounding boxes (all rotated dimensions) are further
apart than epsilon are skipped, the others are joined by halving both intervals again and again, skipping halves that are
provably distant and counting halves that are provably close without looking at their pairs. A block pair yields counts
and a spanning forest of its links, never the pairs themselves. Equal vectors are joined once, with their number.

Results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, link with
nothing. Vectors of different lengths don't link. Repeated rows count as vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

BLOCK_BYTES = 1 << 20
LEAF = 512
CELLS = 6


HUGE = 1e100


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def principal(vectors: DataFrame) -> dict[int, np.ndarray]:
    """An orthonormal basis for each vector length, leading dimension first, from the moments of all unit vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array(batch.column(0).to_pylist())
            for d in np.unique(dims).tolist():
                x = _matrix(batch.column(1).filter(pa.array(dims == d)), d).astype(np.float64)
                x = np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(len(x))]
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], names=["dim", "i", "j", "s"])

    sums = vectors.select("dim", "v").mapInArrow(moments, "dim long, i long, j long, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toPandas()  # (length + 1)^2 rows
    out = {}
    for d, part in sums.groupby("dim"):
        d = int(d)
        m = np.zeros((d + 1, d + 1))
        m[part["i"].to_numpy(), part["j"].to_numpy()] = part["s"]
        mean = m[:d, d] / m[d, d]
        _, basis = np.linalg.eigh(m[:d, :d] / m[d, d] - np.outer(mean, mean))
        out[d] = np.ascontiguousarray(basis[:, ::-1])
    return out


class _Side:
    """A block: unit vectors in principal dimensions, exact vectors, ids and numbers of copies."""

    def __init__(self, ids: bytes, copies: bytes, data: bytes, dim: int, kind: str, basis: np.ndarray):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        x = np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64)
        self.x = x
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        self.z = (x / self.norm[:, None]) @ basis
        self.z32 = self.z.astype(np.float32)
        self.count = np.zeros(len(x), np.int64)
        self.label = self.ids.copy()
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            self.boxes[a, b] = self.z[a:b].min(axis=0), self.z[a:b].max(axis=0)
        return self.boxes[a, b]


def _spread(p: _Side, q: _Side, i: np.ndarray, j: np.ndarray, edges: list[tuple[int, int]]) -> None:
    """Carry the smallest label over the links (i, j); each changed label is an edge of the forest."""
    pi, qj = np.unique(i), np.unique(j)
    old_p, old_q = p.label[pi].copy(), q.label[qj].copy()
    while True:
        low = np.minimum(p.label[i], q.label[j])
        if (low == p.label[i]).all() and (low == q.label[j]).all():
            break
        np.minimum.at(p.label, i, low)
        np.minimum.at(q.label, j, low)
    for side, rows, old in ((p, pi, old_p), (q, qj, old_q)):
        new = side.label[rows]
        edges += [(x, y) for x, y in zip(side.ids[rows[new != old]].tolist(), new[new != old].tolist(), strict=True)]


def _join(p: _Side, q: _Side, cosine: float, same: bool, edges: list[tuple[int, int]]) -> None:
    eps2 = 2 - 2 * cosine
    todo = [(0, len(p.ids), 0, len(q.ids))]
    while todo:
        a, b, c, d = todo.pop()
        if same and c < a:
            continue
        (l1, h1), (l2, h2) = p.box(a, b), q.box(c, d)
        gap = np.maximum(0, np.maximum(l1 - h2, l2 - h1))
        if gap @ gap > eps2 + 1e-9:
            continue
        wide = np.maximum(h1 - l2, h2 - l1)
        if wide @ wide < eps2 - 1e-9 and not (same and (a, b) == (c, d)):
            p.count[a:b] += q.copies[c:d].sum()
            q.count[c:d] += p.copies[a:b].sum()
            # all link: a star through one of each side
            _spread(p, q, np.arange(a, b), np.full(b - a, c), edges)
            _spread(p, q, np.full(d - c, a), np.arange(c, d), edges)
            continue
        if b - a <= LEAF and d - c <= LEAF:
            near = p.z32[a:b] @ q.z32[c:d].T >= cosine - 1e-4
            if same and a == c:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = i + a, j + c
            exact = np.concatenate([np.einsum("ij,ij->i", p.x[i[k : k + 65536]], q.x[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)])
            ok = exact / (p.norm[i] * q.norm[j]) >= cosine
            i, j = i[ok], j[ok]
            if len(i):
                np.add.at(p.count, i, q.copies[j])
                np.add.at(q.count, j, p.copies[i])
                _spread(p, q, i, j, edges)
            continue
        m, n = (a + b) // 2, (c + d) // 2
        left = [(a, m), (m, b)] if b - a > LEAF else [(a, b)]
        right = [(c, n), (n, d)] if d - c > LEAF else [(c, d)]
        todo += [(*x, *y) for x in left for y in right]


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row for each row of df: (id, n_links, component): the number of other vectors with cosine >= `cosine`, and the
    smallest id reachable by links."""
    spark = df.sparkSession
    store = Scratch(spark, "egojoin")
    kind = "<f4" if "float" in dict(df.dtypes)[vector] else "<f8"
    element = "float" if kind == "<f4" else "double"
    v = F.col(vector).cast(f"array<{element}>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & (F.size("v") > 0)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    if element == "double":  # squares of such numbers aren't within doubles; powers of two change no cosine
        top = F.array_max(F.transform("v", F.abs))
        half = F.pow(F.lit(2.0), -F.floor(F.log2(top) / 2))
        rows = rows.withColumn("v", F.when((top > HUGE) | ((top > 0) & (top < 1 / HUGE)), F.transform("v", lambda x: x * half * half)).otherwise(F.col("v")))
    named = rows.withColumn("fine", F.coalesce(F.col("v").isNotNull() & fine & F.col("id").isNotNull(), F.lit(False)))
    named = named.withColumns({"k1": F.when(F.col("fine"), F.xxhash64("v")), "k2": F.when(F.col("fine"), F.xxhash64(F.lit(7), "v"))})
    reps = store.keep(named.where("fine").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")).withColumn("dim", F.size("v").cast("long")))
    bases = spark.sparkContext.broadcast(principal(reps))
    eps = float(np.sqrt(2 - 2 * cosine))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist())
            cells = np.zeros((len(dims), CELLS), np.int64)
            for d in np.unique(dims).tolist():
                pick = np.flatnonzero(dims == d)
                x = _matrix(batch.column("v").take(pa.array(pick)), d).astype(np.float64)
                z = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ bases.value[d][:, :CELLS]
                cells[pick, : z.shape[1]] = np.floor(z / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, i]) for i in range(CELLS))], names=[*batch.schema.names, *grid])

    grid = [f"g{i}" for i in range(CELLS)]
    placed = reps.select("rep", "copies", "v", "dim").mapInArrow(place, f"rep long, copies long, v array<{element}>, dim long, " + ", ".join(f"{g} long" for g in grid))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, int]] = []

        def block() -> pa.RecordBatch:
            dim, first = held[0][3], held[0][0]
            data = b"".join(r[2] for r in held)
            x = np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64)
            z = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ bases.value[dim]
            low, high = z.min(axis=0), z.max(axis=0)
            ids, copies = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)
            one = [[first], [dim], [ids.tobytes()], [copies.tobytes()], [data], [low.tolist()], [high.tolist()], [int(np.floor(low[0] / eps))], [int(np.floor(high[0] / eps))]]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, types, strict=True)], names=["block", "dim", "ids", "copies", "data", "low", "high", "from_cell", "to_cell"])

        for batch in batches:
            flat, at = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind), 0
            for rep, copies, dim in zip(*(batch.column(c).to_pylist() for c in ("rep", "copies", "dim")), strict=True):
                if held and (held[0][3] != dim or len(held) * len(held[0][2]) >= BLOCK_BYTES):
                    yield block()
                    held.clear()
                held.append((rep, copies, flat[at : at + dim].tobytes(), dim))
                at += dim
        if held:
            yield block()

    packed = placed.repartitionByRange("dim", *grid, "rep").sortWithinPartitions("dim", *grid, "rep").mapInArrow(pack, "block long, dim long, ids binary, copies binary, data binary, low array<double>, high array<double>, from_cell long, to_cell long")
    blocks = store.keep(packed)
    marks = blocks.select("block", "dim", "low", "high", "from_cell", "to_cell")
    one = marks.select(F.col("block").alias("a"), "dim", F.col("low").alias("l1"), F.col("high").alias("h1"), F.explode(F.sequence("from_cell", "to_cell")).alias("cell"))
    two = marks.select(F.col("block").alias("b"), "dim", F.col("low").alias("l2"), F.col("high").alias("h2"), F.explode(F.sequence(F.col("from_cell") - 1, F.col("to_cell") + 1)).alias("cell"))
    square = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.greatest(F.lit(0.0), p - q)), F.lit(0.0), lambda s, g: s + g * g)
    pairs = one.join(two, ["dim", "cell"]).where("a <= b").where(square("l1", "h2") + square("l2", "h1") <= eps * eps + 1e-9).select("a", "b").distinct()
    data = lambda s: blocks.select(F.col("block").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("ids", "copies", "data")), *([F.col("dim")] if s == "a" else []))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                basis, same = bases.value[r["dim"]], r["a"] == r["b"]
                p = _Side(r["ids_a"], r["copies_a"], r["data_a"], r["dim"], kind, basis)
                q = p if same else _Side(r["ids_b"], r["copies_b"], r["data_b"], r["dim"], kind, basis)
                edges: list[tuple[int, int]] = []
                _join(p, q, cosine, same, edges)
                got = [(int(i), None, int(n)) for s in ((p,) if same else (p, q)) for i, n in zip(s.ids[s.count > 0], s.count[s.count > 0], strict=True)]
                got += [(a, b, 0) for a, b in set(edges)]
                a, b, n = zip(*got, strict=True) if got else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    found = store.keep(pairs.join(data("a"), "a").join(data("b"), "b").mapInArrow(compare, "a long, b long, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    parts = components(found.where("b is not null").select("a", "b"), store).withColumnRenamed("id", "rep")
    known = reps.select("k1", "k2", "rep", "copies").join(counts, "rep", "left").join(parts, "rep", "left")
    all_rows = named.select("id", "k1", "k2").join(known, ["k1", "k2"], "left")
    n_links = F.coalesce(F.coalesce("others", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long")
    return all_rows.select("id", n_links.alias("n_links"), F.coalesce("component", "rep", "id").alias("component"))
