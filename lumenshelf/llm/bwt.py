"""Exact substring dedup through merged Burrows-Wheeler transforms.

Two equal strings of `length` bytes have equal 40-byte grams of least hash (anchors) at the same place, so texts are first
cut to segments: the windows of a text that have one anchor in common, with the bytes they cover. Segments whose anchor
occurs once can't repeat and go no further. The others meet by anchor, where segments equal to an earlier one (by 64-bit
hashes of anchor and segment) are repeats as a whole. Distinct segments that share an anchor are collected to shards; each shard's transform comes from a suffix sort of that shard, and shard transforms are
merged by refining their interleave: each turn deals the rows stably by the two symbols before them, so after t turns rows
are ordered by 2t bytes, without comparing suffixes again. Rows that no turn has told apart share a prefix of `length`
bytes: the repeated intervals, in which all but the earliest start are removed.

Results: text null or empty: 0 bytes, nothing removed. Matches within one text count too. Ids order the texts and are taken
as unique; rows repeated whole count as one document and all get its result. Rows with a null id match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, hash_slices, mix, ragged, row_chunks, signed, small
from .common import Scratch

LENGTH = 100
GRAM = 40
SHARD = 1 << 18
TOGETHER = 1 << 20  # bytes of shards merged at once; a larger group of segments is merged alone


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor hash, hash of all bytes) of each segment: starts of `length`-byte windows with one anchor."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    n = len(buf) - 8
    wide = length - GRAM + 1
    if n < length:
        return *(np.zeros(0, np.int64),) * 3, np.zeros(0, U), np.zeros(0, U)
    lanes = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    m = n - GRAM + 1
    h = mix(lanes[:m] + U(GRAM))
    for at in range(8, GRAM, 8):
        h = mix(h * U(0x9E3779B97F4A7C15) + lanes[at : at + m])
    low = (h & ~U(0xFFFFFF)) | np.arange(m, dtype=U)  # the leftmost of equal hashes; chunks have fewer than 2**24 bytes
    reach = 1
    while 2 * reach <= wide:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < wide:
        low = np.minimum(low[: len(low) - (wide - reach)], low[wide - reach :])
    starts = np.maximum(0, size - length + 1)
    at = ragged(begin, starts)
    row = np.repeat(np.arange(len(texts)), starts)
    spot = (low[at] & U(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | (row[1:] != row[:-1])]) if len(at) else at
    last = np.r_[new[1:], len(at)] - 1
    whole = hash_slices(buf, at[new], at[last] - at[new] + length)
    return row[new], at[new] - begin[row[new]], at[last] - begin[row[new]], h[spot[new]], whole


def long_anchors(text: bytes, length: int, piece: int = 1 << 23) -> tuple[np.ndarray, ...]:
    """anchors() of one very long text, in overlapping pieces; a segment at a seam may come in two parts, which is harmless."""
    parts = []
    for a in range(0, max(1, len(text) - length + 1), piece):
        _, s, e, k, x = anchors([text[a : a + piece + length - 1]], length)
        parts.append((s + a, e + a, k, x))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


class Shard:
    """Segments laid end to end, two end bytes after each, sorted as cyclic strings to `length` bytes or more."""

    def __init__(self, segments: list[bytes], length: int):
        size = np.fromiter(map(len, segments), np.int64, len(segments)) + 2
        first = np.cumsum(size) - size
        buf = np.frombuffer(b"\0\0".join(segments) + b"\0\0", np.uint8)
        n = len(buf)
        at = np.arange(n)
        seg = np.repeat(np.arange(len(segments)), size)
        where = at - first[seg]
        ahead = lambda k: first[seg] + (where + k) % size[seg]
        key = np.zeros(n, U)
        for k in range(8):
            key = (key << U(8)) | buf[ahead(k)]
        rank = np.unique(key, return_inverse=True)[1]
        reach = 8
        while reach < length and rank.max() + 1 < n:
            rank = np.unique(rank.astype(np.int64) * n + rank[ahead(reach)], return_inverse=True)[1]
            reach *= 2
        self.order = np.argsort(rank, kind="stable")
        before = buf[ahead(-2 % size[seg])].astype(np.uint16) * 256 + buf[ahead(-1 % size[seg])]
        self.transform = before[self.order]
        self.segment, self.place = seg[self.order], where[self.order]
        self.segments = len(segments)


def merge(shards: list[Shard], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, place, group) of all rows of all shards: rows of one group have `length` bytes in common."""
    rows = [len(s.transform) for s in shards]
    flat = np.concatenate([s.transform for s in shards])
    kind = np.uint8 if len(shards) <= 256 else np.uint16 if len(shards) <= 65536 else np.int64
    weave = np.repeat(np.arange(len(shards)), rows).astype(kind)
    group = np.zeros(len(flat), np.int64)
    symbol = np.empty_like(flat)
    for _ in range(-(-length // 2)):
        symbol[np.argsort(weave, kind="stable") if len(shards) > 1 else slice(None)] = flat
        order = np.argsort(symbol, kind="stable")
        dealt, old = symbol[order], group[order]
        group = np.zeros(len(flat), np.int64)
        np.cumsum((dealt[1:] != dealt[:-1]) | (old[1:] != old[:-1]), out=group[1:])
        weave = weave[order]
    place = np.argsort(weave, kind="stable")
    offset = np.cumsum([0, *(s.segments for s in shards)])
    return np.concatenate([s.segment + o for s, o in zip(shards, offset, strict=False)]), np.concatenate([s.place for s in shards]), group[place]


def repeats(segments: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """Of distinct segments (document, start, bytes): (document, first byte, end) of what also starts earlier."""
    shards, held, size = [], [], 0
    for _, _, data in segments:
        held.append(data)
        size += len(data)
        if size >= SHARD:
            shards.append(Shard(held, length))
            held, size = [], 0
    if held:
        shards.append(Shard(held, length))
    seg, place, group = merge(shards, length)
    docs, starts = np.array([s[0] for s in segments]), np.array([s[1] for s in segments])
    sizes = np.array([len(s[2]) for s in segments])
    ok = place + length <= sizes[seg]
    seg, place, group = seg[ok], place[ok], group[ok]
    doc, start = docs[seg], starts[seg] + place
    order = np.lexsort((start, doc, group))
    doc, start, group = doc[order], start[order], group[order]
    again = np.zeros(len(doc), bool)
    again[1:] = group[1:] == group[:-1]
    doc, start = doc[again], start[again]
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    if not len(doc):
        return []
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(doc)] - 1
    return list(zip(doc[first].tolist(), start[first].tolist(), (start[last] + length).tolist(), strict=True))


SPANS = "doc long, start long, end long"


def _spans_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "start", "end"])


def repeated_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, start, end): bytes covered by a string of `length` bytes that also starts earlier. Spans may overlap."""
    store = Scratch(df.sparkSession, "bwt")
    docs = df.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("t")).where(F.col(doc_id).isNotNull() & (F.octet_length(text) >= length))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1024):
            ids, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in row_chunks(raw):
                if len(raw[a]) >= 1 << 23:
                    s, e, k, x = long_anchors(raw[a], length)
                    row = np.zeros(len(s), np.int64)
                else:
                    row, s, e, k, x = anchors(raw[a:b], length)
                yield pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(signed(x)), pa.array(ids[a:b][row]), pa.array(s.astype(np.int32)), pa.array((e - s).astype(np.int16))], names=["key", "whole", "doc", "start", "more"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key, whole, place: rows whose bytes the row before has too (copy), and first rows of those bytes whose key
        has other bytes as well."""
        last: tuple | None = None  # key, whole, document and start of the row before
        held, known = None, None  # a first row that may be alone with its key; a key that isn't
        for batch in batches:
            cols = [batch[c].to_numpy() for c in ("key", "whole", "doc", "start")]
            equal_to_last = [np.r_[last is not None and x[0] == last[i], x[1:] == x[:-1]] for i, x in enumerate(cols)]
            last = tuple(x[-1] for x in cols)
            repeated = equal_to_last[0] & equal_to_last[1] & equal_to_last[2] & equal_to_last[3]  # a row of the table is there twice
            if repeated.any():
                batch = batch.filter(pa.array(~repeated))
                if not len(batch):
                    continue
            same = (equal_to_last[0] & equal_to_last[1])[~repeated]
            copies = batch.filter(pa.array(same)).drop_columns(["whole"])
            yield copies.append_column("copy", pa.array(np.ones(len(copies), bool)))
            firsts = batch.filter(pa.array(~same)).drop_columns(["whole"])
            if not len(firsts):
                continue
            t = pa.Table.from_batches([firsts] if held is None else [held, firsts]).combine_chunks()
            key = t["key"].to_numpy()
            equal = key[1:] == key[:-1]
            ok = np.r_[False, equal] | np.r_[equal, False]
            if known is not None:
                ok |= key == known
            held, known = (None, key[-1]) if ok[-1] else (t.slice(len(key) - 1).to_batches()[0], None)
            for part in t.filter(pa.array(ok)).to_batches():
                yield part.append_column("copy", pa.array(np.zeros(len(part), bool)))

    def sieve() -> DataFrame:
        marked = docs.mapInArrow(mark, "key long, whole long, doc long, start int, more short").repartition("key")
        return store.keep(marked.sortWithinPartitions("key", "whole", "doc", "start").mapInArrow(again, "key long, doc long, start int, more short, copy boolean"))

    wanted = sieve()
    store.release()
    copies = wanted.where("copy").select("doc", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("more") + length).cast("long").alias("end"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 256):
            out = []
            for doc, t, at in zip(*(batch.column(c).to_pylist() for c in ("doc", "t", "at")), strict=True):
                for x in at:
                    part = t[x["start"] : x["start"] + x["more"] + length]
                    if len(part) == x["more"] + length:
                        out.append((x["key"], doc, x["start"], part))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "doc", "start", "data"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, bulk = None, {}, []
        size = 0
        spans: list[tuple[int, int, int]] = []

        def close() -> None:
            """One anchor's segments are all there."""
            nonlocal size
            if len(group) > 1:
                bulk.extend((d, s, x) for x, (d, s) in group.items())
                size += sum(map(len, group))
            group.clear()

        for batch in batches:
            for k, doc, start, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != key:
                    close()
                    key = k
                    if size >= TOGETHER:
                        spans += repeats(bulk, length)
                        bulk.clear()
                        size = 0
                first = group.setdefault(data, (doc, start))
                if first != (doc, start):
                    spans.append((doc, start, start + len(data)))
            yield _spans_batch(spans)
            spans = []
        close()
        if bulk:
            spans += repeats(bulk, length)
        yield _spans_batch(spans)

    def merged() -> DataFrame:
        lists = wanted.where("not copy").groupBy("doc").agg(F.collect_set(F.struct("start", "more", "key")).alias("at"))
        segments = docs.join(lists, "doc").mapInArrow(cut, "key long, doc long, start long, data binary").repartition("key")
        return store.keep(segments.sortWithinPartitions("key", "doc", "start").mapInArrow(solve, SPANS).distinct())

    spans = merged()
    store.release()
    return spans.union(copies)


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of df: (doc_id, n_bytes, n_removed, n_spans, spans, kept): spans are the maximal removed runs of
    bytes, kept the remaining ones (binary: cuts may part a character)."""
    found = repeated_spans(df, doc_id, text, length).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_s"))
    rows = df.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary")).alias("t")).join(found, "doc", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for doc, t, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "t", "_s")), strict=True):
                runs: list[list[int]] = []
                for s in spans or ():
                    if runs and s["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["end"])
                    else:
                        runs.append([s["start"], s["end"]])
                edge = [0, *(x for r in runs for x in r), len(t)]
                kept = b"".join(t[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
                out.append((doc, len(t), len(t) - len(kept), len(runs), [{"start": a, "end": b} for a, b in runs], kept))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), span, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return rows.select("doc", "t", "_s").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
