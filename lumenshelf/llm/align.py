"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a sentence-piece model (B) cover the same bytes.

Both encode a space and the text. Every byte gets a label: no token ends there, one of A, one of B, or one of both. A
regular expression scans the labels of a batch, up to each byte where both end: such a span is a group, and its labels say
how many tokens of A and of B it has. Tokens of one group are linked.

How many documents hold an id pair linked is counted over the whole corpus: pairs are distinct within a document, added up
within tasks, then by a grouped sum. The counts of the most frequent pairs, at most COMMON of them, are broadcast and looked
up in sorted arrays; the counts of all others, which few documents hold each, meet their documents by a join. The limit is
one on what is broadcast: every pair gets its count by one way or the other. The highest count of each A id, at most one
number an id, is broadcast too.

A is read from a tokenizer file: byte-level pre-tokens are found as in `bpe`, merged by the file's own list of pairs. B
goes word by word, where no piece holds a space after another character (else text by text), and words that were seen
before are remembered; a text whose bytes don't come back that way is encoded again as a whole.

Results: texts null or empty, and texts whose joined A or B bytes differ from a space and the text (such as those with
U+2581, which stands for a space in B), have no tokens: zeros and empty groups. Rows with null or repeated ids are kept
one for one, and each row counts as a document of its own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import hash_slices, ragged, row_chunks, small
from .bpe import Merger
from .common import Scratch

CHUNK = 1 << 19
COMMON = 1 << 18  # pairs whose counts are broadcast
SEEN = 1 << 19  # words that a worker remembers
HELD = 1 << 21  # pairs that a task adds up before it gives them out
BITS = 20  # of an id within a pair
DENSE = 1 << 12  # links; larger groups are expanded by distinct ids
SPAN = re.compile(rb"[^+]*\+")
NONE, A_END, B_END, BOTH = b".ab+"
GROUPS = "id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary, pair long, docs long"


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write bytes that print as themselves, and the others, in order, as the code points from 256."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel(Merger):
    """Byte-level BPE of a tokenizer file: only the file's pairs merge, in its order."""

    def __init__(self, spec: dict):
        kind, model = spec["pre_tokenizer"], spec["model"]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if spec.get("normalizer") or any(kind.get(k) != v for k, v in plain.items()) or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE")
        letters, vocab = byte_of_letter(), model["vocab"]
        super().__init__({bytes(letters[c] for c in t): i for t, i in vocab.items()})
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        keys = np.array([vocab[x] * self.space + vocab[y] for x, y in pairs] or [-1], np.int64)
        made = np.array([vocab[x + y] for x, y in pairs] or [0], np.int64)
        if (np.diff(made) <= 0).any():
            raise ValueError("ids don't follow the order of the merges")
        order = np.argsort(keys)
        self.keys, self.values = keys[order], made[order]
        self.pairs = dict(zip(keys.tolist(), made.tolist(), strict=True))
        self.text_of = {i: t for t, i in self.ranks.items()}

    def long_slice(self, data: bytes) -> list[int]:
        import heapq

        ids = [int(self.base[c]) for c in data]
        after, before = [*range(1, len(ids) + 1)], [*range(-1, len(ids) - 1)]
        made = lambda i, j: self.pairs.get(ids[i] * self.space + ids[j])
        heap = [(r, i) for i in range(len(ids) - 1) if (r := made(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or made(i, j) != r:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if (k := after[i]) < len(ids):
                before[k] = i
                if (r := made(i, k)) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := made(k, i)) is not None:
                heapq.heappush(heap, (r, k))
        return [x for x in ids if x >= 0]


class Pieces:
    """A sentence-piece model: ids of texts, and the bytes that ids stand for."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        names = [m.id_to_piece(i) for i in range(m.vocab_size())]
        data = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.size = np.array([len(x) for x in data], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        self.by_word = not any("▁" in p.lstrip("▁") for p in names) and "▁" in names
        self.blank = [m.piece_to_id("▁")]
        self.clear()

    def clear(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.seen_at, self.seen_n, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.seen):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.seen, keys), len(self.seen) - 1)
        return np.where(self.seen[at] == keys, at, -1)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each text) of texts that begin with a space, word by word with the spaces before."""
        raw = b"".join(texts)
        buf = np.frombuffer(raw + bytes(8), np.uint8)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(n) - n
        gap = buf[: len(raw)] == 32
        first = gap & np.r_[True, ~gap[:-1]]
        first[begin] = True
        start = np.flatnonzero(first)
        length = np.diff(np.r_[start, len(raw)])
        keys, one, which = np.unique(hash_slices(buf, start, length), return_index=True, return_inverse=True)
        if len(self.seen) > SEEN:
            self.clear()
        known = self.lookup(keys)
        if len(new := np.flatnonzero(known < 0)):
            spans = [raw[start[i] + 1 : start[i] + length[i]].decode() for i in one[new].tolist()]
            found = [ids if s else self.blank for s, ids in zip(spans, self.whole(spans), strict=True)]
            count = np.array([len(x) for x in found], np.int64)
            merged = np.r_[self.seen, keys[new]]
            order = np.argsort(merged, kind="stable")
            self.seen_at = np.r_[self.seen_at, len(self.pool) + np.cumsum(count) - count][order]
            self.seen_n, self.seen = np.r_[self.seen_n, count][order], merged[order]
            self.pool = np.r_[self.pool, np.fromiter((i for x in found for i in x), np.int32)]
            known = self.lookup(keys)
        slot = known[which]
        ids = self.pool[ragged(self.seen_at[slot], self.seen_n[slot])].astype(np.int64)
        upto = np.r_[0, np.cumsum(self.seen_n[slot])]
        return ids, np.diff(upto[np.searchsorted(start, np.r_[begin, len(raw)])])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each text, whether their bytes are a space and the text). Texts aren't empty."""
        data = [b" " + t.encode() for t in texts]
        ok = np.zeros(len(texts), bool)
        each: dict[int, list[int]] = {}
        ids, n = np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        if self.by_word and texts:
            ids, n = self.words(data)
            ok = self._same(ids, n, data)
        if len(left := np.flatnonzero(~ok)):
            each = dict(zip(left.tolist(), self.whole([texts[i] for i in left.tolist()]), strict=True))
            edge = np.r_[0, np.cumsum(n)]
            parts = [np.array(each[i], np.int64) if i in each else ids[edge[i] : edge[i + 1]] for i in range(len(texts))]
            ids, n = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
            ok = self._same(ids, n, data)
        return ids, n, ok

    def _same(self, ids: np.ndarray, n: np.ndarray, data: list[bytes]) -> np.ndarray:
        got = self.bytes[ragged(self.at[ids], self.size[ids])].tobytes()
        edge = np.r_[0, np.cumsum(self.size[ids])][np.r_[0, np.cumsum(n)]].tolist()
        return np.array([got[a:b] == x for a, b, x in zip(edge, edge[1:], data, strict=False)], bool)


class Aligned:
    """Groups of the tokens of some texts. `a`, `b`: ids; `n_a`, `n_b`: tokens of each text; `in_a`, `in_b`: of each group; `row`: of a group."""

    def __init__(self, first: ByteLevel, second: Pieces, texts: list[str]):
        rows = len(texts)
        full = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in full]
        a, n_a = first.encode([" " + t for t in some])
        b, n_b, ok = second.encode(some)
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        self.n_a, self.n_b = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        self.n_a[full], self.n_b[full] = n_a * ok, n_b * ok
        self.a, self.b = a, b
        end_a, end_b = np.cumsum(first.size[a]), np.cumsum(second.size[b])
        label = np.full(int(end_a[-1]) if len(a) else 0, NONE, np.uint8)
        label[end_a - 1] = A_END
        label[end_b - 1] = np.where(label[end_b - 1] == A_END, BOTH, B_END)
        ends = np.array([m.end() for m in SPAN.finditer(label.tobytes())], np.int64)
        upto = lambda one: np.diff(np.r_[0, np.cumsum((label == one) | (label == BOTH))[ends - 1]])
        self.in_a, self.in_b = upto(A_END), upto(B_END)
        doc_end = np.cumsum(np.bincount(np.repeat(np.arange(rows), self.n_a), weights=first.size[a], minlength=rows).astype(np.int64))
        self.row = np.searchsorted(doc_end, ends - 1, "right")
        self.n_groups = np.bincount(self.row, minlength=rows)
        self.links = self.in_a * self.in_b
        total = np.r_[0, np.cumsum(self.links)]
        self.n_links = np.diff(total[np.r_[0, np.cumsum(self.n_groups)]])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pair, times): the distinct linked id pairs of each text, sorted, and how often each is linked."""
        at_a, at_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        few = np.flatnonzero(self.links <= DENSE)
        tokens = ragged(at_a[few], self.in_a[few])
        group = np.repeat(few, self.in_a[few])
        width = self.in_b[group]
        key = (np.repeat(self.row[group] << BITS | self.a[tokens], width) << BITS) | self.b[ragged(at_b[group], width)]
        key, times = np.unique(key, return_counts=True)
        more_key, more_times = [key], [times]
        for g in np.flatnonzero(self.links > DENSE).tolist():
            x, m = np.unique(self.a[at_a[g] : at_a[g] + self.in_a[g]], return_counts=True)
            y, k = np.unique(self.b[at_b[g] : at_b[g] + self.in_b[g]], return_counts=True)
            more_key.append(((self.row[g] << BITS | x)[:, None] << BITS | y[None, :]).ravel())
            more_times.append((m[:, None] * k[None, :]).ravel())
        if len(more_key) > 1:
            key, back = np.unique(np.concatenate(more_key), return_inverse=True)
            times = np.bincount(back, weights=np.concatenate(more_times)).astype(np.int64)
        return key >> (2 * BITS), key & ((1 << (2 * BITS)) - 1), times

    def shown(self) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each text."""
        top = int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1
        _names_upto(top)
        g_a, g_b = np.repeat(np.arange(len(self.in_a)), self.in_a), np.repeat(np.arange(len(self.in_b)), self.in_b)
        spot_a = np.arange(len(self.a)) + (np.cumsum(self.in_b) - self.in_b)[g_a]
        spot_b = np.arange(len(self.b)) + np.cumsum(self.in_a)[g_b]
        ids, mark = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[spot_a], ids[spot_b] = self.a, self.b
        mark[spot_a[np.cumsum(self.in_a) - 1]], mark[spot_b[np.cumsum(self.in_b) - 1]] = ord("|"), ord(";")
        size, at, pool = _names[0]
        text = pool[ragged(at[ids], size[ids])]
        upto = np.cumsum(size[ids])
        text[upto - 1] = mark
        text, edge = text.tobytes().decode(), np.r_[0, upto][np.r_[0, np.cumsum(self.n_a + self.n_b)]].tolist()
        return [text[p : q - 1] if q > p else "" for p, q in zip(edge, edge[1:], strict=False)]


_names: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _names_upto(top: int) -> None:
    """Decimal numbers, each with one byte for the mark after it."""
    if not _names or len(_names[0][0]) < top:
        data = [str(i).encode() + b"," for i in range(max(top, 1 << 16))]
        size = np.array([len(x) for x in data], np.int64)
        _names[:] = [(size, np.cumsum(size) - size, np.frombuffer(b"".join(data), np.uint8))]


_tools: dict[str, tuple[ByteLevel, Pieces]] = {}


def tools(held) -> tuple[ByteLevel, Pieces]:
    """One pair for each worker process and pair of vocabularies; held: a broadcast (name, tokenizer file, model file)."""
    name, spec, proto = held.value
    if name not in _tools:
        _tools[name] = ByteLevel(json.loads(spec)), Pieces(proto)
    return _tools[name]


def token_groups(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(GROUPS) A row for each row of df, with `pairs` (int64) and `times` (int64) of its distinct linked pairs, a << 20 | b; and rows
    that have `pair` and `docs` alone: how many of some documents hold a pair."""
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:  # fixed vocabularies, read on the driver
        held = df.sparkSession.sparkContext.broadcast((f"{path_a} {path_b}", f.read(), g.read()))
    names = [f.split()[0] for f in GROUPS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def batch_of(n: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[x], k) if x in cols else pa.nulls(n, k) for x, k in zip(names, kinds, strict=True)], names=names)

    def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return key, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tools(held)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in small(batches):
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            for p, q in row_chunks(raw, CHUNK):
                found = Aligned(first, second, [x.decode("utf-8", "replace") for x in raw[p:q]])
                row, pair, times = found.pairs()
                edge = np.searchsorted(row, np.arange(q - p + 1)).tolist()
                cut = lambda x: [x[i:j].tobytes() for i, j in zip(edge, edge[1:], strict=False)]  # noqa: E731, B023
                yield batch_of(q - p, id=batch.column(0).slice(p, q - p), n_a=found.n_a, n_b=found.n_b, n_groups=found.n_groups, n_links=found.n_links, groups=found.shown(), pairs=cut(pair), times=cut(times))
                parts.append((pair, np.ones(len(pair), np.int64)))
                if sum(len(k) for k, _ in parts) > HELD:
                    parts = [counted(parts)]
                    if len(parts[0][0]) > HELD // 2:
                        yield batch_of(len(parts[0][0]), pair=parts[0][0], docs=parts[0][1])
                        parts = []
        if parts:
            key, n = counted(parts)
            yield batch_of(len(key), pair=key, docs=n)

    return df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, GROUPS)


def _least_common(counts: DataFrame, common: int) -> int:
    """The least power of two such that at most `common` pairs are held by as many documents or more."""
    seen = counts.groupBy(F.floor(F.log2("docs")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 64 rows
    total, least = 0, 64
    for k, n in sorted(((r["k"], r["n"]) for r in seen), reverse=True):
        total += n
        if total > common:
            break
        least = k
    return 1 << min(least, 62)


def align(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", common: int = COMMON, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """One row for each row of df: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups). n_best: links whose pair's count is the
    highest of its A id; count_sum: of the counts of all links. `shape` may put other columns in the place of `groups`."""
    spark = df.sparkSession
    store = Scratch(spark, "align")
    first = store.keep(shape(token_groups(df, path_a, path_b, doc_id, text)))
    counts = store.keep(first.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs")))
    best_of = counts.groupBy(F.shiftright("pair", BITS).alias("a")).agg(F.max("docs").alias("docs")).toArrow()  # a row for each A id
    best = np.zeros(1 << BITS, np.int64)
    best[best_of["a"].to_numpy()] = best_of["docs"].to_numpy()
    least = _least_common(counts, common)
    often = counts.where(F.col("docs") >= least).toArrow()  # at most `common` rows
    keys, docs = often["pair"].to_numpy(), often["docs"].to_numpy()
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast((keys[order], docs[order], best[: int(np.flatnonzero(best).max(initial=0)) + 1]))
    keep = [c for c in first.columns if c not in ("pairs", "times", "pair", "docs")]
    rows = first.where("pair is null").select(*keep, F.monotonically_increasing_id().alias("row"), "pairs", "times")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep) + 1]), "n_best long, count_sum long, rare array<long>, rare_times array<long>"])
    names = [*keep, "row", "n_best", "count_sum", "rare", "rare_times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, best = known.value
        for batch in small(batches):
            n = batch.num_rows
            flat = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), np.int64)
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), np.int64)
            size = np.fromiter((len(x) // 8 for x in batch.column("pairs").to_pylist()), np.int64, n)
            at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            count = np.where(hit, docs[at], 0) if len(keys) else np.zeros(len(flat), np.int64)
            owner = np.repeat(np.arange(n), size)
            upto = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.r_[0, np.cumsum(size)]])  # noqa: E731, B023
            edge = pa.array(np.r_[0, np.cumsum(np.bincount(owner[~hit], minlength=n))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(edge, pa.array(x[~hit])) for x in (flat, times)]
            cols = [pa.array(upto(times * (hit & (count == best[flat >> BITS])))), pa.array(upto(times * count)), *lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, "row")), *cols], names=names)

    met = store.keep(rows.mapInArrow(run, schema))
    top = F.broadcast(spark.createDataFrame(pa.table({"a": best_of["a"], "top": best_of["docs"]})))
    each = met.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times"))
    each = each.join(counts.where(F.col("docs") < least), "pair").withColumn("a", F.shiftright("pair", BITS)).join(top, "a")
    more = each.groupBy("row").agg(F.sum(F.when(F.col("docs") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_sum"))
    out = [c for c in keep if c in ("id", "n_a", "n_b", "n_groups", "n_links")]
    rest = [c for c in keep if c not in out]
    whole = met.where(F.size("rare") == 0).select(*out, "n_best", "count_sum", *rest)
    added = met.where(F.size("rare") > 0).join(more, "row").select(*out, (F.col("n_best") + F.col("more_best")).alias("n_best"), (F.col("count_sum") + F.col("more_sum")).alias("count_sum"), *rest)
    return whole.union(added)
