"""Byte-level BPE: encoding and decoding of whole texts.

Pre-tokenisation needs no regex. Code points become classes (letter, number, blank, other) through a table, and symbols by
what stands after them. A symbol is a transition function over eight states; an associative scan composes them, for all
pieces of a batch at once, and tells where tokens begin. Slices are hashed; unseen slices are merged
together, one merge a round for all of them, and kept in a bounded cache.

Results: text null or empty gives no tokens; ids are little-endian unsigned 32-bit integers in one binary value
(n_tokens of them); repeated rows give repeated rows; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import hash_slices, ragged, row_chunks, small

LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
#: Code points with the Unicode property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters that follow an apostrophe in a contraction.
ONE, TWO = "stmd", ("re", "ve", "ll")
LONG = 64  # bytes; longer slices are merged one at a time with a heap
CACHE = 1 << 19  # slices


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file (a fixed vocabulary, read on the driver)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _classes:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        kinds = "".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
        kind = np.frombuffer(kinds.encode(), np.uint8)
        table[kind == ord("L")] = LETTER
        table[kind == ord("N")] = NUMBER
        table[WHITE] = BLANK
        _classes.append(table)
    return _classes[0]


#: Symbols of the scan: what a code point and those after it are. A blank is MID with another blank or the end of the text behind
#: it; else it is the last of its run, a SPACE or another one (LAST). An apostrophe may begin a contraction of one or two letters.
MID, SPACE, LAST, ONE_LETTER, TWO_LETTERS, NOTHING = 2, 4, 5, 6, 7, 8
#: States after a code point: within a run of letters, numbers, blanks or others; a space that the next token takes in; one or two
#: letters of a contraction to come; a token that is over.
IN_LETTERS, IN_NUMBERS, IN_BLANKS, IN_OTHERS, HELD_SPACE, LETTER_TO_COME, LETTERS_TO_COME, OVER = range(8)
STATES = 8
SCAN = 64


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and whether a token begins there."""
    new = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, MID: IN_BLANKS, OTHER: IN_OTHERS, SPACE: HELD_SPACE, LAST: OVER, ONE_LETTER: LETTER_TO_COME, TWO_LETTERS: LETTERS_TO_COME}
    to, begins = np.zeros((NOTHING + 1, STATES), np.uint8), np.zeros((NOTHING + 1, STATES), bool)
    to[NOTHING] = np.arange(STATES)
    for symbol, state in new.items():
        to[symbol], begins[symbol] = state, True
    others = (OTHER, ONE_LETTER, TWO_LETTERS)
    goes_on = [(LETTER, IN_LETTERS, IN_LETTERS), (NUMBER, IN_NUMBERS, IN_NUMBERS), (MID, IN_BLANKS, IN_BLANKS), (LETTER, LETTER_TO_COME, OVER), (LETTER, LETTERS_TO_COME, LETTER_TO_COME)]
    goes_on += [(LETTER, HELD_SPACE, IN_LETTERS), (NUMBER, HELD_SPACE, IN_NUMBERS)] + [(x, s, IN_OTHERS) for x in others for s in (IN_OTHERS, HELD_SPACE)]
    for symbol, state, then in goes_on:
        to[symbol, state], begins[symbol, state] = then, False
    return to, begins


NEXT, BEGINS = _transitions()


def symbols(cp: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    n = len(cp)
    kind = classes()[cp]
    ends = np.zeros(n, bool)  # the last code point of its text
    ends[np.r_[doc_start[1:], n] - 1] = True
    out = kind.copy()
    after = np.r_[kind[1:], np.uint8(OTHER)]
    last = (kind == BLANK) & ~ends & (after != BLANK)
    out[last] = np.where(cp[last] == 32, SPACE, LAST)
    at = np.flatnonzero((cp == 39) & ~ends)
    x = cp[at + 1]
    out[at[np.isin(x, [ord(c) for c in ONE])]] = ONE_LETTER
    at, x = at[~ends[at + 1]], x[~ends[at + 1]]
    y = cp[at + 2]
    for a, b in TWO:
        out[at[(x == ord(a)) & (y == ord(b))]] = TWO_LETTERS
    return out


def token_starts(cp: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Indices at which the pre-tokens of texts laid end to end begin. doc_start: of the texts that aren't empty.

    Each symbol is a function from the state before to the state after. Functions are composed within pieces of SCAN symbols,
    all pieces at once; the pieces' functions by doubling (composition is associative); then every piece is gone through with
    the state that it begins with. A text begins as after a token that is over."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    seen = symbols(cp, doc_start)
    pieces = -(-n // SCAN)
    first = np.zeros(pieces * SCAN, bool)
    first[doc_start] = True
    first = np.ascontiguousarray(first.reshape(pieces, SCAN).T)
    grid = np.full(pieces * SCAN, NOTHING, np.uint8)
    grid[:n] = seen
    grid = np.ascontiguousarray(grid.reshape(pieces, SCAN).T)
    table = NEXT.ravel()
    base = grid.astype(np.int16) * STATES
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (pieces, 1))
    for k in range(SCAN):
        if first[k].any():
            whole[first[k]] = OVER
        whole = table[base[k][:, None] + whole]
    step = 1
    while step < pieces:
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.r_[np.uint8(OVER), whole[:-1, OVER]]
    token = np.zeros((SCAN, pieces), bool)
    begins = BEGINS.ravel()
    for k in range(SCAN):
        state = np.where(first[k], np.uint8(OVER), state)
        at = base[k] + state
        token[k] = begins[at]
        state = table[at]
    return np.flatnonzero(token.T.ravel()[:n])


class Merger:
    """Merges bytes to tokens by rank, for many slices at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.base = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.space = max(ranks.values()) + 1
        pairs = [(ranks[t[:i]] * self.space + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([r for _, r in pairs] or [0], np.int64)[order]
        by_rank = dict(zip(ranks.values(), ranks.keys(), strict=True))
        size = np.zeros(self.space, np.int64)
        for r, t in by_rank.items():
            size[r] = len(t)
        self.size, self.at = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(by_rank[r] for r in sorted(by_rank)), np.uint8)
        self.none = self.space
        self.clear()

    def clear(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.seen_at = self.seen_n = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.space + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.none)

    def long_slice(self, data: bytes) -> list[int]:
        ids = [int(self.base[c]) for c in data]
        text = [bytes([c]) for c in data]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i) for i in range(len(ids) - 1) if (r := self.ranks.get(text[i] + text[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or self.ranks.get(text[i] + text[j]) != r:
                continue
            text[i], ids[i], ids[j], after[i] = text[i] + text[j], r, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                if (r := self.ranks.get(text[i] + text[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := self.ranks.get(text[before[i]] + text[i])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [x for x in ids if x >= 0]

    def merge(self, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each slice)"""
        count = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # slices, ids sorted by slice
        for i in np.flatnonzero(length > LONG):
            ids = self.long_slice(buf[start[i] : start[i] + length[i]].tobytes())
            parts.append((np.array([i]), np.array(ids, np.int64)))
            count[i] = len(ids)
        live = np.flatnonzero(length <= LONG)
        size = length[live].copy()
        ids = self.base[buf[ragged(start[live], size)]]
        first = np.cumsum(size) - size
        rank = np.full(len(ids), self.none)
        if len(ids) > 1:
            rank[:-1] = self.rank_of(ids[:-1], ids[1:])
        rank[first + size - 1] = self.none
        while len(live):
            best = np.minimum.reduceat(rank, first)
            done = best == self.none
            if done.any():
                count[live[done]] = size[done]
                parts.append((live[done], ids[ragged(first[done], size[done])]))
                stay = ~done
                pick = ragged(first[stay], size[stay])
                ids, rank, live, size, best = ids[pick], rank[pick], live[stay], size[stay], best[stay]
                first = np.cumsum(size) - size
                if not len(live):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            word = np.repeat(np.arange(len(live)), size)[hit]
            hit = hit[np.r_[True, word[1:] != word[:-1]]]  # the leftmost of each slice
            ids[hit] = best
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # one id has gone from each slice before
            ids, rank = ids[keep], rank[keep]
            size -= 1
            first = np.cumsum(size) - size
            has = moved < first + size - 1
            rank[moved] = self.none
            m = moved[has]
            rank[m] = self.rank_of(ids[m], ids[m + 1])
            m = moved[moved > first] - 1
            rank[m] = self.rank_of(ids[m], ids[m + 1])
        at = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.int64)
        for rows, got in parts:
            flat[ragged(at[rows], count[rows])] = got
        return flat, count

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.seen):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.seen, keys), len(self.seen) - 1)
        return np.where(self.seen[at] == keys, at, -1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text)"""
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        n_cp = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(n_cp) - n_cp
        token = token_starts(cp, begin[n_cp > 0])
        if not len(token):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        at = np.r_[0, np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))]
        buf = np.frombuffer(whole.encode("utf-8", "surrogatepass") + bytes(8), np.uint8)
        start = at[token]
        length = np.r_[start[1:], at[-1]] - start
        keys, first, which = np.unique(hash_slices(buf, start, length), return_index=True, return_inverse=True)
        if len(self.seen) > CACHE:
            self.clear()
        known = self.lookup(keys)
        if len(new := np.flatnonzero(known < 0)):
            flat, count = self.merge(buf, start[first[new]], length[first[new]])
            merged = np.r_[self.seen, keys[new]]
            order = np.argsort(merged, kind="stable")
            self.seen_at = np.r_[self.seen_at, (len(self.pool) + np.cumsum(count) - count).astype(np.int32)][order]
            self.seen_n, self.seen, self.pool = np.r_[self.seen_n, count.astype(np.int32)][order], merged[order], np.r_[self.pool, flat.astype(np.int32)]
            known = self.lookup(keys)
        slot = known[which]
        n = self.seen_n[slot].astype(np.int64)
        ids = self.pool[ragged(self.seen_at[slot], n)].astype(np.int64)
        upto = np.r_[0, np.cumsum(n)]
        edge = upto[np.searchsorted(token, np.r_[begin, len(cp)])]
        if not np.array_equal(self.decode(ids), buf[:-8]):  # two slices with one hash: never seen, but never wrong
            ids, n = self.merge(buf, start, length)
            edge = np.r_[0, np.cumsum(n)][np.searchsorted(token, np.r_[begin, len(cp)])]
        return ids, np.diff(edge)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.at[ids], self.size[ids])]


_mergers: dict[str, Merger] = {}


def merger(ranks) -> Merger:
    """One for each worker process and vocabulary; ranks: a broadcast (name, dict)."""
    name, table = ranks.value
    if name not in _mergers:
        _mergers[name] = Merger(table)
    return _mergers[name]


def _without(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c not in names]


def _vocabulary(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast((path, read_ranks(path)))


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encoder(ranks, rest: list[str]) -> Run:
    """Batches of the columns `rest` and a text -> those and n_tokens, token_ids."""
    spot = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merger(ranks)
        for batch in small(batches):
            raw = [x or b"" for x in batch.column(spot).to_pylist()]
            for a, b in row_chunks(raw, 1 << 19):
                ids, n = tool.encode([x.decode("utf-8", "replace") for x in raw[a:b]])
                data = ids.astype("<u4").tobytes()
                ends = np.cumsum(n) * 4
                packed = [data[e - 4 * k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                cols = [batch.column(i).slice(a, b - a) for i in range(spot)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=[*rest, "n_tokens", "token_ids"])

    return run


def _decoder(ranks, rest: list[str], ids: str, to: str) -> Run:
    """Batches of the columns `rest` and packed ids -> those and what the ids stand for."""
    spot = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merger(ranks)
        for batch in small(batches):
            raw = [x or b"" for x in batch.column(spot).to_pylist()]
            for a, b in row_chunks(raw, 1 << 19):
                flat = np.frombuffer(b"".join(raw[a:b]), "<u4").astype(np.int64)
                n = np.fromiter((len(x) // 4 for x in raw[a:b]), np.int64, b - a)
                edge = np.r_[0, np.cumsum(tool.size[flat])][np.r_[0, np.cumsum(n)]].tolist()
                data = tool.decode(flat).tobytes()
                out = [data[p:q] for p, q in zip(edge, edge[1:], strict=False)]
                cols = [batch.column(i).slice(a, b - a) for i in range(spot + 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.binary())], names=[*rest, ids, to])

    return run


def encode(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """All columns but `text`, with n_tokens and token_ids (binary, uint32 little-endian). Columns of these names are replaced."""
    rest = _without(df, text, "n_tokens", "token_ids")
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())])
    return df.select(*rest, F.col(text).cast("binary").alias(text)).mapInArrow(_encoder(_vocabulary(df, vocabulary), rest), schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """All columns, with the bytes that the ids stand for in `to`. Null ids give no bytes; an id outside the vocabulary is an error."""
    rest = _without(df, ids, to)
    schema = T.StructType([df.schema[c] for c in rest] + [df.schema[ids], T.StructField(to, T.BinaryType())])
    return df.select(*rest, ids).mapInArrow(_decoder(_vocabulary(df, vocabulary), rest, ids, to), schema)


def encode_and_decode(df: DataFrame, vocabulary: str, text: str = "text", to: str = "decoded") -> DataFrame:
    """decode(encode(df)), in one Python worker a task instead of two."""
    ranks, rest = _vocabulary(df, vocabulary), _without(df, text, "n_tokens", "token_ids", to)
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()), T.StructField(to, T.BinaryType())]
    there, back = _encoder(ranks, rest), _decoder(ranks, [*rest, "n_tokens"], "token_ids", to)
    return df.select(*rest, F.col(text).cast("binary").alias(text)).mapInArrow(lambda batches: back(there(batches)), T.StructType([df.schema[c] for c in rest] + made))


def unpack(ids: str | Column = "token_ids") -> Column:
    """The packed ids as array<int>, for readers that want them so."""
    packed = F.hex(ids)
    byte = lambda i, k: F.substring(packed, i * 8 + 1 + 2 * k, 2)
    return F.transform(F.sequence(F.lit(0), (F.length(packed) / 8).cast("int") - 1), lambda i: F.conv(F.concat(byte(i, 3), byte(i, 2), byte(i, 1), byte(i, 0)), 16, 10).cast("int"))
