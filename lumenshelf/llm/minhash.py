"""MinHash near-dedup: universal hash minima, banding, signature verification, confirmation on full shingle sets, and
connected components by large-star and small-star.

Documents with the same shingle set count as one from the start, so large groups of copies stay cheap. In each band bucket
one member, the pivot, is compared with all others that the confirmed links don't join to it yet; the pivot is the set that
meets most others, mostly the original of its near copies. After TURNS such turns, what is left of the buckets that are
still apart is cut to blocks of about BLOCK sets, and blocks that share a bucket meet once, within a task, by signatures and
then by full sets: only links that join parts come out, never pairs, and no link between components is lost to the pivots.
Sets whose own shingles rule out any link leave before. 128 minima in 32 bands of 4 miss a pair at 0.85 with a chance of
6e-11; the signature test rejects a pair at 0.85 with a chance under 1e-7.

Results: text null, empty or without words has an empty set and links with nothing. Fewer words than a shingle count as one
shingle. Rows with a null id are kept and link with nothing. Rows with one id and different texts are linked through it; the
least of its texts is the one confirmed against others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, Words, bounds, mix, row_chunks, signed, small
from .common import Scratch
from .components import components

HASHES, ROWS = 128, 4
TURNS = 2
SLACK = 0.2  # a signature may agree this much less than the similarity asked for
MEMBERS = 4096  # pairs of a pivot that meet in one task
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
SIGNED = "id long, n_shingles long, set_a long, set_b long, signature array<int>"


def _family(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**63, n, dtype=U) * U(2) + U(1), r.integers(0, 2**63, n, dtype=U)


def unique_by_row(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes within each of n rows, row by row."""
    edge = bounds(row, n)
    parts = [np.unique(h[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return (np.concatenate(parts) if parts else h), np.repeat(np.arange(n), [len(p) for p in parts])


def minima_of(h: np.ndarray, row: np.ndarray, n: int, hashes: int) -> np.ndarray:
    """The minima of n rows' hashes under a family of universal hash functions, of which the upper 32 bits are kept."""
    mul, add = _family(hashes)
    size = np.bincount(row, minlength=n)
    full = np.flatnonzero(size)
    out = np.zeros((n, hashes), np.int32)
    if len(h):
        first = (np.cumsum(size) - size)[full]
        x = np.empty_like(h)
        for i in range(hashes):
            np.multiply(h, mul[i], out=x)
            x += add[i]
            out[full, i] = (np.minimum.reduceat(x, first) >> U(32)).astype(np.uint32).view(np.int32)
    return out


def signatures(df: DataFrame, doc_id: str, text: str, width: int, hashes: int = HASHES) -> DataFrame:
    """(id, n_shingles, set_a, set_b, signature): size and 128-bit sum of each shingle set, and its minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            for a, b in row_chunks(raw, 1 << 20):
                n = b - a
                h, row = unique_by_row(*Words(raw[a:b]).shingles(width), n)
                size = np.bincount(row, minlength=n)
                full = np.flatnonzero(size)
                first = (np.cumsum(size) - size)[full]
                sums = np.zeros((2, n), U)
                if len(h):
                    sums[0, full], sums[1, full] = np.add.reduceat(h, first), np.add.reduceat(mix(h + U(7)), first)
                flat = pa.array(minima_of(h, row, n, hashes).ravel(), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * hashes + 1, hashes), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(size, pa.int64()), pa.array(signed(sums[0])), pa.array(signed(sums[1])), lists], names=["id", "n_shingles", "set_a", "set_b", "signature"])

    return df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, SIGNED)


def confirm(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of (a, b, text_a, text_b), the (a, b) with 100 * intersection >= percent * union of full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for p, q in row_chunks([x + y for x, y in zip(ta, tb, strict=True)], 1 << 20):
                n = q - p
                ha, ra = unique_by_row(*Words(ta[p:q]).shingles(width), n)
                hb, rb = unique_by_row(*Words(tb[p:q]).shingles(width), n)
                row, h = np.r_[ra, rb], np.r_[ha, hb]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                both = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n)
                union = np.bincount(row, minlength=n) - both
                ok = pa.array((100 * both >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p, n).filter(ok), batch.column(1).slice(p, n).filter(ok)], names=["a", "b"])

    return pairs.select("a", "b", F.col("text_a").cast("binary"), F.col("text_b").cast("binary")).mapInArrow(run, "a long, b long")


def _block_pairs(left: DataFrame, sets: DataFrame, percent: int, hashes: int, store: Scratch) -> DataFrame:
    """left: (bucket, rep, c); sets: (rep, n_shingles, shingles, short). (a, b): links between sets that share a bucket and have different
    c, of which some may be missing where others join the same parts.

    Each set has one block, among those that it shares its largest bucket with: about BLOCK sets of like size, either all of one
    c or mixed. Two blocks meet in one task, once, whatever number of buckets they share, and only the sets that share a bucket
    with some set of the other block go there."""
    size = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    key = left.join(size, "bucket").groupBy("rep").agg(F.max(F.struct("n", "bucket"))["bucket"].alias("key"), F.first("c").alias("c"))
    # sizes that differ by more than the similarity allows never link
    keyed = store.keep(key.join(sets.select("rep", "n_shingles"), "rep").withColumn("salt", F.floor(F.log2(F.col("n_shingles").cast("double")) * 4)))
    of_c = keyed.groupBy("key", "salt", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    of_c = of_c.withColumn("own", F.when((F.col("n") >= BLOCK // 4) | (F.col("s") >= BLOCK_SHINGLES // 4), F.col("c")))
    pools = of_c.groupBy("key", "salt", "own").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("s") / BLOCK_SHINGLES)).alias("cuts"))
    own = of_c.alias("x").join(pools.alias("y"), F.expr("x.key = y.key and x.salt = y.salt and x.own <=> y.own")).select("x.key", "x.salt", "x.c", "x.own", "y.cuts")
    block = F.xxhash64("key", "salt", "own", F.pmod(F.xxhash64("rep"), F.col("cuts")))
    placed = store.keep(keyed.join(own, ["key", "salt", "c"]).select("rep", "c", "salt", "own", block.alias("block")))
    rows = left.select("bucket", "rep").join(placed, "rep")
    others = rows.groupBy("bucket").agg(F.collect_set(F.struct("block", "salt", "own")).alias("blocks"))
    reach = 1 + int(np.ceil(4 * np.log2(100 / percent)))
    fits = lambda x: (F.abs(F.col("salt") - x["salt"]) <= reach) & ~F.coalesce(F.col("own") == x["own"], F.lit(False))
    met = rows.join(others, "bucket").withColumn("blocks", F.transform(F.filter("blocks", fits), lambda x: x["block"]))
    met = met.groupBy("rep", "c", "block").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))  # of one set's buckets
    other = F.col("other")
    sent = met.select("rep", "c", "block", F.explode("blocks").alias("other")).select("rep", "c", F.least("block", other).alias("low"), F.greatest("block", other).alias("high"), (F.col("block") <= other).alias("first"))
    least = hashes * (percent / 100 - SLACK)

    def side(rows: list[dict]) -> tuple:
        short = np.frombuffer(b"".join(r["short"] for r in rows), np.uint8).reshape(len(rows), -1)
        return np.array([r["rep"] for r in rows]), np.array([r["c"] for r in rows]), short, [np.frombuffer(r["shingles"], U) for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1):
            members, same = batch.column("m").to_pylist()[0], batch.column("same").to_pylist()[0]
            ia, ca, sa, ha = side([r for r in members if r["first"]])
            ib, cb, sb, hb = (ia, ca, sa, ha) if same else side([r for r in members if not r["first"]])
            agree = np.zeros((len(ia), len(ib)), np.uint16)
            for x, y in zip(sa.T, sb.T, strict=True):
                agree += x[:, None] == y[None, :]
            near = (agree >= least) & (ca[:, None] != cb[None, :])
            if same:
                near = np.triu(near, 1)
            yield _links(ia, ib, ha, hb, near, percent)

    member = F.struct("first", "rep", "c", "short", "shingles")
    both = sent.join(sets.select("rep", "short", "shingles"), "rep").groupBy("low", "high").agg(F.collect_list(member).alias("m"), F.count_if("first").alias("ones"))
    both = both.where("low = high or (ones > 0 and ones < size(m))")
    return both.select("m", F.expr("low = high").alias("same")).mapInArrow(run, "a long, b long").distinct()


def _links(ia: np.ndarray, ib: np.ndarray, ha: list[np.ndarray], hb: list[np.ndarray], near: np.ndarray, percent: int) -> pa.RecordBatch:
    """Of the pairs in `near`, a forest of those that link. Intersections are counted by a product of membership matrices."""
    use_a, use_b = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    edges: list[tuple[int, int]] = []
    if len(use_a):
        one, two = [ha[i] for i in use_a.tolist()], [hb[j] for j in use_b.tolist()]
        known = np.intersect1d(np.concatenate(one), np.concatenate(two))
        both = np.zeros((len(one), len(two)), np.float32)
        for k in range(0, len(known), 8192):
            both += _held(one, known[k : k + 8192]) @ _held(two, known[k : k + 8192]).T
        size_a, size_b = (np.array([len(x) for x in y]) for y in (one, two))
        union = size_a[:, None] + size_b[None, :] - both
        i, j = np.nonzero((100 * both >= percent * union) & near[np.ix_(use_a, use_b)])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for x, y in zip(ia[use_a[i]].tolist(), ib[use_b[j]].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                edges.append((min(x, y), max(x, y)))
    a, b = zip(*edges, strict=True) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _held(rows: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    """Which of the sorted hashes `part` each row holds."""
    h, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    at = np.minimum(np.searchsorted(part, h), len(part) - 1)
    ok = part[at] == h
    out = np.zeros((len(rows), len(part)), np.float32)
    out[row[ok], at[ok]] = 1
    return out


def shingle_sets(texts: DataFrame, width: int, hashes: int = HASHES) -> DataFrame:
    """texts: (rep, text), with some shingle each. (rep, n_shingles, shingles, short): the sorted 64-bit hashes of the set, and a byte of each
    minimum, which tells enough to leave out most pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            for p, q in row_chunks(raw, 1 << 20):
                h, row = unique_by_row(*Words(raw[p:q]).shingles(width), q - p)
                edge = bounds(row, q - p)
                sets = [h[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                short = minima_of(h, row, q - p, hashes).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p, q - p), pa.array(np.diff(edge), pa.int64()), pa.array(sets, pa.binary()), pa.array([x.tobytes() for x in short], pa.binary())], names=["rep", "n_shingles", "shingles", "short"])

    return texts.select("rep", F.col("text").cast("binary")).mapInArrow(run, "rep long, n_shingles long, shingles binary, short binary")


def _linkable(hashed: DataFrame, percent: int) -> DataFrame:
    """(rep): sets that can link with another one of these. Shingles that no other set has bound what two sets can share: of a
    set of n with u such, at most n - u, and the union has n or more (n where the other set is a part of this one)."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            h = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rep").to_numpy(), batch.column("n_shingles").to_numpy())), pa.array(h)], names=["rep", "h"])

    rows = hashed.mapInArrow(flat, "rep long, h long")
    own = rows.groupBy("h").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")).where("rep = last").groupBy("rep").agg(F.count(F.lit(1)).alias("u"))
    u = F.coalesce("u", F.lit(0))
    return hashed.select("rep", "n_shingles").join(own, "rep", "left").where(100 * (F.col("n_shingles") - u) >= percent * F.col("n_shingles")).select("rep")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, hashes: int = HASHES, rows: int = ROWS) -> DataFrame:
    """One row for each row of df: (id, n_shingles, component): component is the smallest id reachable by links of Jaccard
    similarity >= percent / 100 between shingle sets, the row's own id included."""
    store = Scratch(df.sparkSession, "minhash")
    sets = store.keep(signatures(df, doc_id, text, width, hashes))
    full = sets.where("n_shingles > 0 and id is not null")
    reps = store.keep(full.groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").alias("rep"), F.min("signature").alias("signature")))
    bands = F.transform(F.sequence(F.lit(0), F.lit(hashes // rows - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))
    all_buckets = reps.select("rep", F.explode(bands).alias("bucket"))
    shared = all_buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = store.keep(all_buckets.distinct().join(shared, "bucket"))
    # how many others a set meets: the original of many near copies meets more than each of them
    central = members.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("w"))
    buckets = store.keep(members.select("bucket", "rep").join(central, "rep"))
    store.drop(members)
    involved = buckets.select("rep").distinct()
    minima = store.bucketed(reps.join(involved, "rep", "left_semi").groupBy("rep").agg(F.min("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")), "rep")
    # links through repeated ids: sets that one id stands for
    edges = store.keep(full.join(reps.select("n_shingles", "set_a", "set_b", "rep"), ["n_shingles", "set_a", "set_b"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())
    sizes = store.keep(sets.select("id", "n_shingles"))
    store.drop(sets, reps)
    store.release()
    wanted = df.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"))
    texts = store.bucketed(wanted.where("rep is not null and text is not null").join(involved, "rep", "left_semi").groupBy("rep").agg(F.min("text").alias("text")), "rep")
    least = hashes * (percent / 100 - SLACK)

    def met(pairs: DataFrame, facts: DataFrame, name: str) -> DataFrame:
        """pairs: (m, p, salts), members and their pivots. Adds m_ and p_`name`. The facts of a member go to its pivot; those of a pivot with
        many members are copied, so the members are dealt over `salts` tasks."""
        of_m = pairs.join(facts.select(F.col("rep").alias("m"), F.col(name).alias(f"m_{name}")), "m").withColumn("salt", F.pmod(F.xxhash64("m"), "salts"))
        of_p = pairs.select("p", "salts").distinct().join(facts.select(F.col("rep").alias("p"), F.col(name).alias(f"p_{name}")), "p")
        return of_m.join(of_p.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"), ["p", "salt"])

    def links(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Signature verification, then confirmation: the links, and the table that they are read from."""
        same = F.aggregate(F.zip_with("m_signature", "p_signature", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
        near = store.keep(met(pairs, minima, "signature").where(same >= least).select("m", "p", "salts"))
        both = met(near, texts, "text")
        return confirm(both.select(F.col("m").alias("a"), F.col("p").alias("b"), F.col("m_text").alias("text_a"), F.col("p_text").alias("text_b")), width, percent), near

    of = None
    for _ in range(TURNS):
        now = buckets.withColumn("c", F.col("rep")) if of is None else buckets.join(of, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
        apart = now.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n"), F.max(F.struct("w", F.xxhash64("rep"), "rep", "c")).alias("pivot")).where("low < high")
        apart = store.keep(apart.select("bucket", "n", F.col("pivot.rep").alias("p"), F.col("pivot.c").alias("pc")))
        salts = apart.groupBy("p").agg(F.ceil(F.sum("n") / MEMBERS).alias("salts"))
        pairs = now.join(apart.join(salts, "p"), "bucket").where("c <> pc").groupBy(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).agg(F.max(F.struct("p", "salts")).alias("v"))
        pairs = store.keep(pairs.select(F.when(F.col("v.p") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("m"), "v.p", "v.salts"))
        got, near = links(pairs)
        if of is not None:
            got = got.union(of.select(F.col("rep").alias("a"), F.col("component").alias("b")))
        new = store.keep(components(got, store).withColumnRenamed("id", "rep"))
        # the pivots have met everyone in their buckets
        rest = store.keep(buckets.join(apart.select("bucket", "p"), "bucket").where("rep <> p").drop("p"))
        store.drop(buckets, apart, pairs, near, *([] if of is None else [of]))
        of, buckets = new, rest
        store.release()
    # Buckets still apart: what their pivots didn't join is compared in blocks.
    now = buckets.join(of, "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("c"))
    apart = now.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
    left = store.keep(now.join(apart, "bucket", "left_semi"))
    hashed = store.keep(shingle_sets(texts.join(left.select("rep").distinct(), "rep", "left_semi"), width, hashes))
    store.drop(texts)
    left = left.join(store.keep(_linkable(hashed, percent)), "rep", "left_semi")
    apart = left.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
    left = store.keep(left.join(apart, "bucket", "left_semi"))
    store.drop(minima)
    store.release()
    got = store.keep(_block_pairs(left, hashed, percent, hashes, store))
    edges = edges.union(got).union(of.select(F.col("rep").alias("a"), F.col("component").alias("b")).where("a <> b"))
    final = components(edges, store)
    return store.finish(sizes.join(final, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component")))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df that stand for their group: one document of each, the one with the smallest id. Of repeated rows with
    one id, all with that id stay or go together; rows with a null id stay."""
    classes = near_duplicates(df, doc_id, text, **options)
    gone = classes.where("id <> component").select(F.col("id").alias(doc_id)).distinct()
    return df.join(gone, doc_id, "left_anti").select(*df.columns)
