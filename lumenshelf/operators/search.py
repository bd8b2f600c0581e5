"""Retrieval: vector scans, hybrid scores, keyword search with fallback, rank fusion, collapse to one row per design."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..functions import vector as V
from ..functions.text import col, query_words

HINT = 0.08
#: Similarity below which results count as noise, by how much a query says.
FLOORS = {"strong": 0.10, "some": 0.14, "none": 0.18}


def vector_scan(df: DataFrame, query: Sequence[float], key: str, vector: str = "embedding", k: int = 20, floor: float | None = None) -> DataFrame:
    """Top k by cosine with a query vector (`score`), ties by key. A floor drops what lies below it."""
    q = F.array(*(F.lit(float(x)) for x in query))
    out = df.withColumn("score", F.round(V.cosine(vector, q), 4))
    out = out.where(F.col("score") >= floor) if floor is not None else out
    return out.orderBy(F.desc("score"), key).limit(k)


def blend_weight(length: int, strong: bool) -> float:
    """Weight of the dense score; the longer the query the more."""
    w = 0.38 + min(1, length / 200) * 0.44 - (0.12 if strong and length < 48 else 0)
    return min(0.84, max(0.34, w))


def floor_of(strong: bool, some: bool) -> float:
    return FLOORS["strong" if strong else "some" if some else "none"]


def occasion_facet(wanted: Column, has: Column) -> Column:
    n, hits = F.size(wanted), F.size(F.filter(wanted, lambda o: F.array_contains(has, o)))
    known = F.coalesce(F.size(has), F.lit(0)) > 0
    return F.when(n <= 0, 0.55).when(~known, 0.35).when(hits > 0, 0.55 + 0.45 * F.least(F.lit(1.0), hits / n)).otherwise(0.12)


def color_facet(wanted: Column, primary: Column, colors: Column) -> Column:
    """wanted: families, empty if the query names no colour."""
    fits = F.coalesce(F.array_contains(wanted, primary), F.lit(False))
    return (
        F.when((F.size(wanted) <= 0) | F.array_contains(wanted, "Multicolor"), 0.55)
        .when(fits, 1.0)
        .when(F.coalesce(F.arrays_overlap(wanted, colors), F.lit(False)), 0.88)
        .when(primary.isNotNull(), 0.1)
        .otherwise(0.22)
    )


def garment_facet(wanted: Column, *texts: Column) -> Column:
    n = F.size(wanted)
    hits = F.size(F.filter(wanted, lambda g: F.greatest(*(F.contains(F.lower(F.coalesce(t, F.lit(""))), g) for t in texts)) if len(texts) > 1 else F.contains(F.lower(F.coalesce(texts[0], F.lit(""))), g)))
    return F.when(n <= 0, 0.55).when(hits > 0, 0.5 + 0.5 * hits / n).otherwise(0.25)


def keyword_facet(query: str | Column, hay: Column) -> Column:
    words = query_words(query)
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(hay), w)))
    return F.when(F.size(words) <= 0, 0.45).otherwise(0.35 + 0.65 * hits / F.size(words))


def facet_score(occasion: Column, color: Column, garment: Column, keyword: Column) -> Column:
    return F.round(occasion * 0.34 + color * 0.34 + garment * 0.12 + keyword * 0.2, 4)


def hybrid_score(cosine: Column, facet: Column, weight: float) -> Column:
    return F.round(weight * cosine + (1 - weight) * facet, 4)


def catalog_hint(score: Column, catalog: str | Column, hints: list[str]) -> Column:
    """Rows of a hinted catalog move up, others down; without hints nothing moves."""
    return F.round(score + F.when(col(catalog).isin(hints), HINT).otherwise(-HINT), 4) if hints else score


def above_floor_or_best(df: DataFrame, score: str, key: str, floor: float, limit: int) -> DataFrame:
    """Rows at or above the floor; if there are none, the best max(limit, 10) of all."""
    kept = df.where(F.col(score) >= floor).orderBy(F.desc(score), key).limit(limit)
    any_kept = F.broadcast(df.where(F.col(score) >= floor).limit(1).agg(F.count(F.lit(1)).alias("_any")))  # one row
    best = df.orderBy(F.desc(score), key).limit(max(limit, 10)).crossJoin(any_kept).where("_any = 0").drop("_any")
    return kept.unionByName(best).orderBy(F.desc(score), key).limit(limit)


def collapse(df: DataFrame, group: str | Column, key: str, score: str) -> DataFrame:
    """The best row of each group, with `variants`; rows without a group stay apart (variants null)."""
    part = F.coalesce(col(group).cast("string"), F.concat(F.lit("\u0001"), F.col(key).cast("string")))
    w = Window.partitionBy("_part")
    ranked = df.withColumn("_part", part).withColumns({"_rank": F.row_number().over(w.orderBy(F.desc(score), key)), "_n": F.count(F.lit(1)).over(w)})
    return ranked.where("_rank = 1").withColumn("variants", F.when(F.col("_n") > 1, F.col("_n"))).drop("_part", "_rank", "_n")


def fuse(a: DataFrame, b: DataFrame, key: str, score_a: str, score_b: str, k: int = 60, weight_a: float = 1.0, weight_b: float = 1.0) -> DataFrame:
    """Reciprocal-rank fusion of two short ranked lists: (key, rank_a, rank_b, fused); ties keep the order of the first list."""
    ranked = lambda df, s, name: df.select(key, F.row_number().over(Window.orderBy(F.desc(s), key)).alias(name))  # noqa: E731  lists of a few rows
    both = ranked(a, score_a, "rank_a").join(ranked(b, score_b, "rank_b"), key, "full")
    part = lambda w, r: F.coalesce(w / (k + F.col(r)), F.lit(0.0))
    return both.withColumn("fused", F.round((part(weight_a, "rank_a") + part(weight_b, "rank_b")) * 1000, 3)).orderBy(F.desc("fused"), F.asc_nulls_last("rank_a"), key)


def keyword_search(df: DataFrame, query: str, key: str, text: Column, source: Column, limit: int = 20) -> DataFrame:
    """Rows by the number of the query's words that their text holds as whole words (`hits`); sources without such a row fall
    back to rows that contain the query's words anywhere, with 0 hits. `fallback` tells which."""
    words = [w for w in query.lower().split() if w]
    whole = sum((text.rlike(rf"(?i)(^|[^a-z0-9])\Q{w}\E($|[^a-z0-9])").cast("int") for w in words), F.lit(0))
    part = F.lit(False)
    for w in words:
        part = part | F.contains(F.lower(text), F.lit(w))
    found = df.withColumns({"source": source, "hits": whole, "_part": part}).where((F.col("hits") > 0) | F.col("_part"))
    sources = found.groupBy("source").agg(F.max("hits").alias("_best"))
    out = found.join(F.broadcast(sources), "source").where((F.col("hits") > 0) | (F.col("_best") == 0))
    return out.withColumn("fallback", F.col("_best") == 0).drop("_part", "_best").orderBy(F.desc("hits"), "source", key).limit(limit)


def autocomplete(sources: dict[str, tuple[DataFrame, str, str]], text: str, each: int = 5, limit: int = 10) -> DataFrame:
    """(source, id, name) of names that contain the text: a few of each source. sources: name -> (table, id, name column).
    Fewer than two letters find nothing."""
    parts = []
    for i, (name, (df, key, label)) in enumerate(sources.items()):
        hit = F.contains(F.lower(F.col(label)), F.lit(text.lower())) if len(text.strip()) >= 2 else F.lit(False)
        top = df.where(hit).select(F.lit(i).alias("_at"), F.lit(name).alias("source"), F.col(key).cast("long").alias("id"), F.col(label).alias("name"))
        parts.append(top.orderBy("name", "id").limit(each))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("_at", "name", "id").limit(limit).drop("_at")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a sorted table; size from 1 to 48."""
    size = min(48, max(1, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def union_catalogs(catalogs: dict[str, DataFrame], tag: str = "catalog") -> DataFrame:
    """All catalogs below each other, missing columns null, tagged."""
    out = None
    for name, df in catalogs.items():
        tagged = df.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def keep_if_enough(df: DataFrame, condition: Column, least: int = 3) -> DataFrame:
    """The rows that meet the condition if there are `least` of them, else all rows."""
    n = F.broadcast(df.where(condition).limit(least).agg(F.count(F.lit(1)).alias("_n")))  # one row
    return df.crossJoin(n).where((F.col("_n") < least) | F.coalesce(condition, F.lit(False))).drop("_n")


def presorted(df: DataFrame, first: Column, then: Column, key: str, keep: int = 20, limit: int = 10) -> DataFrame:
    """The `keep` best rows by the first score, ranked by the second one (`score`, `rank`), of which `limit` stay. Ties by key."""
    best = df.withColumn("_first", first).orderBy(F.desc("_first"), key).limit(keep)
    by = Window.orderBy(F.desc("score"), key)  # of `keep` rows
    return best.withColumn("score", then).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).drop("_first")


def widen(ranked: DataFrame, group: str, rank: str, accepted: Column, want: int, first: int | None = None, rounds: int = 3) -> DataFrame:
    """For each group (a request) the smallest of the pools of the first c, 2c, 4c, ... rows by rank that has enough accepted ones, or the last pool.
    Of it the first `want` accepted rows, with `pool` (its rows) and `round`. Enough: `want`, or all of a pool that is smaller than that.
    Rows are ranked and counted once; no pool is fetched again."""
    first = first or max(3 * want, 15)
    sizes = [first * 2**i for i in range(rounds)]
    order = Window.partitionBy(group).orderBy(rank)
    counted = ranked.withColumns({"_at": F.row_number().over(order), "_ok": F.coalesce(accepted, F.lit(False))}).where(F.col("_at") <= sizes[-1])
    totals = counted.groupBy(group).agg(F.count(F.lit(1)).alias("_all"), *(F.count_if(F.col("_ok") & (F.col("_at") <= n)).alias(f"_n{n}") for n in sizes))
    whole = [F.least(F.lit(n), F.col("_all")) for n in sizes]
    enough = [(F.col(f"_n{n}") >= F.least(F.lit(want), w)) | (w == F.col("_all")) for n, w in zip(sizes, whole, strict=True)]
    turn = F.coalesce(*(F.when(e, F.lit(i + 1)) for i, e in enumerate(enough)), F.lit(rounds))
    chosen = totals.select(group, turn.alias("round"), F.element_at(F.array(*whole), turn).cast("int").alias("pool"))
    kept = counted.join(chosen, group).where(F.col("_ok") & (F.col("_at") <= F.col("pool")))
    return kept.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= want).drop("_at", "_ok", "_k")


def colour_or_keyword(colors: list[str], keywords: list[str], most: int = 5) -> Column:
    """Rows in stock that have one of the colours in one of four fields, or one of the first keywords in name, tags or description; patterns,
    without regard to case. Nothing asked for finds nothing."""
    like = lambda p: lambda x: x.rlike(p)
    tests = []
    for c in (c for c in colors if c):
        p = f"(?i){c}"
        tests += [F.col("primary_color").rlike(p), F.col("primary_exact_color").rlike(p), F.exists("exact_colors", like(p)), F.exists("colors", like(p))]
    for k in (k for k in keywords[:most] if k):
        p = f"(?i){k}"
        tests += [F.col("name").rlike(p), F.exists("tags", like(p)), F.col("description").rlike(p)]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out & ~F.coalesce(~F.col("in_stock"), F.lit(False))


#: Words that tell the catalog of what a photo shows.
PHOTO = [
    ("shoes", r"\b(shoe|heel|pump|stiletto|sandal|chappal|sneaker|trainer|jogger|boot|loafer|flat|wedge|mule|slipper|khussa|kolhapuri|peshawari|oxford|clog|espadrille)s?\b"),
    ("jewelry", r"\b(earring|jhumka|chandbali|necklace|choker|mala|pendant|bracelet|bangle|kada|ring|nose[- ]?pin|nath|tikka|jhoomar|passa|anklet|payal|brooch|cufflink|jewel(?:le)?ry)s?\b"),
    ("watches", r"\b(watch|wristwatch|chronograph|smartwatch)(?:es)?\b"),
]


def photo_catalog(category: str | Column, keywords: Column) -> Column:
    """The one catalog that a described photo belongs to."""
    text = F.lower(F.concat_ws(" ", col(category), F.array_join(keywords, " ")))
    return F.coalesce(*(F.when(text.rlike(p), F.lit(name)) for name, p in PHOTO), F.lit("clothing"))


def photo_colors(text: str | Column, what: str = "colors", most: int = 2) -> Column:
    """At most two colour families ("colors") or shades ("shades") that a colour text names; none if it names only several colours."""
    found = color.infer(text)
    return F.when(found["primary_shade"].isin("multi", "multicolor", "multi color", "multi colour", "multicolour"), F.array().cast("array<string>")).otherwise(F.slice(found[what], 1, most))


CELL_ROWS, CELL_QUERIES = 50_000, 2_000
BLOCK = 1 << 21  # scores that are in memory at once


def matrix_topk(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, label: str, bonus: Callable[[np.ndarray, np.ndarray], np.ndarray], weight: float = 0.5, digits: int = 3, cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """(query_id, key, score, rank): for each query the k best rows by weight * cosine + bonus, rounded half up; ties by key; a row isn't its own match.
    bonus(labels of queries, labels of rows) gives a matrix. Both sides are dealt to cells of a bounded size; each pair of cells is
    a product of two matrices, worked out for a few queries at a time (BLOCK), of which the k best rows a query go on: pairs of rows are never written. Rows without a vector, or
    with an empty one, match nothing."""
    pick = lambda df: df.where((F.size(vector) > 0) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("l"))
    mine, theirs = pick(queries), pick(rows)
    across, down = max(1, -(-mine.count() // cell_queries)), max(1, -(-theirs.count() // cell_rows))
    cell = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = mine.withColumn("_q", cell(across)).withColumn("_r", every(down))
    right = theirs.withColumn("_r", cell(down)).withColumn("_q", every(across))

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        return flat / np.maximum(np.sqrt((flat * flat).sum(axis=1)), 1e-300)[:, None]

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and r.num_rows:
            ids, own = r.column("id").to_numpy(), q.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, theirs_l, mine_l = ids[order], np.array(r.column("l").to_pylist())[order], np.array(q.column("l").to_pylist())
            left_m, right_m = matrix(q), matrix(r)[order].T
            step = max(1, BLOCK // len(ids))
            for at in range(0, len(own), step):
                part = slice(at, at + step)
                scores = weight * (left_m[part] @ right_m) + bonus(mine_l[part], theirs_l)
                scores = np.floor(scores * 10**digits + 0.5) / 10**digits
                scores[own[part, None] == ids[None, :]] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k, None] if k < len(ids) else -np.inf
                i, j = np.nonzero((scores >= least) & (scores > -np.inf))
                by = np.lexsort((j, -scores[i, j], i))  # equal scores in the order of ids
                i, j = i[by], j[by]
                best_k = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[best_k], j[best_k]
                out += zip(own[part][i].tolist(), ids[j].tolist(), scores[i, j].tolist(), strict=True)
        names = ["query_id", "id", "score"]
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(zip(names, (pa.int64(), pa.int64(), pa.float64()), strict=True))})

    met = left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInArrow(best, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("id").alias(key), "score", "rank")
