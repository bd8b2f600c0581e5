"""Retrieval quality and data quality."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Spec = list[tuple[str, list[str]]]  # clauses: column, any of these words


def clause(c: Column, words: list[str]) -> Column:
    """One of the words begins somewhere in the text, at a word boundary."""
    return F.coalesce(F.lower(c).rlike("(^|[^a-z0-9])(" + "|".join(re.escape(w.lower()) for w in words) + ")"), F.lit(False))


def grade(spec: Spec) -> Column:
    """How many clauses a row meets."""
    return sum((clause(F.col(c), words).cast("int") for c, words in spec), F.lit(0))


def ranking_metrics(ranked: DataFrame, clauses: int, k: int = 10) -> DataFrame:
    """ranked: (query, position from 1, grade, relevant_total). One row a query: precision, recall (of min(total, k)), reciprocal rank,
    nDCG (at most 1); recall and nDCG are null without relevant rows."""
    top = ranked.where(F.col("position") <= k)
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("position") + 1)
    full = F.col("grade") == clauses
    by = top.groupBy("query").agg(F.max("relevant_total").alias("relevant_total"), F.count(F.lit(1)).alias("n"), F.count(F.when(full, 1)).alias("hits"), F.min(F.when(full, F.col("position"))).alias("first"), F.sum(gain).alias("dcg"))
    best = F.least(F.col("relevant_total"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i <= best), F.lit(0.0), lambda s, i: s + (2.0**clauses - 1) / F.log2(i + 1.0))
    return by.select(
        "query", "hits", "relevant_total",
        F.round(F.col("hits") / F.col("n"), 4).alias("precision"),
        F.round(F.when(best > 0, F.col("hits") / best), 4).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("rr"),
        F.round(F.when(best > 0, F.least(F.lit(1.0), F.col("dcg") / ideal)), 4).alias("ndcg"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Means over the queries that have relevant rows; the others are listed."""
    answered = F.col("relevant_total") > 0
    means = [F.round(F.avg(F.when(answered, F.col(c))), 4).alias(c if c != "rr" else "mrr") for c in ("precision", "recall", "rr", "ndcg")]
    return metrics.agg(F.count(F.lit(1)).alias("queries"), F.count(F.when(answered, 1)).alias("scored"), F.array_sort(F.collect_list(F.when(~answered, F.col("query")))).alias("unanswerable"), *means)


def regressions(now: DataFrame, baseline: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """(metric, value, baseline) of means that fell by more than the tolerance."""
    items = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(b)).alias("baseline")) for m, b in baseline.items()))
    return now.select(F.inline(items)).where(F.col("value") < F.col("baseline") - tolerance)


def issues(rules: dict[str, tuple[str, Column]]) -> Column:
    """array<struct<severity, type>> of the rules (type -> severity, condition) that hold."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(t).alias("type"))) for t, (s, c) in rules.items())))


def issue_counts(df: DataFrame, column: str = "issues") -> DataFrame:
    return df.select(F.explode(column).alias("i")).groupBy("i.severity", "i.type").agg(F.count(F.lit(1)).alias("n"))


def upper_median(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """The element at place floor(n / 2), counted from 0, of each group's sorted values: exact, and without gathering a group."""
    n = df.where(F.col(value).isNotNull())
    group = [by] if by else []
    freq = n.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*group).orderBy(value)
    upto = freq.withColumn("_upto", F.sum("_k").over(w)).withColumn("_all", F.sum("_k").over(Window.partitionBy(*group)))
    return upto.where("_upto > floor(_all / 2)").groupBy(*group).agg(F.min(value).alias("median"))


def duplicate_groups(df: DataFrame, *key: Column) -> DataFrame:
    names = [f"k{i}" for i in range(len(key))]
    return df.groupBy(*(k.alias(n) for k, n in zip(key, names, strict=True))).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def histogram(df: DataFrame, value: str, edges: list[float], by: str) -> DataFrame:
    """Cumulative bucket counts (le, n) of each group, the last bucket unbounded."""
    items = F.array(*(F.struct(F.lit(float(e)).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate([*edges, float("inf")])))
    counts = df.groupBy(by).agg(*(F.count(F.when(F.col(value) <= e, 1)).alias(f"b{i}") for i, e in enumerate([*edges, float("inf")])))
    return counts.select(by, F.inline(items))


def quantile_of_buckets(hist: DataFrame, q: float, by: str) -> DataFrame:
    """Linear interpolation within the bucket that holds the quantile; the last finite edge for the unbounded one."""
    w = Window.partitionBy(by).orderBy("le")
    marked = hist.withColumns({"below": F.coalesce(F.lag("n").over(w), F.lit(0)), "low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "total": F.max("n").over(Window.partitionBy(by))})
    hit = marked.where((F.col("n") >= q * F.col("total")) & (F.col("below") < q * F.col("total")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (q * F.col("total") - F.col("below")) / (F.col("n") - F.col("below"))
    return hit.select(by, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("quantile"))


def copies(df: DataFrame, key: str) -> DataFrame:
    """(rows, ids, repeated): how many rows came, of how many ids, and how many of them again."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("ids")).withColumn("repeated", F.col("rows") - F.col("ids"))


def needs_refinement(least_score: float = 0.52) -> Column:
    """Whether a listing's fields should be filled in from its text: there is text enough to read (25 characters), and two of five fields are
    empty, the garments of a set are missing or too few, or its metadata score is low. Expected columns: description, tags, gender,
    piece_type, stitching, dress_style, pattern, includes, pieces, metadata_score."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    text = F.length(F.coalesce("description", F.lit(""))) + F.length(F.array_join(tags, " "))
    empty = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", 1).otherwise(0) for c in ("gender", "piece_type", "stitching", "dress_style", "pattern")), F.lit(0))
    listed = F.size(F.coalesce("includes", F.array().cast("array<string>")))
    few = F.coalesce(F.col("piece_type").contains("piece") & (F.col("pieces") > 0) & (listed < F.least(F.col("pieces"), F.lit(3))), F.lit(False))
    return (text >= 25) & ((empty >= 2) | (listed == 0) | few | (F.coalesce("metadata_score", F.lit(0.0)) < least_score))


def profile(df: DataFrame, faults: dict[str, Column], price: str = "price", brand: str = "brand", name: str = "name", stock: str = "in_stock") -> DataFrame:
    """(measure, n, share) of a catalog: rows, brands, in stock, each fault, prices a tenth of the median or ten times it, and groups of rows with
    one brand and name. The median is exact; the rest is one pass and one grouped count."""
    priced = df.where(F.col(price) > 0)
    median = F.broadcast(upper_median(priced, price))  # one row
    flags = {"no price": ~F.coalesce(F.col(price) > 0, F.lit(False)), "odd price": F.coalesce((F.col(price) > 0) & ((F.col(price) < F.col("median") * 0.1) | (F.col(price) > F.col("median") * 10)), F.lit(False)), **{k: F.coalesce(c, F.lit(False)) for k, c in faults.items()}}
    counts = df.join(median, how="left").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(brand).alias("brands"), F.count_if(~F.col(stock).eqNullSafe(F.lit(False))).alias("in stock"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    repeated = duplicate_groups(df, F.col(brand), F.lower(F.trim(name))).agg(F.count(F.lit(1)).alias("repeated names"))
    names = ["rows", "brands", "in stock", *flags, "repeated names"]
    both = counts.crossJoin(F.broadcast(repeated))  # one row each
    share = lambda k: F.when(F.lit(k not in ("rows", "brands", "repeated names")), F.round(F.col(f"`{k}`") / F.col("rows"), 4))
    return both.select(F.inline(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(f"`{k}`").alias("n"), share(k).alias("share")) for k in names))))


def worst_groups(df: DataFrame, group: str, faults: dict[str, Column], limit: int = 5) -> DataFrame:
    """(group, n, one count a fault, share): the groups with most faults a row; a row may have several. Ties by group."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in faults.items()))
    total = sum((F.col(f"`{k}`") for k in faults), F.lit(0))
    return counts.withColumn("share", F.round(total / F.col("n"), 4)).orderBy(F.desc(total / F.col("n")), F.col(group)).limit(limit)


def recent(df: DataFrame, time: str, as_of: str, days: int = 7) -> Column:
    """How many rows are of the last days before `as_of` (for agg())."""
    return F.count_if(F.col(time) >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(days)} days"))


def rates(events: DataFrame, time: str, width: str, by: list[str], part: Column) -> DataFrame:
    """(start, by, n, per_second, share) for each window of clock time: how many events, how many a second, the share that meets `part`."""
    seconds = F.unix_micros(F.col("w.end")) / 1e6 - F.unix_micros(F.col("w.start")) / 1e6
    counts = events.groupBy(F.window(F.col(time).cast("timestamp"), width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(part, F.lit(False))).alias("_part"))
    return counts.select(F.col("w.start").alias("start"), *by, "n", F.round(F.col("n") / seconds, 6).alias("per_second"), F.round(F.col("_part") / F.col("n"), 4).alias("share"))


def alerts(rated: DataFrame, limit: float, windows: int = 2, by: str = "event_type") -> DataFrame:
    """(by, start, share): where the share has been above the limit for so many windows in a row, at the last of them."""
    order = Window.partitionBy(by).orderBy("start")
    run = F.min("share").over(order.rowsBetween(1 - windows, 0))
    seen = F.count(F.lit(1)).over(order.rowsBetween(1 - windows, 0))
    return rated.withColumns({"_least": run, "_seen": seen}).where((F.col("_least") > limit) & (F.col("_seen") == windows)).select(by, "start", "share")
