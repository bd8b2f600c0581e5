"""Snapshots: validation, upsert outcome, stock sweep, events of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import event_id, number_text

#: When a sweep is trusted.
LEAST_RATIO, LEAST_BASELINE, MOST_FAILED = 0.3, 20, 0.34


def changed(old: str, new: str) -> Column:
    """Whether a listing differs: prices, name, description ('' is null), image, sizes in any order."""
    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    same = o("price").eqNullSafe(n("price")) & o("compare_at_price").eqNullSafe(n("compare_at_price")) & o("name").eqNullSafe(n("name"))
    same = same & (F.coalesce(o("description"), F.lit("")) == F.coalesce(n("description"), F.lit(""))) & (F.coalesce(o("image_url"), F.lit("")) == F.coalesce(n("image_url"), F.lit("")))
    sizes = lambda c: F.array_sort(F.coalesce(c("sizes"), F.array().cast("array<string>")))
    return ~(same & (sizes(o) == sizes(n)))


def upsert(current: DataFrame, incoming: DataFrame, key: str, differs: Column | None = None) -> DataFrame:
    """Full outer join on key with `outcome`: inserted, updated, unchanged or unseen; both sides as structs `old` and `new`."""
    c = current.select(key, F.struct(*current.columns).alias("old"))
    n = incoming.select(key, F.struct(*incoming.columns).alias("new"))
    outcome = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "unseen").when(differs if differs is not None else changed("old", "new"), "updated").otherwise("unchanged")
    return c.join(n, key, "full").withColumn("outcome", outcome)


def sweep_decision(seen: Column, in_stock: Column, failed: Column, collections: Column, allow_mass: bool = False) -> tuple[Column, Column]:
    """(mark, reason): whether unseen listings may be marked as sold out."""
    reason = F.when(seen == 0, "nothing seen")
    if not allow_mass:
        reason = reason.when((collections > 0) & (failed / collections > MOST_FAILED), "run incomplete").when((in_stock >= LEAST_BASELINE) & (seen < in_stock * LEAST_RATIO), "too few seen")
    return reason.isNull(), reason


def unseen(current: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """In-stock listings that a run didn't see."""
    return current.where(~F.col("in_stock").eqNullSafe(F.lit(False))).join(seen.select(*keys).distinct(), keys, "left_anti")


def run_events(outcomes: DataFrame, key: str, with_time: Column | None = None) -> DataFrame:
    """Events of an upsert: discovered for inserted rows, price_changed where the price differs. Ids are the same for the same fact;
    with_time makes a repeat of the same price move an event of its own."""
    kind = F.when(F.col("outcome") == "inserted", "discovered").when((F.col("outcome") == "updated") & (F.col("old.price") != F.col("new.price")), "price_changed")
    rows = outcomes.withColumn("type", kind).where(F.col("type").isNotNull())
    url, old, new = F.col(key).cast("string"), number_text("old.price"), number_text("new.price")
    extra = [with_time] if with_time is not None else []
    ident = F.when(F.col("type") == "discovered", event_id("type", url, new, *extra)).otherwise(event_id("type", url, old, new, *extra))
    return rows.select(ident.alias("event_id"), "type", key, F.col("old.price").alias("old_price"), F.col("new.price").alias("new_price"))


def big_drops(before: DataFrame, after: DataFrame, key: str, least: int = 20, kept: float = 0.5) -> DataFrame:
    """Groups whose count fell below a share of what it was."""
    b, a = before.groupBy(key).agg(F.count(F.lit(1)).alias("before")), after.groupBy(key).agg(F.count(F.lit(1)).alias("after"))
    both = b.join(a, key, "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return both.where((F.col("before") >= least) & (F.col("after") < kept * F.col("before")))


def patch(df: DataFrame, key: str, corrections: dict[str, Column]) -> DataFrame:
    """(key, field, old, new) of fields that a rule gives another value; nothing is written here."""
    items = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old"), c.cast("string").alias("new")) for f, c in corrections.items()))
    return df.select(key, F.inline(items)).where(F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new")))


def drop_report(before: DataFrame, after: DataFrame, key: str, image: str, kept: float = 0.5, least: int = 20) -> DataFrame:
    """(key, before, after, images_before, images_after, few, bare): what a refresh did to each group's rows and to the share of them with a picture;
    few: the rows fell below the share `kept` (of `least` rows or more); bare: the share of pictures did."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name), F.round(F.count_if(F.coalesce(F.col(image), F.lit("")) != "") / F.count(F.lit(1)), 4).alias(f"images_{name}"))
    both = count(before, "before").join(count(after, "after"), key, "left").withColumns({"after": F.coalesce("after", F.lit(0)), "images_after": F.coalesce("images_after", F.lit(0.0))})
    large = F.col("before") >= least
    return both.withColumns({"few": large & (F.col("after") < kept * F.col("before")), "bare": large & (F.col("after") > 0) & (F.col("images_after") < kept * F.col("images_before"))})
