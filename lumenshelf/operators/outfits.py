"""What completes an outfit: rules give each hero slots to fill, and each slot is filled from a pool by score, then id.

The pool is never paired with the heroes. A candidate's score says which of four lists it stands in: those that share an occasion
and the colour, an occasion, the colour, or neither. Of each list only rows that can be among the first k under some price limit
are kept (`first_under_any_price`): few, whatever the pool's size. Heroes then meet their lists by equal keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import in_stock
from .lists import first_under_any_price

MOST = 5
DEARER = 1.4
COORDINATES = ("dupatta_eastern", "bottom_eastern", "bottom_western")
#: The advice that goes with a slot.
ADVICE = {
    "western_bottom": "Relaxed denim or wide-leg trousers balance a fitted western top.",
    "dupatta_two": "A coordinating dupatta completes most 2-piece eastern looks.",
    "bottom_set": "Trousers or shalwar ground the outfit when the shirt and dupatta are set.",
    "dupatta_one": "Adds polish to a single kurta or shirt piece.",
    "bottom_one": "Pair with bottoms to build a wearable day or event outfit.",
}


@dataclass(frozen=True)
class Slot:
    """A rule: where `when` holds, up to `limit` pieces of a pool fill a role."""

    name: str
    role: str
    pool: str
    limit: int
    when: Column


def pools() -> dict[str, Column]:
    """Which rows can fill what. Expected columns: sub_category, dress_style, name."""
    sub, style = F.lower(F.coalesce("sub_category", F.lit(""))), F.lower(F.coalesce("dress_style", F.lit("")))
    legs = sub.isin("pants", "shalwar")
    return {
        "western_bottom": (style == "trouser") | (sub == "western") | F.coalesce(F.col("name").rlike("(?i)jean|denim|trouser|pant"), F.lit(False)),
        "dupatta": sub == "dupatta",
        "bottom_or_trouser": legs | (style == "trouser"),
        "bottom": legs,
    }


def slots(focus: tuple[str, ...] = ()) -> list[Slot]:
    """Rules over a hero's columns: fashion_type, gender, dress_style, sub_category, name, pieces ("2-piece"), includes (garments of the set).
    focus: coordinates that are wanted; others then aren't. none alone wants nothing."""
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    named = [f for f in focus if f in COORDINATES]
    if "none" in focus and set(focus) == {"none"}:
        return []
    dupatta, eastern, western = (not named or c in named for c in COORDINATES)
    sub, style, pieces = text("sub_category"), text("dress_style"), text("pieces")
    is_western = F.coalesce(F.col("fashion_type"), F.lit("eastern")) == "western"
    top = style.isin("top", "t-shirt", "polo") | F.contains(sub, F.lit("western")) | text("name").rlike("top|tee|shirt")
    garments = F.transform(F.coalesce("includes", F.array().cast("array<string>")), F.lower)
    has = lambda pattern: F.exists(garments, lambda x: x.rlike(pattern))
    shirt, trouser, scarf = has("shirt|kameez|kurta|top"), has("trouser|pant|shalwar|palazzo"), has("dupatta")
    single = (pieces == "1-piece") | (sub == "kurta")
    rules = [
        (western, Slot("western_bottom", "bottom", "western_bottom", 2, is_western & (F.coalesce("gender", F.lit("women")) == "women") & top)),
        (dupatta, Slot("dupatta_two", "dupatta", "dupatta", 2, ~is_western & ((pieces == "2-piece") | F.contains(sub, F.lit("2-piece"))) & ~scarf)),
        (eastern, Slot("bottom_set", "bottom", "bottom_or_trouser", 2, ~is_western & shirt & scarf & ~trouser)),
        (dupatta, Slot("dupatta_one", "dupatta", "dupatta", 1, ~is_western & single)),
        (eastern, Slot("bottom_one", "bottom", "bottom", 1, ~is_western & single)),
    ]
    return [s for wanted, s in rules if wanted]


def complete(df: DataFrame, heroes: DataFrame, key: str, focus: tuple[str, ...] = (), stocked: bool = False) -> DataFrame:
    """(hero_id, place, role, slot, key, score, advice): at most MOST pieces a hero, in the order of the rules, each slot's best by 2 for a shared
    occasion and 1 for the same colour, ties by id. Candidates are of the hero's gender or unisex, not the hero itself, and at most
    1.4 times as dear (rounded; a hero without a price sets no limit). Null genders count as women."""
    rules = slots(focus)
    empty = "hero_id long, place int, role string, slot string, " + f"{key} long, score int, advice string"
    if not rules:
        return df.sparkSession.createDataFrame([], empty)
    each = F.array_compact(F.array(*(F.when(F.coalesce(s.when, F.lit(False)), F.struct(F.lit(i).alias("turn"), F.lit(s.name).alias("slot"), F.lit(s.role).alias("role"), F.lit(s.pool).alias("pool"), F.lit(s.limit).alias("limit"))) for i, s in enumerate(rules))))
    occasions = F.array_distinct(F.transform(F.coalesce("occasion", F.array().cast("array<string>")), F.lower))
    any_of = F.concat(F.transform(occasions, lambda o: F.concat(F.lit("+"), o)), F.array(F.lit("")))  # each occasion, and whatever occasion
    gender = F.coalesce("gender", F.lit("women"))
    with_key = lambda rows, pool, sex: rows.withColumn("list", F.concat_ws("|", pool, sex, F.col("o"), F.col("tone")))

    # lists of candidates
    mine = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in pools().items())))
    stock = df.where(in_stock()) if stocked else df
    pool = stock.select(F.col(key).cast("long").alias("id"), "price", gender.alias("sex"), any_of.alias("os"), F.col("primary_color").alias("tone"), F.explode(mine).alias("pool"))
    pool = pool.withColumn("o", F.explode("os")).withColumn("tone", F.explode(F.array_compact(F.array("tone", F.lit("")))))
    most = max(s.limit for s in rules) + 1  # one may be the hero itself
    lists = first_under_any_price(with_key(pool, F.col("pool"), F.col("sex")), "list", "id", "price", most)

    # what heroes look for
    wanted = heroes.select(F.col(key).cast("long").alias("hero_id"), F.round(F.col("price") * DEARER).alias("cap"), gender.alias("g"), any_of.alias("os"), F.col("primary_color").alias("tone"), F.inline(each))
    wanted = wanted.withColumn("o", F.explode("os")).withColumn("sex", F.explode(F.array_distinct(F.array("g", F.lit("unisex"))))).withColumn("tone", F.explode(F.array_compact(F.array("tone", F.lit("")))))
    level = F.when(F.col("o") != "", 2).otherwise(0) + F.when(F.col("tone") != "", 1).otherwise(0)
    asked = with_key(wanted, F.col("pool"), F.col("sex")).select("hero_id", "cap", "turn", "slot", "role", "limit", "list", level.alias("score"))
    met = asked.join(lists, "list").where((F.col("id") != F.col("hero_id")) & (F.col("cap").isNull() | (F.col("price") <= F.col("cap"))))
    best = met.groupBy("hero_id", "turn", "slot", "role", "limit", "id").agg(F.max("score").alias("score"))
    in_slot = Window.partitionBy("hero_id", "turn").orderBy(F.desc("score"), "id")
    filled = best.withColumn("at", F.row_number().over(in_slot)).where(F.col("at") <= F.col("limit"))
    placed = filled.withColumn("place", F.row_number().over(Window.partitionBy("hero_id").orderBy("turn", "at"))).where(F.col("place") <= MOST)
    advice = F.create_map(*(F.lit(x) for kv in ADVICE.items() for x in kv))[F.col("slot")]
    return placed.select("hero_id", "place", "role", "slot", F.col("id").alias(key), "score", advice.alias("advice"))
