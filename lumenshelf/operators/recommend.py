"""Recommendation: relaxation ladder, pair scores, pools and picks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..functions.text import overlap_score
from .filters import DISTINCTIVE, NOT_OUTFITS, Intent, given, hard, soft
from .folds import fold
from .lists import first_under_any_price

#: Constraints in the order in which they are given up.
RELAX = ["neckline", "occasion", "print", "dress_style", "stitching", "pieces", "fabric", "season", "color"]
ENOUGH = 8


def relax_order(priority: tuple[str, ...] = ()) -> list[str]:
    """What the shopper didn't rank goes first, then what they did, the last named first."""
    ranked = [p for p in (x.strip() for x in priority) if p in RELAX]
    return [c for c in RELAX if c not in ranked] + ranked[::-1] if ranked else list(RELAX)


@dataclass(frozen=True)
class Level:
    dropped: tuple[str, ...]
    color: str  # exact, family or none
    label: str | None


def levels(intent: Intent) -> list[Level]:
    has = given(intent)
    mode = "exact" if "color_exact" in has else "family" if "color_family" in has else "none"
    out, dropped = [Level((), mode, None)], []
    for c in relax_order(intent.priority):
        if c == "color":
            if mode == "exact" and "color_family" in has:
                out.append(Level(tuple(dropped), "family", "color_exact"))
            if mode != "none":
                out.append(Level(tuple(dropped), "none", "color"))
                mode = "none"
        elif c in has:
            dropped.append(c)
            out.append(Level(tuple(dropped), mode, c))
    return out


def level_filter(intent: Intent, level: Level, budget: bool = True) -> Column:
    out = hard(intent, budget)
    for name, c in soft(intent).items():
        if name == f"color_{level.color}" or (not name.startswith("color_") and name not in level.dropped):
            out = out & c
    return out


def level_counts(df: DataFrame, intent: Intent) -> DataFrame:
    """(level, n, cheapest): for each level its matches, and the lowest price without the budget. One scan for all levels."""
    rungs = levels(intent)
    aggs = []
    for i, r in enumerate(rungs):
        aggs += [F.count(F.when(level_filter(intent, r), 1)).alias(f"n{i}"), F.min(F.when(level_filter(intent, r, False), F.col("price"))).alias(f"p{i}")]
    rows = F.array(*(F.struct(F.lit(i).alias("level"), F.lit(r.label).cast("string").alias("relaxed"), F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("cheapest")) for i, r in enumerate(rungs)))
    return df.agg(*aggs).select(F.inline(rows))


@dataclass(frozen=True)
class Choice:
    level: Level | None
    relaxed: tuple[str, ...]
    budget_block: tuple[float, float] | None  # budget, cheapest


def choose(df: DataFrame, intent: Intent, least: int = ENOUGH) -> Choice:
    """The tightest level with enough matches, else the one with most. A budget below everything that fits stops the ladder; so
    does giving up a distinctive style once something of that style was found."""
    return ladder({r["level"]: (r["n"], r["cheapest"]) for r in level_counts(df, intent).collect()}, intent, least)  # one row a level


def ladder(counts: dict[int, tuple[int, float | None]], intent: Intent, least: int = ENOUGH) -> Choice:
    """The choice by (matches, lowest price without the budget) of each level."""
    best, most = None, 0
    for i, rung in enumerate(levels(intent)):
        n, cheapest = counts[i]
        relaxed = (*rung.dropped, *({"color_exact": ["exact color"], "color": ["color"]}.get(rung.label or "", [])))
        if "dress_style" in rung.dropped and intent.dress_style in DISTINCTIVE and most:
            break
        if n >= least:
            return Choice(rung, relaxed, None)
        if n > most:
            best, most = Choice(rung, relaxed, None), n
        if intent.max_budget > 0 and n == 0 and cheapest is not None:
            return Choice(None, relaxed, (intent.max_budget, cheapest))
    return best or Choice(None, (), None)


def recommend(df: DataFrame, intent: Intent, key: str, limit: int = 20, least: int = ENOUGH) -> DataFrame:
    """Rows of the chosen level by local score, with `score` and `tier`."""
    found = choose(df, intent, least)
    rows = df.where(level_filter(intent, found.level) if found.level else F.lit(False)).withColumn("score", local_score(intent))
    return rows.withColumn("tier", tier(F.col("score"), found)).orderBy(F.desc("score"), key).limit(limit)


def tier(score: Column, found: Choice) -> Column:
    if found.budget_block:
        return F.lit("over-budget")
    if not found.relaxed:
        return F.lit("exact")
    return F.when(score >= 8, "close").when(score >= 4, "similar").otherwise("loose")


def message(found: Choice) -> str | None:
    if found.budget_block:
        return f"Nothing fits under {found.budget_block[0]:g}; the cheapest match costs {found.budget_block[1]:g}."
    return f"Relaxed: {', '.join(found.relaxed)}." if found.relaxed else None


def local_score(intent: Intent) -> Column:
    """Points for each constraint that a row meets; accessories that slipped in lose five."""
    holds = soft(intent)
    points = {"pieces": 2, "stitching": 2, "dress_style": 4, "print": 1, "fabric": 1, "occasion": 1, "season": 1}
    total = F.lit(0)
    for name, p in points.items():
        if name in holds:
            total = total + F.when(holds[name], p).otherwise(0)
    if "color_exact" in holds or "color_family" in holds:
        exact, fam = holds.get("color_exact", F.lit(False)), holds.get("color_family", F.lit(False))
        total = total + F.when(exact, 3).when(fam, 2).otherwise(0)
    if intent.max_budget > 0:
        total = total + F.when(F.col("price") <= intent.max_budget, 1).otherwise(0)
    if intent.dress_style:
        total = total - F.when(F.col("name").rlike(NOT_OUTFITS), 5).otherwise(0)
    return total


def product_score(similarity: Column, colors_a: Column, colors_b: Column, occasion_a: Column, occasion_b: Column, style_a: Column, style_b: Column) -> Column:
    return F.round(similarity * 0.5 + color.best_compatibility(colors_a, colors_b) * 0.2 + overlap_score(occasion_a, occasion_b) * 0.2 + overlap_score(style_a, style_b) * 0.1, 3)


def footwear_score(dress_color: Column, shoe_color: Column, dress_occasion: Column, shoe_occasion: Column, dress_style: Column, shoe_type: Column) -> Column:
    """Colour, contrast, occasion and silhouette, at most 1; athletic shoes under eastern dress keep 12 per cent of that."""
    has = lambda *o: F.arrays_overlap(dress_occasion, F.array(*(F.lit(x) for x in o)))
    kind = F.lower(F.coalesce(shoe_type, F.lit("")))
    eastern = F.coalesce(F.lower(dress_style).isin("shalwar-kameez", "kurta", "lehenga", "saree", "abaya", "sherwani"), F.lit(False))
    formal = F.coalesce(has("wedding", "bridal", "formal", "party", "eid"), F.lit(False))
    contrast = F.when(dress_color.isin(color.BOLD) & shoe_color.isin(*[c for c in color.NEUTRAL if c != "Silver"]), 0.08).otherwise(0.0) + F.when(dress_color == shoe_color, 0.05).otherwise(0.0)
    occasion = F.when(F.coalesce(F.arrays_overlap(dress_occasion, shoe_occasion), F.lit(False)), 0.18).otherwise(0.06)
    shape = (
        F.when(F.coalesce(has("office"), F.lit(False)) & kind.rlike("loafer|pump|heel|oxford|flat"), 0.2)
        .when(formal & kind.rlike("heel|stiletto|pump|bridal|khussa|kolhapuri|mule"), 0.22)
        .when(eastern & ~formal & kind.rlike("khussa|kohati|kolhapuri|peshawari|sandal|chappal|wedge|mule|slide|slipper"), 0.2)
        .when(~eastern & ~formal & kind.rlike("sneaker|trainer|jogger|flat|slide|sandal|loafer"), 0.2)
        .otherwise(0.1)
    )
    total = F.least(F.lit(1.0), color.compatibility(dress_color, shoe_color) + contrast + occasion + shape)
    return F.round(F.when(eastern & kind.rlike("sneaker|trainer|jogger|running|basketball"), total * 0.12).otherwise(total), 3)


def jewelry_score(color_fit: Column, dress_occasion: Column, jewelry_occasion: Column, jewelry_type: Column, wanted: list[str]) -> Column:
    kind = F.lower(F.coalesce(jewelry_type, F.lit("")))
    heavy, minimal = bool(set(wanted) & {"wedding", "bridal", "mehndi", "barat", "valima"}), set(wanted) <= {"office", "casual"}
    weight = F.lit(1.0)
    weight = F.when(kind.rlike("stud|minimal|chain|bracelet"), 1.15).otherwise(weight) if minimal else weight
    weight = F.when(kind.rlike("bridal-set|jhumka|chandbali|necklace|choker|nath|tikka|jhoomar"), 1.2).otherwise(weight) if heavy else weight
    occasion = F.when(F.coalesce(F.arrays_overlap(dress_occasion, jewelry_occasion), F.lit(False)), 0.35).otherwise(0.12)
    return F.round(color_fit * 0.45 + occasion * weight, 3)


def watch_score(color_fit: Column, watch_occasion: Column, watch_type: Column, wanted: list[str]) -> Column:
    kind = F.lower(F.coalesce(watch_type, F.lit("")))
    occasion = F.when(F.coalesce(F.arrays_overlap(watch_occasion, F.array(*(F.lit(o) for o in wanted))), F.lit(False)), 0.35).otherwise(0.15) if wanted else F.lit(0.15)
    bonus = F.lit(0.1)
    bonus = F.when(kind.rlike("dress|minimal|analog|chronograph"), 0.22).otherwise(bonus) if set(wanted) & {"wedding", "bridal", "formal"} else bonus
    bonus = F.when(kind.rlike("minimal|sports|digital"), 0.2).otherwise(bonus) if "casual" in wanted else bonus
    return F.round(color_fit * 0.45 + occasion + bonus, 3)


def best_partner(left: DataFrame, right: DataFrame, key: str, partner: str, score: Column, by: tuple[list[str], list[str]], k: int = 1) -> DataFrame:
    """The k best rows of right for each row of left; ties by partner id. The score depends on the columns `by` (of left, of
    right) only, so classes of equal ones are scored, never pairs of rows: of each class of right its k first rows can be among
    the best. Classes are dealt in groups to as many tasks, each group of left's classes meets each of right's once, and left is
    joined by class: any number of classes is served, in time and shuffle by the product of both numbers."""
    mine, theirs = by
    cells = 16
    first = right.withColumn("_k", F.row_number().over(Window.partitionBy(*theirs).orderBy(partner))).where(F.col("_k") <= k).select(partner, *theirs)
    every = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    lefts = left.select(*mine).distinct().withColumn("_l", F.pmod(F.xxhash64(*mine), F.lit(cells)).cast("int")).withColumn("_r", every)
    rights = first.withColumn("_r", F.pmod(F.xxhash64(*theirs), F.lit(cells)).cast("int")).withColumn("_l", every)
    best_of = lambda *also: Window.partitionBy(*mine, *also).orderBy(F.desc("score"), partner)
    scored = lefts.join(rights, ["_l", "_r"]).withColumn("score", score)
    some = scored.withColumn("rank", F.row_number().over(best_of("_l", "_r"))).where(F.col("rank") <= k)  # k for each class and cell
    best = some.withColumn("rank", F.row_number().over(best_of())).where(F.col("rank") <= k).drop("_l", "_r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in mine]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return left.alias("l").join(best.alias("b"), on).select("l.*", *(f"b.{c}" for c in [partner, *theirs, "score", "rank"]))


def greedy_unique(scored: DataFrame, group: str, left: str, right: str, score: str) -> DataFrame:
    """Within each group (a request), every left in order takes the best right that is still free; ties by right. What has been taken is
    the state of a group: one id for each left at most."""

    def step(state: tuple[object, set], row: tuple) -> tuple[tuple[object, set], tuple]:
        served, taken = state
        mine, theirs = row
        if mine == served or theirs in taken:
            return state, (False,)
        taken.add(theirs)
        return (mine, taken), (True,)

    rows = scored.select(group, left, right, F.col(score).cast("double").alias(score))
    picked = fold(rows, [group], [left, F.desc(score), right], [left, right], "_taken boolean", lambda: (None, set()), step)
    return picked.where("_taken").drop("_taken")


def diverse(sorted_items: Column, cap: int) -> Column:
    """Of an array of structs in rank order with a `kind`: the first two, then only kinds not picked yet, up to cap."""

    def add(acc: Column, x: Column) -> Column:
        fresh = (F.size(acc) < 2) | ~F.exists(acc, lambda y: y["kind"] == x["kind"])
        return F.when((F.size(acc) < cap) & fresh, F.concat(acc, F.array(x))).otherwise(acc)

    return F.aggregate(sorted_items, F.slice(sorted_items, 1, 0), add)


def complete(df: DataFrame, hero: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """(hero_id, key, score, rank): pieces that go with each hero row: in stock, of its gender or unisex, another id, at most 1.4 times
    its price; the best by colour, ties by id. Of each gender and colour only rows that can be among the first under some price
    limit are paired with heroes: a few hundred a hero, whatever the size of df."""
    h = hero.select(F.col(key).alias("hero_id"), F.explode(F.array("gender", F.lit("unisex"))).alias("gender"), F.col("price").alias("hero_price"), F.col("primary_color").alias("hero_color")).distinct()
    shelf = F.to_json(F.struct("gender", "primary_color"))
    pool = df.where(~F.col("in_stock").eqNullSafe(F.lit(False))).where("price is not null").select(shelf.alias("_shelf"), F.col(key), "price")
    few = first_under_any_price(pool, "_shelf", key, "price", limit + 1)
    shown = few.withColumns({"gender": F.get_json_object("_shelf", "$.gender"), "primary_color": F.get_json_object("_shelf", "$.primary_color")}).drop("_shelf")
    pairs = shown.join(h, "gender").where((F.col(key) != F.col("hero_id")) & (F.col("price") <= 1.4 * F.col("hero_price")))
    w = Window.partitionBy("hero_id").orderBy(F.desc("score"), key)
    scored = pairs.withColumn("score", F.round(color.compatibility("hero_color", "primary_color"), 3))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("hero_id", key, "score", "rank")
