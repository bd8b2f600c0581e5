"""Shoes, jewelry and watches on their own, and to go with an outfit: searches, pools and picks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .filters import in_stock
from .recommend import diverse, jewelry_score, watch_score

#: Shoe types by the words that ask for them; the first line with a word in the wish counts.
SHOES = [
    (["heel", "heels", "stiletto", "stilettos", "court"], ["heel", "stiletto", "block-heel", "court-shoe", "pump"]),
    (["pump", "pumps"], ["pump", "court-shoe", "heel"]),
    (["wedge", "wedges"], ["wedge", "platform"]),
    (["sandal", "sandals"], ["sandal", "slide"]),
    (["khussa", "khussay", "kolhapuri", "peshawari", "kohati"], ["khussa", "kolhapuri", "peshawari", "kohati"]),
    (["sneaker", "sneakers", "jogger", "joggers", "trainer", "running", "athletic"], ["sneaker", "trainer", "jogger", "running"]),
    (["flat", "flats", "ballet", "ballerina", "loafer", "loafers", "moccasin"], ["flat", "ballet-flat", "loafer", "moccasin", "espadrille"]),
    (["mule", "mules", "back open", "back-open"], ["mule"]),
    (["slipper", "slippers", "chappal", "chappals"], ["slipper", "chappal", "flip-flop"]),
    (["boot", "boots", "ankle boot", "chelsea"], ["boot", "ankle-boot", "chelsea-boot", "long-boot", "combat"]),
]
#: The part of the body that a piece of jewelry is worn on.
JEWELRY = {"earring": "ear", "jhumka": "ear", "necklace": "neck", "choker": "neck", "ring": "hand", "bracelet": "wrist", "bangle": "wrist", "anklet": "wrist", "bridal": "bridal", "tikka": "head"}
#: How many rows a narrowed pool must have.
ENOUGH = {"shoes": 10, "jewelry": 8, "watches": 5}
FETCH, SHOWN = 100, 30
DEARER = 1.35
HEAVY = {"wedding", "bridal", "mehndi", "eid", "party"}


@dataclass(frozen=True)
class Wish:
    """What is looked for; None and empty mean no limit."""

    kind: str | None = None
    color: str | None = None
    families: tuple[str, ...] = ()
    occasion: tuple[str, ...] = ()
    gender: str | None = None
    max_budget: float = 0


def kind_filter(catalog: str, kind: str | None) -> Column | None:
    """Rows of the type that a word asks for: shoe types; jewelry by type or by where it is worn (`jewelry_category`); watch types."""
    if not kind:
        return None
    low = kind.lower()
    holds = lambda c: F.contains(F.lower(c), F.lit(low))
    if catalog == "shoes":
        types = next((t for words, t in SHOES if any(w in low for w in words)), None)
        return F.coalesce(F.col("shoe_type").isin(types), F.lit(False)) if types else None
    if catalog == "jewelry":
        place = next((p for word, p in JEWELRY.items() if word in low), None)
        return F.coalesce(holds("jewelry_type"), F.lit(False)) | F.coalesce(F.col("jewelry_category") == place, F.lit(False)) if place else None
    return F.coalesce(holds("watch_type"), F.lit(False))


def conditions(wish: Wish, catalog: str) -> tuple[Column, dict[str, Column]]:
    """What never changes (stock, gender, budget), and what may be given up: color, occasion, type."""
    hard = in_stock()
    if wish.gender and wish.gender != "unisex":
        hard = hard & F.col("gender").isin(wish.gender, "unisex")
    if wish.max_budget > 0:
        hard = hard & (F.col("price") <= wish.max_budget)
    soft = {}
    if wish.color and wish.color != "Any":
        soft["color"] = F.col("primary_color") == wish.color
    if wish.occasion:
        soft["occasion"] = F.arrays_overlap("occasion", F.array(*(F.lit(o) for o in wish.occasion))) | F.col("occasion").isNull() | (F.size("occasion") == 0)
    if (kind := kind_filter(catalog, wish.kind)) is not None:
        soft["type"] = kind
    return F.coalesce(hard, F.lit(False)), {k: F.coalesce(c, F.lit(False)) for k, c in soft.items()}


def points(wish: Wish) -> Column:
    """3 for the colour, 2 for an occasion, 1 for the budget."""
    out = F.lit(0)
    if wish.color and wish.color != "Any":
        out = out + F.when(F.col("primary_color").isin(*(wish.families or (wish.color,))), 3).otherwise(0)
    if wish.occasion:
        shared = F.exists(F.col("occasion"), lambda o: F.lower(o).isin([x.lower() for x in wish.occasion]))
        out = out + F.when(F.coalesce(shared, F.lit(False)), 2).otherwise(0)
    return out + F.when(F.col("price") <= wish.max_budget, 1).otherwise(0) if wish.max_budget > 0 else out


STEPS = [(), ("color",), ("color", "occasion"), ("color", "occasion", "type")]


def only(df: DataFrame, wish: Wish, catalog: str, key: str, fetch: int = FETCH, shown: int = SHOWN) -> DataFrame:
    """A search for accessories alone: of the first `fetch` rows by key that meet the tightest step of the ladder (colour goes first, then
    occasion, then type) the best by points, with `score`, `rank`, `step` and `relaxed`. Each row's first step is worked out in the one scan, and
    the least of these is the ladder's."""
    hard, soft = conditions(wish, catalog)
    meets = []
    for dropped in STEPS:
        c = F.lit(True)
        for name, test in soft.items():
            c = c if name in dropped else c & test
        meets.append(c)
    step = F.coalesce(*(F.when(c, F.lit(i)) for i, c in enumerate(meets)))
    first = Window.partitionBy("step").orderBy(key)
    few = df.where(hard).withColumn("step", step)
    # the first rows of each step by key; rows of tighter steps meet the looser ones, too, but there is none if a looser one is chosen
    ranked = few.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= fetch)  # at most 4 x fetch rows
    tightest = ranked.agg(F.min("step").alias("_least"))  # one row
    met = ranked.crossJoin(F.broadcast(tightest)).where(F.col("step") == F.col("_least"))
    by = Window.orderBy(F.desc("score"), key)  # of `fetch` rows
    label = F.create_map(F.lit(1), F.lit("colour"), F.lit(2), F.lit("occasion"), F.lit(3), F.lit(wish.kind or "type"))[F.col("step")]
    return met.withColumn("score", points(wish)).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= shown).withColumn("relaxed", label).drop("_n", "_least")


def pool(df: DataFrame, catalog: str, types: list[str], type_column: str, gender: str | None = None, max_budget: float = 0) -> DataFrame:
    """Accessories to choose from: in stock, of the gender or unisex, at most 1.35 times the budget, of the planned types; without enough of
    these, of all types. One scan: rows of the planned types are counted in it."""
    base = in_stock()
    if gender and gender != "unisex":
        base = base & F.col("gender").isin(gender, "unisex")
    if max_budget > 0:
        base = base & (F.col("price") <= round(max_budget * DEARER))
    rows = df.where(F.coalesce(base, F.lit(False)))
    if not types:
        return rows
    planned = F.coalesce(F.col(type_column).isin(types), F.lit(False))
    n = F.broadcast(rows.agg(F.count_if(planned).alias("_n")))  # one row
    return rows.crossJoin(n).where(planned | (F.col("_n") < ENOUGH[catalog])).drop("_n")


def focus_factor(kind: Column, focus: tuple[str, ...]) -> Column:
    """How much a wish for small or for striking jewelry counts."""
    t = F.lower(F.coalesce(kind, F.lit("")))
    small, large = "minimal_jewelry" in focus, "statement_jewelry" in focus
    if large and not small:
        return F.when(t.rlike("jhumka|chandbali|bridal-set|necklace|choker|nath|maang-tikka|jhoomar|passa|long-necklace"), 1.18).when(t.rlike("stud|pendant-chain"), 0.92).otherwise(1.0)
    if small and not large:
        return F.when(t.rlike("jhumka|chandbali|bridal-set|jhoomar"), 0.82).when(t.rlike("stud|hoop|pendant-chain|bracelet|ring|anklet"), 1.12).when(t.rlike("necklace|choker") & ~t.rlike("long-necklace"), 0.94).otherwise(1.0)
    return F.lit(1.0)


def set_size(occasions: tuple[str, ...], focus: tuple[str, ...], most: int = 5) -> int:
    small, large = "minimal_jewelry" in focus, "statement_jewelry" in focus
    n = most if HEAVY & {o.lower() for o in occasions} else min(3, most)
    n = max(n, min(6, most)) if large and not small else min(n, 2) if small and not large else n
    return max(1, min(6, n))


def _all_colors(primary: str, colors: str) -> Column:
    return F.array_compact(F.concat(F.array(primary), F.coalesce(F.col(colors), F.array().cast("array<string>"))))


def jewelry_sets(dresses: DataFrame, jewelry: DataFrame, key: str, item: str, occasions: tuple[str, ...], focus: tuple[str, ...] = (), most: int = 5) -> DataFrame:
    """(key, item, kind, score, place): the jewelry that goes with each dress, best first, ties by item: the first two, then only kinds that
    aren't there yet. The score reads colours, occasions and kind alone, so classes of dresses meet classes of jewelry, and of a class
    only the first two pieces can be picked."""
    cap = set_size(occasions, focus, most)
    mine = dresses.select(F.col(key).alias("_dress"), F.array_sort(F.array_distinct(_all_colors("primary_color", "colors"))).alias("dc"), F.array_sort(F.coalesce(F.transform("occasion", F.lower), F.array().cast("array<string>"))).alias("do"))
    theirs = jewelry.select(F.col(item).alias("_item"), F.coalesce("jewelry_type", F.lit("other")).alias("kind"), F.array_sort(F.array_distinct(_all_colors("primary_color", "colors"))).alias("jc"), F.array_sort(F.coalesce(F.transform("occasion", F.lower), F.array().cast("array<string>"))).alias("jo"))
    first = theirs.withColumn("_n", F.row_number().over(Window.partitionBy("kind", "jc", "jo").orderBy("_item"))).where("_n <= 2").drop("_n")
    classes = mine.select("dc", "do").distinct()
    base = jewelry_score(color.best_compatibility(F.col("dc"), F.col("jc")), F.col("do"), F.col("jo"), F.col("kind"), list(occasions))
    score = F.round(base * focus_factor(F.col("kind"), focus), 3)
    met = _meet(classes, ["dc", "do"], first, ["jc", "jo", "kind"]).withColumn("score", score)
    # of a class the two best of all and the best of each kind can be picked
    of = Window.partitionBy("dc", "do").orderBy(F.desc("score"), "_item")
    of_kind = Window.partitionBy("dc", "do", "kind").orderBy(F.desc("score"), "_item")
    near = met.withColumns({"k": F.row_number().over(of), "t": F.row_number().over(of_kind)}).where("k <= 2 or t <= 3")
    listed = F.array_sort(F.collect_list(F.struct("k", "kind", "score", "_item")))
    picked = near.groupBy("dc", "do").agg(diverse(listed, cap).alias("picked"))
    placed = picked.select("dc", "do", F.posexplode("picked").alias("at", "x"))
    return mine.join(placed, ["dc", "do"]).select(F.col("_dress").alias(key), F.col("x._item").alias(item), F.col("x.kind").alias("kind"), F.col("x.score").alias("score"), (F.col("at") + 1).alias("place"))


def watches(dresses: DataFrame, pool: DataFrame, key: str, item: str, occasions: tuple[str, ...]) -> DataFrame:
    """(key, item, score): the best watch for each dress, ties by item. Dial colour, else the watch's colour, else silver is compared with the
    dress's colour (unknown: several)."""
    wanted = [o.lower() for o in occasions]
    mine = dresses.select(F.col(key).alias("_dress"), F.coalesce("primary_color", F.lit("Multicolor")).alias("dc"))
    theirs = pool.select(F.col(item).alias("_item"), F.coalesce("dial_color", "primary_color", F.lit("Silver")).alias("wc"), F.coalesce("watch_type", F.lit("")).alias("kind"), F.array_sort(F.coalesce(F.transform("occasion", F.lower), F.array().cast("array<string>"))).alias("wo"))
    first = theirs.groupBy("wc", "kind", "wo").agg(F.min("_item").alias("_item"))
    score = watch_score(color.compatibility("dc", "wc"), F.col("wo"), F.col("kind"), wanted)
    met = _meet(mine.select("dc").distinct(), ["dc"], first, ["wc", "kind", "wo"]).withColumn("score", score)
    best = met.withColumn("k", F.row_number().over(Window.partitionBy("dc").orderBy(F.desc("score"), "_item"))).where("k = 1")
    return mine.join(best, "dc").select(F.col("_dress").alias(key), F.col("_item").alias(item), "score")


def _meet(left: DataFrame, left_by: list[str], right: DataFrame, right_by: list[str], cells: int = 16) -> DataFrame:
    """Every class of left with every row of right, dealt to cells x cells tasks: each side goes to the cells of its row or column."""
    every = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    cell = lambda by: F.pmod(F.xxhash64(*by), F.lit(cells)).cast("int")
    return left.withColumn("_l", cell(left_by)).withColumn("_r", every).join(right.withColumn("_r", cell(right_by)).withColumn("_l", every), ["_l", "_r"]).drop("_l", "_r")
