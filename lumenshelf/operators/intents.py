"""Loosely typed requests as rows: what a model made of a message (JSON), checked against the message, becomes a typed intent.

Nothing is taken on trust: values outside the known ones are dropped, a gender other than women needs a word for it in the message, and
the priority comes from the caller's hint, else from the model's order, else from what the request has. All of it is expressions over
VARIANT, so broken JSON gives an intent without constraints and no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from .requests import priority_of

#: Names of catalogs as requests give them, and the words of messages that tell one.
CATALOGS = {"clothing": "clothing", "shoes": "shoes", "jewelry": "jewelry", "watches": "watches", "jewellery": "jewelry", "watch": "watches", "shoe": "shoes"}
GARMENT = r"\b(suit|dress|kurta|lehenga|saree|sari|outfit|gown|frock|maxi|shalwar|kameez|dupatta|unstitched|3-piece|2-piece|2 piece|3 piece|co-ord|coord|abaya|ladies suit|mens wear|bridal wear)\b"
CUES = {
    "shoes": r"\b(shoe|shoes|footwear|sneaker|sneakers|khussa|khussas|sandal|sandals|chappal|heel|heels|pump|pumps|boot|boots|loafer|loafers|mule|mules|kolhapuri|peshawari|trainer|trainers|jogger|joggers)\b",
    "jewelry": r"\b(jewelry|jewellery|jewelery|earring|earrings|necklace|bracelet|jhumka|bangle|bangles|ring|rings|nath|tikka|maang-tikka|choker|pendant|mala|bridal set|jewelry set|payal|anklet)\b",
    "watches": r"\b(watch|watches|smartwatch|smart watch|timepiece)\b",
}
#: Words of messages that ask for men's or children's things.
FOR_MEN = r"(?i)\b(men'?s|mens\b|for\s+(?:my\s+)?(?:husband|brother|dad|father|boyfriend|son)|menswear|for\s+him)\b"
FOR_KIDS = r"(?i)\b(kids?|children|toddler|for\s+my\s+(?:son|daughter)|baby\s+boy|baby\s+girl|boys?'?s|girls?'?s)\b"
#: Words of a hint that name a constraint, in the order in which they count.
HINTS = [
    ("occasion", "occasion|event|function|wedding|party"), ("color", "color|colour|shade|tone"), ("dress_style", "dress|style|silhouette|type|kurta|lehenga|saree"), ("print", "print|embroid|pattern|work"),
    ("season", "season|summer|winter"), ("fabric", "fabric|material|lawn|silk|cotton"), ("pieces", "piece|2-piece|3-piece|unstitched"), ("stitching", "stitched|stitching"),
]
#: Constraints as models name them.
KEYS = {"neckline": "neckline", "occasion": "occasion", "print": "print", "dressstyle": "dress_style", "stitching": "stitching", "pieces": "pieces", "fabric": "fabric", "season": "season", "color": "color"}
#: Styles that a piece's name tells, the first that fits.
STYLES = [("lehenga", "lehenga"), ("saree|sari", "saree"), ("maxi|gown", "maxi"), ("kurta|kameez", "kurta"), ("shalwar", "shalwar-kameez")]
CANONICAL = ["Black", "White", "Grey", "Red", "Pink", "Purple", "Blue", "Green", "Teal", "Yellow", "Orange", "Gold", "Beige", "Brown", "Multicolor"]


def _look_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def catalog_of(message: Column, given: Column) -> Column:
    """The given catalog; else the only one whose words a message without a garment has; else clothing."""
    low = F.lower(F.coalesce(message, F.lit("")))
    cues = F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(c)) for c, p in CUES.items())))
    told = F.when(~low.rlike(GARMENT) & (F.size(cues) == 1), cues[0])
    return F.coalesce(_look_up(CATALOGS, F.lower(F.trim(given))), told, F.lit("clothing"))


def gender_of(message: Column, given: Column) -> Column:
    text = F.coalesce(message, F.lit(""))
    return F.when(given == "unisex", "unisex").when((given == "men") & text.rlike(FOR_MEN), "men").when((given == "kids") & text.rlike(FOR_KIDS), "kids").otherwise("women")


def hinted(hint: Column) -> Column:
    low = F.lower(F.coalesce(hint, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(k)) for k, p in HINTS)))


def intents(df: DataFrame, raw: str = "raw", message: str = "message", hint: str | None = None) -> DataFrame:
    """All other columns, with search_catalog, color, shade, occasion, style, piece, pieces, fabric, stitching, print, gender, dress_style,
    accessory_type, max_budget, season, priority and summary. raw: JSON with the keys that models use (searchCatalog, dressStyle,
    maxBudget, constraintPriority, ...)."""
    v = F.try_parse_json(F.col(raw))
    none = F.array().cast("array<string>")
    text = lambda k: F.nullif(F.nullif(F.lower(F.trim(F.try_variant_get(v, f"$.{k}", "string"))), F.lit("null")), F.lit(""))
    listed = lambda k: F.try_variant_get(v, f"$.{k}", "array<string>")
    kind_of = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    number = lambda k: F.when(kind_of(k).rlike("BIGINT|DECIMAL|DOUBLE|FLOAT|INT"), F.try_variant_get(v, f"$.{k}", "double"))
    one_of = lambda c, *known: F.when(c.isin(*known), c)

    shade = F.nullif(text("shade"), F.lit("any"))
    named = F.trim(F.coalesce(F.try_variant_get(v, "$.color", "string"), F.lit("Any")))
    inside = F.coalesce(*(F.when(F.contains(F.lower(named), F.lit(c.lower())), F.lit(c)) for c in CANONICAL))
    of_shade = color.canonical(shade)
    tone = F.coalesce(F.when(of_shade.isin(CANONICAL), of_shade), F.when(named.isin(CANONICAL), named), inside, F.lit("Any"))
    piece = text("piece")
    from_piece = F.coalesce(*(F.when(piece.rlike(p), F.lit(s)) for p, s in STYLES))
    # the style as it is given, for the priority; what a piece tells is added to the intent alone
    style = F.nullif(text("dressStyle"), F.lit("other"))
    pieces = F.when(number("pieces").between(1, 4) & (number("pieces") == F.floor(number("pieces"))), number("pieces").cast("int"))
    keys = F.filter(F.transform(F.coalesce(listed("constraintPriority"), none), lambda x: _look_up(KEYS, F.lower(F.trim(x)))), lambda x: x.isNotNull())
    made = {
        "search_catalog": catalog_of(F.col(message), F.coalesce(text("searchCatalog"), text("catalogFocus"))),
        "color": tone, "shade": shade, "occasion": F.coalesce(listed("occasion"), F.array(F.lit("casual"))), "style": F.coalesce(listed("style"), none), "piece": piece, "pieces": pieces,
        "fabric": text("fabric"), "stitching": text("stitching"), "print": one_of(text("print"), "embroidered", "printed", "plain", "mixed"), "gender": gender_of(F.col(message), F.try_variant_get(v, "$.gender", "string")),
        "_style": style, "dress_style": F.coalesce(style, from_piece), "accessory_type": text("accessoryType"), "max_budget": F.coalesce(number("maxBudget"), F.lit(0.0)),
        "season": one_of(text("season"), "summer", "winter", "all-season"), "summary": F.coalesce(F.nullif(F.try_variant_get(v, "$.intentSummary", "string"), F.lit("")), F.col(message)),
        "_order": F.array_distinct(keys), "_hint": hinted(F.col(hint)) if hint else none,
    }
    rest = [c for c in df.columns if c not in made and c != "priority"]
    out = df.select(*rest, *(c.alias(name) for name, c in made.items()))
    has = {"occasion": F.size("occasion") > 0, "color": (F.col("color") != "Any") | F.col("shade").isNotNull(), "dress_style": F.col("_style").isNotNull(), **{c: F.col(c).isNotNull() for c in ("pieces", "stitching", "fabric", "print", "season")}}
    given = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in has.items())))
    priority = F.when(F.size("_hint") > 0, F.array_distinct(F.concat("_hint", "_order"))).when(F.size("_order") > 0, F.col("_order")).otherwise(priority_of(given, F.col("occasion")))
    return out.withColumn("priority", priority).drop("_style", "_order", "_hint")
