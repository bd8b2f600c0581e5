"""Requests: what a query or a message says, and scores of products against it."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, rules
from ..functions.text import textual_match
from .filters import Intent
from .folds import fold
from .recommend import RELAX

#: Garments by keyword in queries.
GARMENTS: rules.Rules = [
    ("saree", "saree|sari"), ("lehenga", "lehenga|lehnga"), ("kurta", "kurta|kurti|kameez|shalwar|salwar|sharara|gharara"), ("palazzo", "palazzo"), ("abaya", "abaya"), ("frock", "maxi|gown|frock"), ("sherwani", "sherwani"), ("polo", "polo"),
    ("t-shirt", "t-shirt|t shirt|tee"), ("western", "western wear|western|jeans|denim|hoodie|pantsuit|blazer|jumpsuit|playsuit"), ("co-ord", "co-ord|coord|co ord"),
]
#: Nouns of the other catalogs.
NOUNS = {
    "jewelry": "earring earrings jhumka jhumki jhumkay chandbali necklace choker pendant bangle bangles bracelet kada ring rings tikka maang jhoomar nath anklet payal brooch mala jewelry jewellery studs",
    "shoes": "shoe shoes heel heels sandal sandals khussa khussay kolhapuri sneaker sneakers boot boots loafer loafers flats slipper slippers wedge wedges pump pumps footwear chappal mules",
    "watches": "watch watches smartwatch wristwatch chronograph",
}


def signals(queries: DataFrame, text: str = "query") -> DataFrame:
    """All columns, with colors, shades, occasions, garments, gender_hint, catalog_hints, strong and semantic_text."""
    q = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    tone = color.infer(q)
    explicit = F.col("_tone.primary_shade") != "multicolor"
    hints = F.array_compact(F.array(*(F.when(q.rlike(rf"(^|[^a-z])({words.replace(' ', '|')})($|[^a-z])"), F.lit(c)) for c, words in NOUNS.items())))
    who = F.when(q.rlike(r"\b(kids|children|child|junior|toddler|baby)\b"), "kids").when(q.rlike(r"\bunisex\b"), "unisex").when(q.rlike(r"\b(women|womens|ladies|female|girls?)\b"), "women").when(q.rlike(r"\b(men|mens|gents|male|boys?)\b"), "men")
    out = queries.withColumn("_tone", tone).withColumns({
        "colors": F.when(explicit, F.col("_tone.colors")).otherwise(F.array().cast("array<string>")),
        "shades": F.when(explicit, F.col("_tone.shades")).otherwise(F.array().cast("array<string>")),
        "occasions": rules.all_matches(q, rules.OCCASION),
        "garments": rules.all_matches(q, GARMENTS),
        "gender_hint": who,
        "catalog_hints": hints,
    })
    line = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", ")))
    text_of = F.concat_ws("\n", F.trim(F.col(text)), line("Occasion", F.col("occasions")), line("Color family", F.col("colors")), line("Color keywords", F.col("shades")), line("Garment", F.col("garments")), F.when(F.col("gender_hint").isNotNull(), F.concat(F.lit("Gender: "), "gender_hint")), line("Catalog", F.col("catalog_hints")))
    return out.withColumns({"strong": (F.size("colors") > 0) & (F.size("occasions") > 0), "semantic_text": text_of}).drop("_tone")


@dataclass(frozen=True)
class Wish:
    """What an intent says for scoring: a colour family or shade, budget, piece, occasions, styles."""

    color: str | None = None
    shade: str | None = None
    budget: float = 0
    piece: str | None = None
    occasion: tuple[str, ...] = ()
    style: tuple[str, ...] = ()
    bridal: bool = False
    summary: str = ""


def intent_score(w: Wish, similarity: Column | None = None) -> Column:
    """Colour 0.28, likeness 0.22, price 0.12 (if there is a budget), piece 0.10 (0.05 if none is asked for) and bonuses for occasion
    and style; at most 3. similarity: of vectors; without it, of words."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    primary, colors = F.col("primary_color"), F.coalesce(F.col("colors"), F.array().cast("array<string>"))
    tone = F.lit(0.4)
    if w.color:
        tone = F.lit(0.08)
        wanted = F.lit(w.shade or "")
        shade = color.canonical(wanted)
        if w.shade:
            tone = F.when(F.exists(colors, lambda c: (color.canonical(c) == shade) | (color.canonical(c) == color.canonical(F.lit(w.color)))), 0.78).otherwise(tone)
        tone = F.when(low(primary) == w.color.lower(), 1.0).otherwise(tone)
        if w.shade:
            tone = F.when(low(primary) == w.shade.lower(), 1.0).when(F.exists(colors, lambda c: F.lower(c) == w.shade.lower()), 0.93).when(color.canonical(primary) == shade, 0.85).otherwise(tone)
    text = F.concat_ws(" ", "name", "description", F.array_join(F.coalesce(F.col("occasion"), F.array().cast("array<string>")), " "))
    like = F.round(similarity, 4) if similarity is not None else textual_match(text, F.lit(w.summary))
    total = tone * 0.28 + like * 0.22
    has = F.coalesce(F.col("occasion"), F.array().cast("array<string>"))
    if w.occasion:
        hits = F.size(F.filter(F.array(*(F.lit(o.lower()) for o in w.occasion)), lambda o: F.exists(has, lambda x: F.lower(x) == o)))
        total = total + F.when(hits > 0, 0.4 + 0.05 * hits).otherwise(0.0)
    if w.bridal:
        total = total + F.when((F.col("sub_category") == "bridal") | F.array_contains(has, "wedding"), 0.45).otherwise(0.0)
    if w.budget > 0:
        price = F.when(F.col("price") <= w.budget, 1.0).otherwise(F.greatest(F.lit(0.0), F.round(1 - (F.col("price") - w.budget) / w.budget * 2, 4)))
        total = total + price * 0.12
    if w.piece:
        sub = low(F.col("sub_category"))
        fit = F.when(sub.startswith("unstitched"), 1.0).otherwise(0.25) if "unstitched" in w.piece else F.when(F.contains(sub, F.lit("3-piece")), 1.0).otherwise(0.3) if "3-piece" in w.piece else F.lit(0.5)
        total = total + fit * 0.1
    else:
        total = total + 0.05
    return F.round(F.least(F.lit(3.0), total), 4)


#: Words by which feedback names a constraint, and words that let it go.
NAMED = {
    "dress_style": ["dress style", "dress-style", "dressstyle", "silhouette", "saree", "sari", "lehenga", "kurta", "kurti", "shalwar", "kameez", "gown", "maxi", "frock", "abaya", "western", "co-ord", "coord", "sherwani"],
    "color": ["color", "colour", "shade", "tone"],
    "occasion": ["occasion", "event", "function", "wedding", "bridal", "party", "eid", "mehndi", "office", "casual"],
    "neckline": ["neckline", "neck"],
    "print": ["print", "printed", "embroidery", "embroidered", "pattern", "work"],
    "fabric": ["fabric", "material", "lawn", "silk", "cotton", "chiffon", "velvet", "khaddar"],
    "pieces": ["piece", "pieces", "2-piece", "3-piece"],
    "stitching": ["stitch", "stitched", "stitching", "unstitched"],
    "season": ["season", "summer", "winter"],
}
LET_GO = ["can change", "can be changed", "can changed", "can be change", "flexible", "don't care", "dont care", "doesn't matter", "doesnt matter", "no preference", "open to", "any", "anything", "whatever"]
#: Occasions that count before colour, and the order of what a request gives.
FORMAL = ["wedding", "bridal", "mehndi", "eid", "party", "formal"]
ORDER = ["occasion", "color", "dress_style", "pieces", "fabric", "print", "season", "stitching"]
FORMAL_ORDER = ["occasion", "dress_style", "color", "pieces", "fabric", "print", "season", "stitching"]


def _words_of(text: Column, table: dict[str, list[str]]) -> Column:
    """The names whose words the text has."""
    return F.array_compact(F.array(*(F.when(text.rlike(r"\b(" + "|".join(map(re.escape, words)) + r")\b"), F.lit(name)) for name, words in table.items())))


def priority_of(given: Column, occasions: Column) -> Column:
    """given: array of the constraints that a request has. They in order of weight: occasion first for formal ones, colour first
    else; for a request without any the three most telling."""
    none = F.array().cast("array<string>")
    rank = lambda order: F.filter(F.array(*(F.lit(x) for x in order)), lambda x: F.array_contains(given, x))
    formal = F.arrays_overlap(F.coalesce(F.transform(occasions, F.lower), none), F.array(*(F.lit(x) for x in FORMAL)))
    informal = ["color", "occasion", *ORDER[2:]]
    got = F.when(formal, rank(FORMAL_ORDER)).otherwise(rank(informal))
    return F.when(F.size(got) > 0, got).otherwise(F.array(*(F.lit(x) for x in ORDER[:3])))


def reprioritize(df: DataFrame, feedback: str = "feedback", priority: str = "priority") -> DataFrame:
    """All columns, with `priority` as the feedback leaves it: of each clause, what it insists on comes first, what may change
    last. Null feedback changes nothing."""
    clauses = F.split(F.lower(F.coalesce(F.col(feedback), F.lit(""))), r"[,.;]+|\bbut\b|\bhowever\b")
    said = F.transform(clauses, lambda c: F.struct((F.size(_words_of(c, {"free": LET_GO})) > 0).alias("free"), _words_of(c, NAMED).alias("names")))
    of = lambda free: F.array_distinct(F.flatten(F.transform(F.filter(said, lambda x: x["free"] == F.lit(free)), lambda x: x["names"])))
    keep, free = of(False), of(True)
    rest = F.array_except(F.array_except(F.col(priority), keep), free)
    return df.withColumn(priority, F.concat(keep, rest, F.array_except(free, keep)))


def to_intent(raw: dict) -> Intent:
    """A loosely typed request -> an intent: unknown keys are dropped, numbers and lists are cleaned, kids and men never become
    women."""
    text = lambda k: str(raw[k]).strip().lower() or None if raw.get(k) not in (None, "", "any", "Any") else None
    many = lambda k: tuple(dict.fromkeys(str(x).strip().lower() for x in (raw.get(k) or []) if str(x).strip())) if isinstance(raw.get(k), (list, tuple)) else ()
    number = lambda k: float(m[0]) if (m := re.search(r"\d+(\.\d+)?", str(raw.get(k) or "").replace(",", ""))) else 0.0
    gender = text("gender")
    if re.search(r"\b(kids?|boys?|girls?|child(ren)?)\b", str(raw.get("message") or ""), re.I):
        gender = "kids"
    pieces = int(number("pieces"))
    families = tuple(str(c).strip().capitalize() for c in (raw.get("color_families") or ([raw["color"]] if raw.get("color") not in (None, "", "Any") else [])))
    made = Intent(
        occasion=many("occasion"), print=text("print"), dress_style=text("dress_style"), stitching=text("stitching"), pieces=pieces if 1 <= pieces <= 4 else None, fabric=text("fabric"), neckline=text("neckline"),
        season=text("season"), color_exact=text("shade"), color_families=families, gender=gender if gender in ("women", "men", "kids", "unisex") else None, max_budget=number("budget"),
    )
    return replace(made, priority=tuple(p for p in many("priority") if p in RELAX))


def grounded(answers: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """Only the answers that a tool has returned."""
    return answers.join(returned.select(key).distinct(), key, "left_semi")


def quota(hits: DataFrame, caller: str, time: str = "ts", window_seconds: int = 3600, limit: int = 10) -> DataFrame:
    """`n` of each hit within its caller's window, and `allowed`. A window begins with the first hit after the last one has ended. The
    state of a caller is two numbers; hits of one time count in the order of their other columns."""

    def step(state: tuple[float, int], row: tuple) -> tuple[tuple[float, int], tuple]:
        start, n = state
        start, n = (row[0], 1) if row[0] >= start + window_seconds * 1_000_000 else (start, n + 1)
        return (start, n), (n, n <= limit)

    timed = hits.withColumn("_us", F.unix_micros(time))
    return fold(timed, [caller], ["_us", F.xxhash64(*hits.columns)], ["_us"], "n int, allowed boolean", lambda: (float("-inf"), 0), step).drop("_us")


def client_view(df: DataFrame) -> DataFrame:
    """What clients see: print for pattern, semi-stitched as stitched, the piece count from its type where it is missing."""
    p = F.lower("pattern")
    shown = F.when(p.isin("embroidered", "embellished", "mixed"), "embroidered").when(p.isin("plain", "textured"), "plain").when(p.isin("printed", "digital-print", "floral", "geometric"), "printed").when(p.isNotNull(), "mixed")
    count = F.regexp_extract("piece_type", r"^([1-4])-piece$", 1).try_cast("int")
    return df.withColumns({"print": shown, "stitching": F.when(F.col("stitching") == "semi-stitched", "stitched").otherwise(F.col("stitching")), "pieces": F.coalesce(F.col("pieces"), count)})


def compact(df: DataFrame) -> DataFrame:
    """The few columns an agent needs."""
    keep = [c for c in ("id", "name", "brand", "price", "primary_color", "dress_style", "gender", "product_url", "image_url") if c in df.columns]
    return df.select(*keep, F.slice("occasion", 1, 4).alias("occasion"))


def embedding_text(labels: dict[str, str | Column], rest: list[str | Column]) -> Column:
    """Labelled lines, then values; blank ones are left out. Array columns are joined."""
    cell = lambda c: F.when(F.trim(F.col(c) if isinstance(c, str) else c) != "", F.trim(F.col(c) if isinstance(c, str) else c))
    lines = [F.concat(F.lit(f"{k}: "), cell(c)) for k, c in labels.items()]
    return F.concat_ws("\n", *lines, *(cell(c) for c in rest))


def lexical_alignment(rules_of: dict[str, dict[str, list[str]]], text: Column) -> Column:
    """Share of the given fields (column -> value -> words) whose words the text has; 1 if none applies."""
    checks, hits = F.lit(0), F.lit(0)
    for field, words in rules_of.items():
        for value, ws in words.items():
            applies = F.coalesce(F.lower(F.col(field)) == value, F.lit(False))
            checks = checks + applies.cast("int")
            hits = hits + (applies & F.lower(text).rlike("|".join(map(re.escape, ws)))).cast("int")
    return F.round(F.when(checks == 0, 1.0).otherwise(hits / checks), 2)
