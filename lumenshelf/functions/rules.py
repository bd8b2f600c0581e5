"""Rule tables for product attributes, compiled to columns.

Keywords match whole words by default; `compat=True` matches them anywhere in the text, also inside other words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

Rules = list[tuple[str, str]]  # value, keywords separated by |

#: Keyword rules, in order.
OCCASION: Rules = [
    ("wedding", "wedding|bridal|nikah|barat|valima|shaadi|nikkah|walima"), ("eid", "eid|eid collection|eid wear|eid-wear|eidwear"), ("eid", "festive|celebration|festive wear"),
    ("party", "luxury|couture|occasion wear|evening wear|party wear"), ("party", "party|evening|cocktail|reception|gala"), ("formal", "formal|semi-formal|semi formal|black tie|gala dinner"),
    ("office", "office|work|professional|corporate|9to5|9 to 5|office wear"), ("casual", "casual|everyday|daily wear|daily|lounge|basics|essentials|simple"),
    ("mehndi", "mehndi|haldi|mayun"), ("casual", "lawn|summer|pret"), ("casual", "winter|khaddar|karandi"),
]
STYLE: Rules = [
    ("embroidered", "embroidered|embellished|zardozi|gota|tilla|stone work|chikankari"), ("printed", "printed|digital print|screen print"), ("minimal", "minimal|solid|plain|basic"),
    ("trendy", "trendy|contemporary|modern"), ("elegant", "elegant|luxury|luxe|premium|couture"), ("traditional", "traditional|cultural|ethnic|desi"), ("western", "western|jeans|denim|hoodie"), ("heavy", "heavy|bridal|handwork|sequin"),
]
PATTERN: Rules = [
    ("embroidered", "embroidered|embellished|zardozi|tilla|gota|handwork|chikankari|cutwork|thread work"), ("floral", "floral print|floral"), ("geometric", "geometric|checks|stripes|stripe|checkered|tartan"),
    ("digital-print", "digital print|screen print|block print|resist print"), ("printed", "printed"), ("textured", "textured|jacquard|brocade"), ("embellished", "sequin|stone work|mirror work|embellished"), ("plain", "plain|solid|self|minimal|basic"),
]
SEASON: Rules = [("summer", "summer|lawn|cotton|voile|chiffon|georgette"), ("winter", "winter|khaddar|karandi|linen|wool|velvet|fleece|tweed")]
TREND: Rules = [
    ("minimalist", "minimal|solid|plain|basic|simple"), ("luxury", "luxury|couture|premium|haute|luxe|signature"), ("festive", "festive|eid|wedding|bridal|mehndi|celebration"),
    ("traditional", "traditional|ethnic|desi|cultural|khaddar|karandi"), ("modern", "modern|contemporary|trendy|western|fusion|co-ord"),
]
SLEEVE: Rules = [("sleeveless", "sleeveless|without sleeves|no sleeve"), ("half-sleeve", "half sleeve|short sleeve|half-sleeve"), ("three-quarter", "three quarter|3/4 sleeve|3/4th sleeve"), ("cap-sleeve", "cap sleeve|flutter sleeve"), ("full-sleeve", "full sleeve|long sleeve|full-sleeve")]
NECKLINE: Rules = [
    ("v-neck", "v-neck|v neck|vneck"), ("boat-neck", "boat neck|bateau|boat-neck"), ("collar", "collar|collared|shirt collar"), ("keyhole", "keyhole|cut out neckline"), ("halter", "halter|halter neck"),
    ("square", "square neck|square neckline"), ("off-shoulder", "off shoulder|off-shoulder"), ("round", "round neck|round neckline"),
]
FIT: Rules = [("slim", "slim fit|fitted|body con|bodycon|pencil"), ("loose", "loose fit|oversized|relaxed|boxy"), ("flared", "flared|a-line|a line|bell"), ("straight", "straight fit|straight cut")]
FASHION: Rules = [("western", "western wear|jeans|denim|t-shirt|tshirt|hoodie|sweatshirt|co-ord|jogger|blazer|jumpsuit"), ("fusion", "fusion|indo-western|indo western|boho")]
SUBCATEGORY: Rules = [
    ("4-piece", "4-piece|four piece|4 piece|4pc|4-pc"), ("3-piece", "3-piece|3piece|three-piece|3 piece|3pc|3-pc|shirt trouser dupatta|shirt & trouser & dupatta"),
    ("2-piece", "2-piece|2piece|two-piece|2 piece|2pc|2-pc|shirt & trouser|shirt and trouser|shirt trouser"), ("kurta", "kurti|kameez|1-piece|one piece|1 piece|shirt only|1pc"),
    ("pants", "trousers only|bottoms only|palazzo only|cigarette pant|pant only"), ("shalwar", "shalwar only|salwar only"), ("dupatta", "dupatta only|stole only|shawl only"),
    ("unstitched-3-piece", "unstitched 3-piece|un-stitched 3 piece|unstitched three piece|unstitched 3 piece|unstitched 3pc"), ("unstitched-2-piece", "unstitched 2-piece|un-stitched 2 piece|unstitched 2 piece|unstitched 2pc"),
    ("unstitched-1-piece", "unstitched 1-piece|unstitched shirt only|unstitched 1 piece"),
    ("western", "western wear|jeans|denim|hoodie|sweatshirt|t-shirt|tshirt"), ("co-ord", "co-ord|coord set|co ord|coordinated set|matching set|two piece set|2 piece set"),
    ("bridal", "bridal couture|bridal collection|bridal wear|wedding dress|bride"), ("festive", "wedding wear|luxury formal|heavy embroidered|chikankari formal|festive wear"),
]
#: Dress styles that a title is trusted for.
TITLE_STYLES: Rules = [
    ("saree", "saree|sari"), ("lehenga", "lehenga|lehnga|lehenga choli|sharara|gharara"), ("abaya", "abaya"), ("gown", "floor length gown|evening gown|gown"), ("maxi", "maxi dress|maxi frock|maxi gown|maxi"),
    ("frock", "frock|a-line frock"), ("palazzo", "palazzo"),
]
#: Sub-category -> piece type, stitching, garments, dress style.
COMPOSITION = {
    "2-piece": ("2-piece", "stitched", "shirt trouser", "shalwar-kameez"), "3-piece": ("3-piece", "stitched", "shirt trouser dupatta", "shalwar-kameez"), "4-piece": ("4-piece", "stitched", "shirt trouser dupatta inner", "shalwar-kameez"),
    "kurta": ("1-piece", "stitched", "shirt", "kurta"), "pants": ("1-piece", "stitched", "trouser", "trouser"), "shalwar": ("1-piece", "stitched", "shalwar", "trouser"), "dupatta": ("1-piece", "stitched", "dupatta", "other"),
    "unstitched-1-piece": ("1-piece", "unstitched", "shirt", "shalwar-kameez"), "unstitched-2-piece": ("2-piece", "unstitched", "shirt trouser", "shalwar-kameez"), "unstitched-3-piece": ("3-piece", "unstitched", "shirt trouser dupatta", "shalwar-kameez"),
    "co-ord": ("2-piece", "stitched", "top bottom", "co-ord"), "western": ("1-piece", "stitched", "top", "western"), "festive": ("3-piece", None, "shirt trouser dupatta", "shalwar-kameez"), "bridal": ("3-piece", "stitched", "shirt trouser dupatta", "lehenga"),
}
#: Words that mark listings which aren't clothing.
NOT_CLOTHING = (
    "bedsheet|bed sheet|bedding|quilt|cushion|pillow|duvet|towel|rug|home decor|throw blanket|fleece throw|single ply fleece|blanket|wallet|handbag|tote bag|shoulder bag|crossbody|"
    "clutch bag|backpack|satchel|phone case|sunglasses|necklace|earring|bracelet|ring|phone cover|belts| belt |perfume|fragrance|cologne|eau de toilette|body mist|deodorant|"
    "pumps ifs|loafers ifs|sneakers ifs|boots ifs|throw pillow|table cloth|curtain"
).split("|")
#: Garment words by group, in order.
GARMENTS = [
    ("shirt", r"\b(shirt|kameez|kurta|kurti|angrakha|frock|tunic|top|abaya|gown)s?\b"), ("blouse", r"\b(bustier|choli|blouse)s?\b"),
    ("trouser", r"\b(trouser|pant|culotte|shalwar|salwar|pajama|pyjama|bottom|short|lehenga|sharara|gharara)s?\b"), ("dupatta", r"\b(dupatta|dopatta|duppata|shawl|stole|scarf|scarves)s?\b"), ("inner", r"\b(inner|slip|lining|camisole)s?\b"),
]
#: Fabrics; where two begin at one place the longer one counts.
FABRICS = (
    "cotton filament|cotton net|cotton silk|cotton viscose|raw silk|tissue silk|poly tissue silk|poly slub|poly munar|poly munaar|poly lawn|two way slub|two tone|yarn dyed|viscose slub|lurex jacquard|self jacquard|"
    "irish linen|dobby lawn|zari lawn|bamber chiffon|munaar lurex|khaddar|karandi|masoori|susi|doria|dobby|marina|jamawar|banarsi|katan|leno karha|leno|munaar|munar|lurex|lawn|chiffon|georgette|velvet|organza|"
    "cambric|jacquard|herringbone|linen|crepe|satin|tissue|muslin|voile|viscose|pashmina|net|polyester|poly|cotton|silk|zari"
).split("|")
WOMEN, MEN = r"\b(women|womens|women's|ladies|female)\b", r"\b(men|mens|men's|gents|gentlemen|male)\b"
KIDS, UNISEX = r"\b(kids|kid's|child|children|junior|toddler|infant|girls?|boys?|baby)\b", r"\b(unisex|gender[\s-]?neutral)\b"


def keyword_pattern(words: list[str], compat: bool = False) -> str:
    body = "|".join(re.escape(w).replace("/", "/") for w in words)
    return f"({body})" if compat else rf"(?<![a-z0-9])({body})(?![a-z0-9])"


def all_matches(text: Column, rules: Rules, compat: bool = False) -> Column:
    """Values of all rules that match, each once, in order."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(text.rlike(keyword_pattern(k.split("|"), compat)), F.lit(v)) for v, k in rules))))


def first_match(text: Column, rules: Rules, compat: bool = False) -> Column:
    return F.coalesce(*(F.when(text.rlike(keyword_pattern(k.split("|"), compat)), F.lit(v)) for v, k in rules))


def occasions(text: Column, given: Column | None = None, compat: bool = False) -> Column:
    """Occasion rules, and party wherever eid, festive or mehndi apply."""
    found = all_matches(text, OCCASION, compat)
    if given is not None:
        found = F.array_distinct(F.concat(F.coalesce(given, F.array().cast("array<string>")), found))
    party = F.array_contains(found, "eid") | text.rlike(r"\beid\b") | F.array_contains(found, "festive") | text.contains("festive") | F.array_contains(found, "mehndi")
    return F.when(party, F.array_distinct(F.concat(found, F.array(F.lit("party"))))).otherwise(found)


def sub_category(text: Column, given: Column, compat: bool = False) -> Column:
    return F.when(given.isNotNull() & (given != "other"), given).otherwise(F.coalesce(first_match(text, SUBCATEGORY, compat), F.lit("other")))


def composition(sub: Column, what: int) -> Column:
    """0 piece type, 1 stitching, 2 garments (array), 3 dress style of a sub-category; null if unknown."""
    known = {k: v[what] for k, v in COMPOSITION.items() if v[what]}
    found = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))[sub]
    return F.split(found, " ") if what == 2 else found


def garments(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(g)) for g, p in GARMENTS)))


def pieces_in_title(text: Column) -> Column:
    number = F.regexp_extract(text, r"\b([1-4])\s*[- ]?\s*(?:pc|pcs|piece|pieces)\b", 1).try_cast("int")
    word = F.regexp_extract(text, r"\b(one|two|three|four)[\s-]piece\b", 1)
    return F.coalesce(number, F.create_map(*(F.lit(x) for kv in {"one": 1, "two": 2, "three": 3, "four": 4}.items() for x in kv))[word])


def pieces_in_description(text: Column) -> Column:
    head = F.substring(text, 1, 120)
    found = [F.regexp_extract(head, p, 1).try_cast("int") for p in (r"\bunstitched\s+([1-4])\s*[- ]?\s*(?:pc|pcs|piece|pieces)\b", r"\b([1-4])\s*[- ]?\s*(?:pc|pcs|piece|pieces)\s+(?:outfit|suit|stitched|unstitched)\b")]
    word = F.regexp_extract(head, r"\b(one|two|three|four)[\s-]piece\s+(?:outfit|suit)\b", 1)
    return F.coalesce(*found, F.create_map(*(F.lit(x) for kv in {"one": 1, "two": 2, "three": 3, "four": 4}.items() for x in kv))[word])


def listed_garments(desc: Column) -> Column:
    """Garments of an explicit list (what you'll get, separates, outfit -), without those in a (... not included) clause, with
    those after `paired with`; null without such a list."""
    seg = F.lit("")
    for p in (r"outfit\s*[-–]\s*(.*?)(?:\bfabric\b|\bfit\b|$)", r"\bseparates\s*:?\s*(.*?)(?:\bfabric\b|\bnote\b|\bcolou?r\s*:|$)", r"what you'?ll get\s*:?\s*(.*?)(?:\bfit\s*:|\bmodel\b|$)"):
        seg = F.when(desc.rlike(p), F.regexp_extract(desc, p, 1)).otherwise(seg)
    has = desc.rlike(r"outfit\s*[-–]|\bseparates\s*:?|what you'?ll get")
    clause = r"\([^)]*\bnot\s+in\w*ed\b[^)]*\)"
    excluded = garments(F.array_join(F.regexp_extract_all(seg, F.lit(f"({clause})"), F.lit(1)), " "))
    paired = garments(F.regexp_extract(desc, r"paired with\s+([^.]{0,60})", 1))
    named = F.array_except(F.concat(garments(F.regexp_replace(seg, clause, " ")), paired), excluded)
    order = F.filter(F.array(*(F.lit(g) for g, _ in GARMENTS)), lambda g: F.array_contains(named, g))
    return F.when(has & (F.size(order) > 0), order)


def piece_count(title: Column, desc: Column) -> Column:
    """The listed garments (linings don't count), else an explicit count, else the garments named; null if there are none."""
    listed = F.size(F.filter(listed_garments(desc), lambda g: g != "inner"))
    named = F.size(garments(F.element_at(F.split(title, r"\|"), -1)))
    return F.coalesce(F.when(listed_garments(desc).isNotNull(), F.greatest(listed, F.lit(1))), pieces_in_title(title), pieces_in_description(desc), F.when(named > 0, named))


def stitching(title: Column, desc: Column, canonical: Column | None = None) -> Column:
    head = F.substring(desc, 1, 90)
    rules = [
        (title.rlike(r"semi[\s-]?stitched"), "semi-stitched"),
        (title.rlike(r"\bunstitched\b|un-stitched|\brts\b|ready[ -]?to[ -]?stitch"), "unstitched"),
        (title.rlike(r"\bstitched\b|\brtw\b|ready[ -]?to[ -]?wear|\bpret\b|\bpc\s+outfit\b"), "stitched"),
        (head.rlike("unstitched"), "unstitched"),
        (head.rlike(r"\bstitched\b|\bpc\s+outfit\b"), "stitched"),
    ]
    return F.coalesce(*(F.when(c, F.lit(v)) for c, v in rules), *([canonical] if canonical is not None else []), F.lit("stitched"))


def gender(name: Column, tags: Column, desc: Column, given: Column) -> Column:
    """Name, then tags without digits, then description, then the given one, then women."""
    clean = F.lower(F.array_join(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~t.rlike(r"\d|(?i)size|chart|guide|care|wash|dhldes|desc")), " "))
    told = []
    for t in (name, clean, desc):
        told += [F.when(t.rlike(UNISEX), F.lit("unisex")), F.when(t.rlike(MEN) & ~t.rlike(WOMEN), F.lit("men")), F.when(t.rlike(KIDS) & ~t.rlike(WOMEN), F.lit("kids"))]
    return F.coalesce(*told, F.when(given.isin("women", "men", "kids", "unisex"), given), F.lit("women"))


def scan_fabric(text: Column) -> Column:
    """The fabric that is named first; the longest where several begin at one place."""
    best = F.array_min(F.array_compact(F.array(*(F.when(F.instr(text, f) > 0, F.struct(F.instr(text, f).alias("at"), F.lit(-len(f)).alias("size"), F.lit(f).alias("name"))) for f in FABRICS))))
    return F.initcap(best["name"])


def fabric(title: Column, desc: Column) -> Column:
    """The `Fabric:` label, else `... fabric` in prose, else the first fabric of the title, else of the description."""
    stop = r"(?:\(|dupatta|trouser|shirt|bottom|colou?r|cut|slip|design|what|care|season|occasion|details|neckline|composition|material|note|weight|\bfit\b|$)"
    label = F.trim(F.regexp_replace(F.regexp_extract(desc, rf"fabric\s*:\s*([a-z][a-z ]{{1,26}}?)\s*{stop}", 1), r"\s+", " "))
    label = F.regexp_replace(label, r"^((dyed|printed|embroidered|plain|solid|self|digital)\s+)+", "")
    prose = F.transform(F.regexp_extract_all(desc, F.lit(r"\b([a-z]+(?:\s+[a-z]+){0,2})\s+fabric\b"), F.lit(1)), scan_fabric)
    return F.coalesce(F.when(label != "", F.initcap(label)), F.try_element_at(F.array_compact(prose), F.lit(1)), scan_fabric(title), scan_fabric(desc))


def color_label(desc: Column) -> Column:
    stop = r"(?:fabric|shirt|cut|slip|dupatta|trouser|bottom|design|what|care|season|occasion|details|neckline|\bfit\b|$)"
    found = F.trim(F.regexp_extract(desc, rf"\bcolou?r\s*:\s*([a-z][a-z ()]{{1,22}}?)\s*{stop}", 1))
    return F.when(found != "", found)


def sizes(raw: Column) -> Column:
    """array<struct<type, value>>: free, alpha, waist (even numbers 24 to 40) or numeric."""

    def one(s: Column) -> Column:
        up, num = F.upper(F.trim(s)), F.regexp_extract(F.trim(s), r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
        free, alpha = up.rlike("^(FREE SIZE|ONE SIZE|OS|FREE|ONESIZE)$"), up.rlike("^(XS|S|M|L|XL|XXL|XXXL|2XL|3XL)$")
        waist = num.isin(*range(24, 42, 2))
        kind = F.when(free, "free").when(alpha, "alpha").when(waist, "waist").when(num.isNotNull(), "numeric").otherwise("alpha")
        value = F.when(free, F.lit("Free Size")).when(alpha | num.isNull(), up).otherwise(F.when(num == F.floor(num), F.floor(num).cast("string")).otherwise(num.cast("string")))
        return F.struct(kind.alias("type"), value.alias("value"))

    return F.transform(F.coalesce(raw, F.array().cast("array<string>")), one)


def price_band(price: str | Column) -> Column:
    p = col(price)
    return F.when(p < 3000, "low").when(p <= 8000, "mid").when(p.isNotNull(), "high")


#: Weights of the completeness score, by field.
WEIGHTS = {"name": 0.15, "price": 0.10, "images": 0.10, "colors": 0.10, "occasion": 0.10, "style": 0.05, "description": 0.05, "fabric": 0.08, "dress_style": 0.08, "piece_type": 0.07, "pattern": 0.05, "sleeve_type": 0.03, "neckline": 0.02, "fit_type": 0.02}


def completeness(filled: dict[str, Column]) -> Column:
    """Weights of the fields that are filled, summed and rounded to two places."""
    total = F.lit(0.0)
    for field, weight in WEIGHTS.items():
        total = total + F.when(F.coalesce(filled[field], F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))
    return F.round(total, 2)
