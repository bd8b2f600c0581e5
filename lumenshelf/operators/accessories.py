"""Raw listings -> typed shoes, jewelry and watches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, rules
from ..functions.text import clean_name, strip_html

#: Silhouettes by keyword, in order; `=` gives a type whose name isn't its keyword.
SHOES: rules.Rules = [
    ("khussa", "khussa|khussay|khusa"), ("kohati", "kohati"), ("kolhapuri", "kolhapuri"), ("peshawari", "peshawari|charsadda"), ("stiletto", "stiletto"), ("block-heel", "block heel|block-heel"), ("wedge", "wedge"),
    ("platform", "platform"), ("pump", "pump|court shoe"), ("heel", "heel|high heel"), ("sneaker", "sneaker|trainer|jogger|running shoe"), ("loafer", "loafer"), ("moccasin", "moccasin"), ("oxford", "oxford"),
    ("monk-strap", "monk strap|monk-strap"), ("ballet-flat", "ballet flat|ballet-flat|ballerina"), ("mule", "mule"), ("slide", "slide|slider"), ("flip-flop", "flip flop|flip-flop|chappal|chapal"), ("slipper", "slipper"),
    ("sandal", "sandal"), ("chelsea-boot", "chelsea"), ("ankle-boot", "ankle boot|ankle-boot"), ("combat", "combat boot"), ("long-boot", "long boot|knee high"), ("boot", "boot"), ("school-shoe", "school shoe"),
    ("bridal-footwear", "bridal shoe"), ("formal-dress", "formal shoe|dress shoe"), ("espadrille", "espadrille"), ("boat-shoe", "boat shoe"), ("clogs", "clog"), ("flat", "flat shoe"),
]
#: Type of a collection whose listings don't name one.
BUCKETS = {"heels": "heel", "flats": "flat", "sandals": "sandal", "khussa": "khussa", "sneakers": "sneaker", "boots": "boot", "mules": "mule", "formal": "formal-dress", "casual": "flat", "athletic": "sneaker", "ethnic": "khussa"}
NOT_SHOES = "unstitched|lawn suit|3-piece suit|2-piece suit|kameez|dupatta|bedsheet|fabric only|kurta only|shirt only|trouser fabric|perfume|handbag|wallet|clutch bag"
#: Patterns in order; the first that fits gives the value.
HEEL = [("flat", "flat|no heel|0 heel|ballet"), ("platform", "platform|wedge"), ("high", r"high heel|stiletto|4 inch|10\s*cm|12\s*cm"), ("mid", r"mid heel|kitten|2 inch|5\s*cm|6\s*cm"), ("low", r"low heel|1 inch|3\s*cm")]
CLOSURE = [
    ("velcro", r"hook[-\s]?and[-\s]?loop|hook\s*&\s*loop|velcro"), ("lace-up", r"lace[-\s]?up|laces|lacing"), ("zip", r"zipper|\bzip\b"), ("slip-on", r"slip[-\s]?on|pull[-\s]?on"), ("elastic", r"sling[-\s]?back|elastic"), ("buckle", r"\bbuckle"),
]
JEWELRY: rules.Rules = [
    ("jhumka", "jhumka|jhumki"), ("chandbali", "chandbali"), ("stud", "stud earring|studs"), ("hoop", "hoop"), ("earring", "earring|ear ring"), ("choker", "choker"), ("mala", "mala|long necklace"), ("pendant-chain", "pendant"),
    ("necklace", "necklace"), ("bangle-set", "bangle set|bangles"), ("bangle", "bangle"), ("bracelet", "bracelet|kada"), ("ring", "ring"), ("nath", "nose pin|nose ring|nath"), ("maang-tikka", "tikka|maang"), ("jhoomar", "jhoomar"),
    ("bridal-set", "bridal set|jewelry set|jewellery set"), ("anklet", "anklet|payal"), ("brooch", "brooch"), ("cufflinks", "cufflink"),
]
WORN = [("ear", "earring|stud|hoop|jhumka|chandbali"), ("neck", "necklace|choker|mala|pendant"), ("wrist", "bangle|bracelet|kada"), ("hand", "ring|cufflink"), ("head", "nath|tikka|jhoomar"), ("bridal-set", "set")]
#: Words in names that aren't jewelry: footwear, bags, clothes, beauty and others.
NOT_JEWELRY_WORDS = [
    "sandal", "sandals", "slipper", "slippers", "chappal", "chappals", "khussa", "kolhapuri", "peshawari", "heel", "heels", "pump", "pumps", "sneaker", "sneakers", "jogger", "joggers", "shoe", "shoes", "boot", "boots",
    "loafer", "loafers", "mule", "mules", "wedge", "wedges", "court shoe", "flip flop", "footwear",
    "bag", "bags", "clutch", "purse", "purses", "wallet", "backpack", "tote", "handbag", "satchel", "pouch", "belt", "belts",
    "kurta", "kurti", "shirt", "trouser", "trousers", "dupatta", "shawl", "stole", "scarf", "abaya", "hijab", "suit", "saree", "lehenga", "kameez", "qameez", "shalwar", "salwar", "waistcoat", "jacket", "coat", "pant", "pants",
    "pajama", "pyjama", "sherwani", "frock", "tunic", "maxi", "gown", "blouse", "culotte", "rtw", "rts", "pret", "khaddar",
    "perfume", "fragrance", "lipstick", "makeup", "nail polish", "sunglass", "sunglasses", "watch", "watches",
]
#: Words in names that aren't watches.
NOT_WATCH_WORDS = [
    "sandal", "sandals", "slipper", "slippers", "khussa", "pump", "pumps", "sneaker", "sneakers", "shoe", "shoes", "boot", "boots", "loafer", "loafers", "mule", "mules", "wedge",
    "wedges", "footwear", "bag", "bags", "clutch", "purse", "wallet", "backpack", "tote", "handbag", "satchel", "scarf", "scarves", "shawl", "stole", "shirt", "kurta", "kurti",
    "dupatta", "suit", "trouser", "trousers", "piece", "pret", "rtw", "rts", "khaddar", "lawn", "abaya", "hijab", "saree", "lehenga", "kameez", "shalwar", "salwar", "waistcoat",
    "jacket", "coat", "frock", "tunic", "blouse", "perfume", "fragrance", "lipstick", "makeup", "earring", "earrings", "necklace", "bangle", "bangles",
]


def _whole_words(words: list[str]) -> str:
    """A pattern of whole words; a blank between two may be a hyphen or missing."""
    return r"\b(" + "|".join(w.replace(" ", r"[-\s]?") for w in words) + r")\b"


WATCH = [
    ("smartwatch", r"smart\s*watch|apple watch|wear os|bluetooth call"), ("chronograph", "chronograph"), ("digital", "digital|led display"), ("couple-set", "couple|his and her|pair set"), ("kids", "kids|children"),
    ("diver-style", "diver|200m|100m water"), ("minimalist", "minimal|slim profile"), ("dress", "dress|formal watch"), ("sports", "sport|stopwatch"),
]
STRAP = [("mesh", "mesh|milanaise"), ("leather", "leather|calf"), ("metal-bracelet", "metal bracelet|stainless bracelet|steel band"), ("silicone", "silicone|rubber strap"), ("fabric", "nato|fabric strap")]
MOVEMENT = [("automatic", "automatic|self-wind"), ("mechanical", "mechanical|hand wind"), ("solar", "solar|eco-drive"), ("digital-module", "digital|module")]
WATER = [("200m-plus", r"200m|300m|20\s*atm|diver"), ("100m", r"100m|10\s*atm"), ("50m", r"50m|5\s*atm"), ("30m", r"30m|3\s*atm"), ("splash", "splash|water resist")]


def by_pattern(text: Column, table: list[tuple[str, str]], other: str) -> Column:
    return F.coalesce(*(F.when(text.rlike(p), F.lit(v)) for v, p in table), F.lit(other))


def by_prefix(text: Column, table: rules.Rules) -> Column:
    """The first rule of which a keyword begins a word."""
    return F.coalesce(*(F.when(text.rlike(rf"\b({k})"), F.lit(v)) for v, k in table))


def _common(raw: DataFrame) -> DataFrame:
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    s = raw.withColumns({"name": clean_name("title"), "description": strip_html("description", 2000), "tags": tags})
    s = s.withColumns({"_t": F.lower("name"), "_tags": F.lower(F.array_join("tags", " "))}).withColumn("_blob", F.concat_ws(" ", "_t", F.lower("description"), "_tags"))
    tone = color.infer("name", "_tags", "description")
    s = s.withColumn("_tone", tone)
    return s.withColumns({"primary_color": F.col("_tone.primary"), "colors": F.col("_tone.colors"), "exact_colors": F.col("_tone.shades"), "color_family": color.coarse("_tone.primary")})


def _reject(extra: list[tuple[Column, str]]) -> Column:
    checks = [(F.length("name") < 2, "name"), *extra, (~F.coalesce(F.col("price") > 0, F.lit(False)), "price"), (F.coalesce(F.size("images"), F.lit(0)) <= 0, "images"), (~F.coalesce(F.col("product_url").startswith("http"), F.lit(False)), "url")]
    return F.coalesce(*(F.when(c, F.lit(w)) for c, w in checks))


def _out(df: DataFrame) -> DataFrame:
    return df.drop("title", *[c for c in df.columns if c.startswith("_")])


def shoes(raw: DataFrame) -> DataFrame:
    """raw: listings with sub_category (a bucket), occasion, gender. Every row comes back; `reject` tells why it is no shoe."""
    s = _common(raw)
    bucket = F.create_map(*(F.lit(x) for kv in BUCKETS.items() for x in kv))[F.col("sub_category")]
    kind = F.coalesce(by_prefix(F.col("_t"), SHOES), by_prefix(F.col("_tags"), SHOES), bucket, F.lit("other"))
    b = F.col("_blob")
    strings = lambda *x: F.array(*(F.lit(v) for v in x))
    none = F.array().cast("array<string>")
    found = [("bridal|wedding|nikah|barat", ("wedding", "bridal")), ("eid|festive", ("eid",)), ("mehndi|mayun|haldi", ("mehndi",)), ("formal|office|work", ("formal", "office")), ("party|evening", ("party",)), ("sport|gym|run|training", ("casual",))]
    occasion = F.array_distinct(F.concat(F.coalesce(F.col("occasion"), none), *(F.when(b.rlike(p), strings(*v)).otherwise(none) for p, v in found)))
    season = F.concat(F.when(b.rlike("summer|lawn|open toe|breathable"), strings("summer")).otherwise(none), F.when(b.rlike("winter|warm|lined|boot"), strings("winter")).otherwise(none))
    s = s.withColumns({
        "shoe_type": kind,
        "gender": rules.gender(F.col("_t"), F.col("tags"), F.lit(""), F.col("gender")),
        "occasion": F.when(F.size(occasion) > 0, occasion).otherwise(strings("casual")),
        "season": F.when(F.size(season) > 0, season).otherwise(strings("all-season")),
        "heel_height": by_pattern(b, HEEL, "unknown"),
        "closure": by_pattern(b, CLOSURE, "slip-on"),
        "sport_use": b.rlike("sport|gym|running|training"),
        "reject": _reject([(b.rlike(rf"\b({NOT_SHOES})\b"), "not a shoe")]),
    })
    return _out(s)


def jewelry(raw: DataFrame) -> DataFrame:
    s = _common(raw)
    kind = F.coalesce(by_prefix(F.col("_t"), JEWELRY), by_prefix(F.col("_blob"), JEWELRY), F.lit("other"))
    s = s.withColumn("jewelry_type", kind).withColumn("jewelry_category", by_pattern(F.col("jewelry_type"), WORN, "other"))
    metal = by_pattern(F.col("_blob"), [("gold-plated", "gold[- ]plated"), ("rose-gold", "rose gold"), ("silver", "silver"), ("gold", "gold"), ("oxidised", "oxidi[sz]ed"), ("brass", "brass")], "other")
    stone = by_pattern(F.col("_blob"), [("kundan", "kundan"), ("polki", "polki"), ("zircon", "zircon|cubic"), ("pearl", "pearl"), ("crystal", "crystal"), ("stone", "stone")], "none")
    pieces = F.regexp_extract("_blob", r"\b(?:set of (\d+))", 1).try_cast("int")
    bad = [(F.col("_t").rlike(_whole_words(NOT_JEWELRY_WORDS)), "not jewelry"), (F.col("_blob").rlike("unstitched|lawn suit|kurta fabric|bedsheet"), "not jewelry")]
    return _out(s.withColumns({"metal_finish": metal, "stone_work": stone, "set_piece_count": pieces, "reject": _reject(bad)}))


def watches(raw: DataFrame) -> DataFrame:
    s = _common(raw)
    b = F.col("_blob")
    told = F.when(b.rlike(r"\b(men|mens|gents)\b"), "men").when(b.rlike(r"\bkids\b"), "kids").when(b.rlike(r"\b(women|ladies)\b"), "women").otherwise("unisex")
    size = F.regexp_extract(b, r"(\d{2})\s*mm\b", 1).try_cast("int")
    bad = [(b.rlike("unstitched|lawn suit|kurta|dupatta|bedsheet|perfume") | F.col("_t").rlike(_whole_words(NOT_WATCH_WORDS)), "not a watch")]
    return _out(s.withColumns({"gender": F.coalesce("gender", told), "watch_type": by_pattern(b, WATCH, "analog"), "strap_type": by_pattern(b, STRAP, "other"), "movement": by_pattern(b, MOVEMENT, "quartz"), "water_resistance": by_pattern(b, WATER, "unknown"), "case_diameter_mm": size, "reject": _reject(bad)}))
