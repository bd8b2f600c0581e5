"""Raw listings -> typed clothing products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color, rules
from ..functions.text import clean_name, last_segment, slug, strip_html


def normalize(raw: DataFrame, compat: bool = False) -> DataFrame:
    """raw: listings with brand, category, sub_category, occasion, style, gender of their collection. Every row comes back, with
    `reject` telling why it is not a product (null if it is). compat matches keywords inside words too."""
    empty = F.array().cast("array<string>")
    have = lambda name, other: F.col(name) if name in raw.columns else other
    tags = F.coalesce(F.col("tags"), empty)
    s = raw.withColumns({"name": clean_name("title"), "description": strip_html("description", 2000), "tags": tags})
    s = s.withColumns({"_t": F.lower("name"), "_d": F.lower("description")})
    blob = F.lower(F.concat_ws(" ", "name", have("product_type", F.lit("")), F.array_join("tags", " "), "description"))
    s = s.withColumns({"_blob": blob, "_head": F.lower(F.concat_ws(" ", "name", have("product_type", F.lit("")), F.array_join("tags", " ")))})
    sub = rules.sub_category(F.col("_blob"), F.col("sub_category"), compat)
    count = rules.piece_count(F.col("_t"), F.col("_d"))
    named = rules.garments(F.element_at(F.split("_t", r"\|"), -1))
    sole = F.when((F.size(named) == 1) & (F.coalesce(count, F.lit(1)) == 1), F.get(named, F.lit(0)))
    sub = F.coalesce(F.when(sole == "trouser", "pants").when(sole == "dupatta", "dupatta"), sub)
    s = s.withColumns({"_sub": sub, "_count": count})
    stitched = rules.stitching(F.col("_t"), F.col("_d"), rules.composition(F.col("_sub"), 1))
    s = s.withColumns({"stitching": stitched, "piece_type": F.coalesce(F.when(F.col("_count").isNotNull(), F.concat(F.col("_count").cast("string"), F.lit("-piece"))), rules.composition(F.col("_sub"), 0))})
    n = F.col("_count")
    suit = F.when(F.col("stitching") == "unstitched", F.concat(F.lit("unstitched-"), F.greatest(n, F.lit(1)).cast("string"), F.lit("-piece"))).when(n == 1, "kurta").otherwise(F.concat(n.cast("string"), F.lit("-piece")))
    fixed = F.col("_sub").isin("pants", "shalwar", "dupatta", "co-ord", "western", "bridal", "festive")
    s = s.withColumn("sub_category", F.when(n.isNotNull() & ~fixed, suit).otherwise(F.col("_sub")))
    tone = color.infer(F.array_join(have("variant_options", empty), " "), "name", F.array_join("tags", " "), "description")
    dress = F.coalesce(rules.first_match(F.col("_t"), rules.TITLE_STYLES, compat), rules.composition(F.col("sub_category"), 3))
    t = F.col("_blob")
    s = s.withColumns({
        "_tone": tone,
        "occasion": rules.occasions(t, F.col("occasion"), compat),
        "style": F.array_distinct(F.concat(F.coalesce(F.col("style"), empty), rules.all_matches(t, rules.STYLE, compat))),
        "dress_style": dress,
        "fashion_type": F.coalesce(rules.first_match(t, rules.FASHION, compat), F.lit("eastern")),
        "pattern": rules.first_match(t, rules.PATTERN, compat),
        "season": F.coalesce(F.when(F.size(rules.all_matches(t, rules.SEASON, compat)) > 0, rules.all_matches(t, rules.SEASON, compat)), F.array(F.lit("all-season"))),
        "trend_tags": rules.all_matches(t, rules.TREND, compat),
        "sleeve_type": rules.first_match(t, rules.SLEEVE, compat),
        "neckline": rules.first_match(t, rules.NECKLINE, compat),
        "fit_type": rules.first_match(t, rules.FIT, compat),
        "fabric": rules.fabric(F.col("_t"), F.col("_d")),
        "gender": rules.gender(F.col("_t"), F.col("tags"), F.col("_d"), F.col("gender")),
        "normalized_sizes": rules.sizes(have("sizes", empty)),
        "price_range": rules.price_band("price"),
    })
    s = s.withColumns({"primary_color": F.col("_tone.primary"), "colors": F.col("_tone.colors"), "exact_colors": F.col("_tone.shades"), "color_family": color.coarse("_tone.primary")})
    filled = {c: F.col(c).isNotNull() for c in ("name", "fabric", "dress_style", "piece_type", "pattern", "sleeve_type", "neckline", "fit_type")} | {
        "price": F.col("price") > 0, "images": F.size("images") > 0, "colors": F.get("colors", F.lit(0)) != "Multicolor", "occasion": F.size("occasion") > 0, "style": F.size("style") > 0, "description": F.length("description") > 20,
    }
    banned = F.col("_head").rlike(rules.keyword_pattern(rules.NOT_CLOTHING, compat))
    reject = F.when(F.length("name") < 3, "name").when(banned, "not clothing").when(~F.coalesce(F.col("price") > 0, F.lit(False)), "price").when(F.coalesce(F.size("images"), F.lit(0)) <= 0, "images")
    keep = [c for c in raw.columns if c not in ("title",)]
    added = ["name", "piece_type", "stitching", "dress_style", "fashion_type", "pattern", "season", "trend_tags", "sleeve_type", "neckline", "fit_type", "fabric", "normalized_sizes", "price_range", "primary_color", "colors", "exact_colors", "color_family"]
    return s.withColumns({"metadata_score": rules.completeness(filled), "reject": reject}).select(*dict.fromkeys([*keep, *added, "metadata_score", "reject"]))


def style_key(name: str = "name", url: str = "product_url", brand: str = "brand") -> tuple[object, object, object]:
    """(code, group, colour token) from the last part of a listing's address: what is left of it beside the name, if that holds
    a digit; a last token that names a colour is split off."""
    from ..functions.text import last_segment, slug

    seg, title = slug(last_segment(url)), slug(name)
    rest = F.when(F.startswith(seg, F.concat(title, F.lit("-"))), F.expr("''")).otherwise(F.lit(None))
    rest = F.when(rest.isNotNull(), F.substring(seg, F.length(title) + 2, F.length(seg))).when(seg == title, F.lit("")).otherwise(seg)
    tokens = F.filter(F.split(rest, "-"), lambda t: t != "")
    last = F.try_element_at(tokens, F.lit(-1))
    is_color = F.coalesce((F.size(tokens) > 1) & last.rlike("^[a-z]{3,12}$") & (F.size(color.shades_in(last)) > 0), F.lit(False))
    code = F.array_join(F.when(is_color, F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens), "-")
    has = (code != "") & rest.rlike(r"\d")
    return F.when(has, F.upper(code)), F.when(has, F.concat(F.lower(F.coalesce(F.col(brand), F.lit(""))), F.lit(":"), code)), F.when(has & is_color, last)
