"""Predicates as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col

GENDERS = ("women", "men", "kids", "unisex")
#: What a print request covers.
PRINT_PATTERNS = {
    "embroidered": ["embroidered", "embellished", "mixed"],
    "embellished": ["embroidered", "embellished", "mixed"],
    "plain": ["plain", "textured"],
    "printed": ["printed", "digital-print", "floral", "geometric"],
    "mixed": ["mixed", "embroidered", "printed", "embellished"],
}
#: Silhouettes that must match as they are.
DISTINCTIVE = ["lehenga", "saree", "gown", "frock", "maxi", "abaya", "palazzo", "western", "co-ord"]
NOT_OUTFITS = "(?i)dupatta|stole|scarf|scarves|clutch|bag|jewelry|jewellery"


def in_stock(stock: str | Column = "in_stock") -> Column:
    """Only false is out of stock; null isn't."""
    return ~col(stock).eqNullSafe(F.lit(False))


def parse_genders(text: str | None) -> list[str]:
    return [g for g in (x.strip().lower() for x in (text or "").split(",")) if g in GENDERS]


def gender_in(genders: list[str], c: str | Column = "gender") -> Column:
    return col(c).isin(genders) if genders else F.lit(True)


def price_between(low: float | None, high: float | None, c: str | Column = "price") -> Column:
    """0 and null mean no limit."""
    out = F.lit(True)
    out = out & (col(c) >= low) if low else out
    return out & (col(c) <= high) if high else out


def contains_text(c: str | Column, text: str) -> Column:
    """Without regard to case; the text is literal."""
    return F.contains(F.lower(col(c)), F.lit(text.lower()))


def any_of(c: str | Column, values: list[str]) -> Column:
    return F.arrays_overlap(col(c), F.array(*(F.lit(v) for v in values))) if values else F.lit(True)


def any_element_like(c: str | Column, pattern: str) -> Column:
    return F.exists(col(c), lambda x: x.rlike(pattern))


def not_like(c: str | Column, pattern: str) -> Column:
    """Null passes."""
    return F.coalesce(~col(c).rlike(pattern), F.lit(True))


def not_in(c: str | Column, values: list[str]) -> Column:
    """Null passes."""
    return F.coalesce(~col(c).isin(values), F.lit(True))


def season_fits(season: str, c: str | Column = "season") -> Column:
    s = col(c)
    return s.isNull() | (F.size(s) <= 0) | F.array_contains(s, season) | F.array_contains(s, "all-season")


def shade_is(shade: str, c: str | Column = "exact_colors") -> Column:
    return F.exists(col(c), lambda x: F.lower(x) == shade.strip().lower())


def family_in(families: list[str], primary: str | Column = "primary_color", colors: str | Column = "colors") -> Column:
    return F.coalesce(col(primary).isin(families), F.lit(False)) | F.coalesce(any_of(colors, families), F.lit(False))


def neckline_is(value: str, neckline: str | Column = "neckline", desc: str | Column = "description") -> Column:
    pattern = "(?i)" + r"[\s-]?".join("\\Q" + p + "\\E" for p in value.strip().split("-"))
    return F.coalesce(col(neckline) == value, F.lit(False)) | F.coalesce(col(desc).rlike(pattern), F.lit(False))


def needs_embedding(vector: str | Column, model: str | Column, text_hash: Column, stored: str | Column, current: str) -> Column:
    v = col(vector)
    return v.isNull() | (F.size(v) <= 0) | ~col(model).eqNullSafe(F.lit(current)) | ~col(stored).eqNullSafe(text_hash)


def image_changed(url: str | Column, embedded: str | Column) -> Column:
    return F.coalesce(col(url), F.lit("")) != F.coalesce(col(embedded), F.lit(""))


def missing_field(required: list[str], price: str | Column = "price", url: str | Column = "product_url") -> Column:
    """Why a row is invalid: `missing: x`, `invalid price`, `invalid url`; null if it is valid."""
    empty = [F.when(col(c).isNull() | (col(c).cast("string") == ""), F.lit(f"missing: {c}")) for c in required]
    return F.coalesce(*empty, F.when(~(col(price) > 0), F.lit("invalid price")), F.when(~col(url).startswith("http"), F.lit("invalid url")))


def private_address(host: str | Column) -> Column:
    """Whether a host is local: a loopback, private, link-local or unspecified IPv4 address, or a local name."""
    h = F.lower(col(host))
    octet = [F.regexp_extract(h, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in (1, 2)]
    a, b = octet
    ranges = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | (a >= 224)
    return F.coalesce(ranges, F.lit(False)) | h.isin("localhost", "::1", "[::1]", "0") | h.endswith(".local") | h.endswith(".internal")


def safe_url(url: str | Column) -> Column:
    """http or https, no user part, no unusual port, a host that isn't local."""
    u = col(url)
    rest = F.regexp_extract(u, r"^(?i)https?://([^/?#]+)", 1)
    host, port = F.regexp_replace(rest, r":\d+$", ""), F.regexp_extract(rest, r":(\d+)$", 1)
    return F.coalesce((rest != "") & ~F.contains(rest, F.lit("@")) & port.isin("", "80", "443") & ~private_address(host), F.lit(False))


@dataclass(frozen=True)
class Intent:
    """What a shopper asks for; None and empty mean no constraint."""

    occasion: tuple[str, ...] = ()
    print: str | None = None
    dress_style: str | None = None
    stitching: str | None = None
    pieces: int | None = None
    fabric: str | None = None
    neckline: str | None = None
    season: str | None = None
    color_exact: str | None = None
    color_families: tuple[str, ...] = ()
    gender: str | None = None
    max_budget: float = 0
    priority: tuple[str, ...] = field(default=())


def hard(intent: Intent, budget: bool = True) -> Column:
    """What is never relaxed: an outfit, in stock, of the gender, within the budget."""
    out = in_stock() & not_in("sub_category", ["dupatta", "scarves", "jewelry", "bags"]) & not_like("name", NOT_OUTFITS)
    if intent.gender and intent.gender not in ("women", "unisex"):
        out = out & (F.col("gender") == intent.gender)
    if intent.max_budget > 0 and budget:
        out = out & (F.col("price") <= intent.max_budget)
    return F.coalesce(out, F.lit(False))


def given(intent: Intent) -> list[str]:
    """Names of the soft constraints that an intent has."""
    fields = ("occasion", "print", "dress_style", "stitching", "pieces", "fabric", "neckline", "season", "color_exact")
    return [f for f in fields if getattr(intent, f)] + (["color_family"] if intent.color_families else [])


def soft(intent: Intent) -> dict[str, Column]:
    """A column for each constraint that the intent has, by name; colour has color_exact and color_family."""
    out: dict[str, Column] = {}
    if intent.occasion:
        wanted = set(intent.occasion)
        wanted |= {"bridal", "wedding"} if wanted & {"bridal", "wedding"} else set()
        out["occasion"] = any_of("occasion", sorted(wanted))
    if intent.print:
        out["print"] = F.col("pattern").isin(PRINT_PATTERNS.get(intent.print, [intent.print]))
    if intent.dress_style:
        style = "shalwar-kameez" if intent.dress_style == "kurta" else intent.dress_style
        fits = F.col("dress_style") == style
        if style == "shalwar-kameez":
            bridal = set(intent.occasion) & {"bridal", "wedding", "mehndi"}
            fits = F.coalesce(fits, F.lit(False)) | (F.col("sub_category").isin("bridal", "festive") if bridal else F.col("sub_category").rlike("(?i)suit|kameez|unstitched"))
        out["dress_style"] = fits
    if intent.stitching:
        out["stitching"] = F.col("stitching") == "unstitched" if intent.stitching == "unstitched" else F.col("stitching").isin("stitched", "semi-stitched")
    if intent.pieces:
        out["pieces"] = F.col("pieces") == intent.pieces
    if intent.fabric:
        out["fabric"] = contains_text("fabric", intent.fabric.strip())
    if intent.neckline:
        out["neckline"] = neckline_is(intent.neckline)
    if intent.season:
        out["season"] = season_fits(intent.season)
    if intent.color_exact:
        out["color_exact"] = shade_is(intent.color_exact)
    if intent.color_families:
        out["color_family"] = family_in(list(intent.color_families))
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}
