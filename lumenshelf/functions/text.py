"""Text expressions: cleaning, keys, hashes, keyword scores."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entity names that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "bull": "•", "middot": "·",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "sbquo": "‚", "bdquo": "„", "copy": "©", "reg": "®", "trade": "™", "deg": "°", "times": "×",
    "frac12": "½", "frac14": "¼", "frac34": "¾", "eacute": "é", "egrave": "è", "agrave": "à", "aacute": "á", "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä",
}
#: Abbreviations that stay in capitals.
CAPITALS = ["RTW", "RTS", "PC", "PCS", "UV", "LED", "USB", "GPS", "II", "III", "IV", "XL", "XXL", "XS", "EID", "PU"]
#: Words that carry no meaning for keyword similarity.
STOP_WORDS = ["with", "that", "this", "from", "your", "have", "will", "been", "more", "than", "they", "their", "what", "when", "where", "which"]
BLANKS = r"[\s ​]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_tags(html: str | Column) -> Column:
    """Scripts, styles and tags to spaces, whitespace collapsed; entities stay."""
    out = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style)[\s\S]*?</\1>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, BLANKS, " "))


def decode_named(text: Column) -> Column:
    """Named entities but `&amp;`, which comes last so that nothing is decoded twice."""
    for name, char in ENTITIES.items():
        if name != "amp":
            text = F.regexp_replace(text, f"(?i)&{name};", "\\$" if char == "$" else char)
    return text


def decode_numeric(text: Column) -> Column:
    """Numeric entities of code points other than `&`; what isn't a character stays."""
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"), F.lit(1)))
    value = lambda c: F.when(F.lower(F.substring(c, 1, 1)) == "x", F.conv(F.substring(c, 2, 6), 16, 10)).otherwise(c).cast("int")
    fits = lambda n: n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF) & (n != 38)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.aggregate(codes, text, lambda out, c: F.when(fits(value(c)), F.replace(out, F.concat(F.lit("&#"), c, F.lit(";")), char(value(c)))).otherwise(out))


def decode_entities(text: Column) -> Column:
    """Named and numeric entities, each once; unknown ones stay. Texts without `&` are left as they are."""
    out = F.regexp_replace(decode_numeric(decode_named(text)), "(?i)&(amp|#0*38|#x0*26);", "&")
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def strip_html(html: str | Column, longest: int | None = None) -> Column:
    """Clean text of HTML, entities decoded after the tags have gone."""
    out = F.trim(F.regexp_replace(decode_entities(strip_tags(html)), BLANKS, " "))
    return F.substring(out, 1, longest) if longest else out


def unshout(name: str | Column) -> Column:
    """ALL-CAPS names (four letters or more) in title case; tokens with digits and known abbreviations stay."""
    s = col(name)
    letters = F.regexp_replace(s, "[^A-Za-z]", "")
    token = lambda t: F.when(t.rlike("[0-9]") | t.isin(CAPITALS), t).otherwise(F.concat(F.substring(t, 1, 1), F.lower(F.substring(t, 2, 10000))))
    words, gaps = F.split(F.regexp_replace(s, "[^A-Za-z0-9']+", "\u0001"), "\u0001"), F.split(F.regexp_replace(s, "[A-Za-z0-9']+", "\u0001"), "\u0001")
    # a text is gap, word, gap, word, ...; one of both lists starts with an empty string
    body = F.when(s.rlike("^[A-Za-z0-9']"), words).otherwise(F.slice(words, 2, 100000))
    joined = F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), body.alias("w")), lambda x: F.concat(F.coalesce(x["g"], F.lit("")), F.coalesce(F.when(x["w"] != "", token(x["w"])), F.lit("")))), "")
    return F.when((F.length(letters) >= 4) & (letters == F.upper(letters)), joined).otherwise(s)


def clean_name(title: str | Column) -> Column:
    out = F.regexp_replace(strip_html(title), r"\s+([,.;:])", "$1")
    return unshout(F.trim(F.regexp_replace(out, r"^[-–—|]+\s*|\s*[-–—|]+$", "")))


def slug(text: str | Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]+", "-")
    return F.regexp_replace(out, "^-+|-+$", "")


def last_segment(url: str | Column) -> Column:
    """Last path segment of a URL, decoded, without .html, .htm or .php."""
    path = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    seg = F.element_at(F.filter(F.split(path, "/"), lambda s: s != ""), -1)
    return F.coalesce(F.regexp_replace(F.try_url_decode(seg), r"(?i)\.(html?|php)$", ""), F.lit(""))


def strip_query(url: str | Column) -> Column:
    return F.regexp_replace(col(url), r"[?#].*$", "")


def absolute_url(url: str | Column, origin: str) -> Column:
    u = col(url)
    return F.when(u.rlike("^https?://"), u).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(F.lit(origin), u)).otherwise(F.concat(F.lit(origin + "/"), u))


def number_text(x: str | Column) -> Column:
    """Numbers as text without a trailing .0, for hashing."""
    d = col(x).cast("double")
    return F.when(d == F.floor(d), F.floor(d).cast("string")).otherwise(d.cast("string"))


def event_id(*parts: str | Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def actor_hash(user: str | Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), col(user).cast("string")), 256), 1, 24)


def text_hash(text: str | Column) -> Column:
    return F.substring(F.sha1(F.coalesce(col(text), F.lit("")).cast("binary")), 1, 16)


def price_number(text: str | Column) -> Column:
    """The number a price text starts with once all but digits and points are gone."""
    return F.regexp_extract(F.regexp_replace(col(text), "[^0-9.]", ""), r"^([0-9]*\.?[0-9]+)", 1).try_cast("double")


def query_words(text: str | Column, longer_than: int = 2) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"[\s,.-]+"), lambda w: F.length(w) > longer_than)


def textual_match(text: Column, query: str | Column) -> Column:
    """0.3 + 0.6 x share of the query's words (three letters or more) that the text contains."""
    words = query_words(query)
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(text), w)))
    return F.when(F.size(words) == 0, F.lit(0.3)).otherwise(F.round(F.least(F.lit(1.0), 0.3 + 0.6 * hits / F.size(words)), 4))


def keyword_set(text: Column) -> Column:
    return F.array_distinct(F.filter(query_words(text, 3), lambda w: ~w.isin(STOP_WORDS)))


def keyword_similarity(a: Column, b: Column) -> Column:
    """Shared keywords over the geometric mean of both sets' sizes, plus 0.2, at most 0.9; 0.3 without keywords."""
    both, n = F.size(F.array_intersect(a, b)), F.sqrt(F.size(a) * F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.3)).otherwise(F.least(F.lit(0.9), both / n + 0.2))


def overlap_score(a: Column, b: Column) -> Column:
    """Elements of b that a has (repeats count) over the longer length, plus 0.2, at most 1; 0.4 if either is empty."""
    low = lambda x: F.transform(x, lambda s: F.lower(s))
    hits = F.size(F.filter(low(b), lambda s: F.array_contains(low(a), s)))
    size = lambda x: F.coalesce(F.size(x), F.lit(0))
    return F.when((size(a) <= 0) | (size(b) <= 0), F.lit(0.4)).otherwise(F.least(F.lit(1.0), hits / F.greatest(size(a), size(b)) + 0.2))


def fuzzy_resolve(token: str | Column, allowed: Iterable[str], most: int = 2) -> Column:
    """The allowed value a token stands for: the same after lower case, hyphens and plural s, else the nearest within `most`
    edits if the token has four letters or more; null otherwise."""
    t = F.regexp_replace(F.trim(F.lower(col(token))), r"[\s_]+", "-")
    single = F.regexp_replace(t, "s$", "")
    options = F.array(*(F.lit(a) for a in allowed))
    near = F.array_min(F.transform(options, lambda a: F.struct(F.least(F.levenshtein(a, t), F.levenshtein(a, single)).alias("d"), a.alias("v"))))
    return F.coalesce(F.try_element_at(F.filter(options, lambda a: (a == t) | (a == single)), F.lit(1)), F.when((F.length(t) >= 4) & (near["d"] <= most), near["v"]))


def untrusted(text: str | Column, longest: int) -> Column:
    """Control and direction characters removed, cut to length."""
    return F.substring(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F​-‏‪-‮⁦-⁩]", ""), 1, longest)


#: Phrases that try to steer a model.
INJECTION = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions|prompts|rules)",
    r"disregard\s+(all\s+)?(previous|prior|above)",
    r"system\s+prompt",
    r"you\s+are\s+now\s+",
    r"reveal\s+(your|the)\s+(prompt|instructions)",
    r"act\s+as\s+(an?\s+)?(admin|developer|system)",
    r"</?(system|assistant|user)>",
]


def looks_injected(text: str | Column) -> Column:
    return F.coalesce(col(text), F.lit("")).rlike("(?i)" + "|".join(f"(?:{p})" for p in INJECTION))


def first_object(text: str | Column, schema: str) -> Column:
    """The first {...} of a text, read as JSON of the schema; null if it isn't."""
    return F.from_json(F.regexp_extract(col(text), r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


def notification(name: str | Column, old: str | Column, new: str | Column, currency: str | Column) -> tuple[Column, Column]:
    """(text, per cent) of a price drop."""
    pct = F.floor((col(old) - col(new)) / col(old) * 100 + 0.5).cast("int")
    return F.concat(col(name), F.lit(" dropped "), pct.cast("string"), F.lit("%: "), number_text(old), F.lit(" to "), number_text(new), F.lit(" "), col(currency)), pct


#: Words that may follow an alternative that is cut, kinds of cut that catalogs don't know, garments that they don't have.
ANCHORS = ["tailored", "structured", "embroidered", "plain", "printed", "unstitched", "stitched", "velvet", "chiffon", "lawn", "cotton", "silk", "kurta", "shalwar-kameez", "lehenga", "saree", "abaya", "western", "co-ord"]
REGIONAL = ["sharara", "gharara", "anarkali", "angrakha"]
NOT_SOLD = ["maxi dress", "maxi", "gown", "long frock", "frock", "tunic", "palazzo", "sherwani"]


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_alternatives(text: str | Column) -> Column:
    """`pink or mint green lawn` -> `pink lawn`: the first alternative stays, where a known word follows the second."""
    pattern = rf"(?i)^(.*?)\b(\w+(?:\s\w+)?)\s+or\s+(\w+(?:\s\w+)?)\s+(?=(?:{'|'.join(ANCHORS)}|for\s|\d+-piece))"
    return _tidy(F.regexp_replace(col(text), pattern, "$1$2 "))


def without_regional(text: str | Column) -> Column:
    return _tidy(F.regexp_replace(col(text), rf"(?i)\b({'|'.join(REGIONAL)})(-style)?\s+", ""))


def with_sold_garments(text: str | Column, dress_style: str | Column) -> Column:
    """Garments that no catalog has become the style that is looked for; a word that then stands twice stands once. Without a style
    nothing changes."""
    style, out = col(dress_style), col(text)
    safe = F.regexp_replace(style, r"([\\$])", r"\\$1")
    for word in NOT_SOLD:
        out = F.regexp_replace(out, F.lit(rf"(?i)\b{word}\b"), safe)
    once = F.regexp_replace(out, r"(?i)\b(\w+)(\s+\1)+\b", "$1")
    return F.when(F.coalesce(style, F.lit("")) == "", col(text)).otherwise(_tidy(once))


def search_prompt(text: str | Column, dress_style: str | Column) -> Column:
    """A query text as catalogs understand it: alternatives, regional cuts and garments that aren't sold are taken out."""
    return with_sold_garments(without_regional(without_alternatives(text)), dress_style)
