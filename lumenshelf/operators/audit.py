"""Audit of listings: do the fields of a product agree with what its own text says?

Each rule is a column that is null or struct<severity, type, detail>; `issues` puts them together. A hard issue says that a field is
wrong, a soft one that it may be a matter of shade or wording. `consistency` judges a listing as it is taken in, `overlap` looks
for shared words instead, over listings that are stored already. All of it is expressions: no rule needs a Python worker.

Expected columns: name, description, fabric, exact_colors, colors, primary_color, pieces, stitching, gender (any may be null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color, rules

ISSUE = "struct<severity:string,type:string,detail:string>"
#: Words that descriptions put before a fabric and that fields leave out.
FILLERS = ["dyed", "pure", "premium", "woven", "yarn", "printed", "processed", "pre", "treated", "embroidered", "digital"]
#: Fabric names and the fabric that they stand for; the first that a text holds counts.
SAME_FABRIC = [
    ("munaar lurex", "lurex"), ("munaar", "lurex"), ("korean raw silk", "rawsilk"), ("raw silk", "rawsilk"), ("cambric cotton", "cambric"), ("cotton cambric", "cambric"), ("cotton lawn", "lawn"),
    ("lawn cotton", "lawn"), ("polyester chiffon", "chiffon"), ("silk chiffon", "chiffon"), ("silk blend", "silk"), ("polyester zari", "polyester"), ("zari stripe", "polyester"),
]
#: What stands after `Color:` without being a colour.
NO_COLOR = ["digital printed", "digital print", "printed", "embroidered", "plain", "self", "screen print", "screen printed", "block print", "block printed", "yarn dyed", "woven"]
NO_COLOR_WORDS = ["printed", "digital", "embroidered", "plain", "solid", "self", "dyed", "print"]
#: What ends the text after a label; listings mark sections by these.
SECTIONS = "what you|fit:|model|design:|shirt:|trouser:|dupatta:|shawl:|slip:|weight"
STRICT_END = rf"(?=[A-Za-z]+\s*:|$|\.|{SECTIONS}|all fabric)"
LOOSE_END = rf"(?=[a-z]+\s*:|$|\.|{SECTIONS}|material|care|season|occasion|details|cut:)"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def labels(description: Column, name: str, end: str = STRICT_END) -> Column:
    """The values after each `name:`, up to the next label, section or full stop."""
    found = F.regexp_extract_all(description, F.lit(rf"(?i){name}\s*:\s*([A-Za-z0-9 /\-]+?)\s*{end}"), F.lit(1))
    return F.filter(F.transform(found, F.trim), lambda x: x != "")


def tight(text: Column) -> Column:
    """Letters and digits alone, lower-cased."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "), r"\s+"), lambda w: w != "")


def without_fillers(text: Column) -> Column:
    return F.array_join(F.filter(words(text), lambda w: ~w.isin(FILLERS)), "")


def base_fabric(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return tight(F.coalesce(*(F.when(F.contains(low, F.lit(name)), F.lit(base)) for name, base in SAME_FABRIC), low))


def either_holds(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def issue(severity: str | Column, kind: str, when: Column, *detail: Column | str) -> Column:
    parts = [F.coalesce(d.cast("string"), F.lit("")) if isinstance(d, Column) else F.lit(d) for d in detail]
    made = F.struct((F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(kind).alias("type"), F.concat(*parts).alias("detail"))
    return F.when(F.coalesce(when, F.lit(False)), made)


def _list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def fabric_issue() -> Column:
    """Hard if no label has the field's fabric, by name, base fabric or without fillers; soft if the first label that does so needs
    the fillers left out."""
    field, said = F.trim(_text("fabric")), labels(_text("description"), "Fabric")
    bare, base, short = tight(field), base_fabric(field), without_fillers(field)
    same = lambda x: either_holds(bare, tight(x)) | either_holds(base, base_fabric(x))
    near = lambda x: (short != "") & (without_fillers(x) != "") & either_holds(short, without_fillers(x))
    verdict = F.when(F.size(said) > 0, F.coalesce(F.try_element_at(F.array_compact(F.transform(said, lambda x: F.when(same(x), "same").when(near(x), "near"))), F.lit(1)), F.lit("other")))
    severity = F.when(verdict == "near", "soft").otherwise("hard")
    return issue(severity, "FABRIC", (field != "") & verdict.isin("near", "other"), "field '", field, "', description ", _list(said))


def color_issue() -> Column:
    """Soft if neither the last `Color:` label nor one of its longer words is among the stored shades."""
    said = F.try_element_at(labels(_text("description"), "Color"), F.lit(-1))
    shades = F.transform(F.col("exact_colors"), tight)
    full = F.exists(shades, lambda s: either_holds(tight(said), s))
    some = F.exists(F.filter(words(said), lambda w: F.length(w) > 3), lambda w: F.exists(shades, lambda s: either_holds(s, w)))
    known = F.coalesce(F.size("exact_colors") > 0, F.lit(False)) & said.isNotNull() & ~F.lower(said).isin(NO_COLOR) & (F.length(tight(said)) > 2)
    return issue("soft", "COLOR", known & ~full & ~some, "description '", said, "', field ", _list(F.col("exact_colors")))


def pieces_issue() -> Column:
    """Hard if the title, or a structured phrase at the head of the description, gives another number of pieces."""
    told = F.coalesce(rules.pieces_in_title(F.lower(_text("name"))), rules.pieces_in_description(F.lower(_text("description"))))
    return issue("hard", "PIECE_COUNT", (F.col("pieces") > 0) & (told != F.col("pieces")), "field ", F.col("pieces"), ", text ", told)


def _all_text() -> Column:
    return F.lower(F.concat(_text("description"), F.lit(" "), _text("name")))


def stitching_issue() -> Column:
    return issue("hard", "STITCHED_TYPE", (F.col("stitching") == "stitched") & _all_text().rlike(r"\bunstitched\b"), "field 'stitched', text unstitched")


def gender_issue() -> Column:
    text = _all_text()
    women = (F.col("gender") == "women") & text.rlike(r"\bmen'?s\b") & ~text.rlike(r"\bwomen")
    men = (F.col("gender") == "men") & text.rlike(r"\bwomen\b|\bladies\b")
    return issue("soft", "GENDER", women | men, "field '", F.col("gender"), "', text says otherwise")


def consistency() -> Column:
    """array<ISSUE> of a listing's fields against its text."""
    return F.array_compact(F.array(fabric_issue(), color_issue(), pieces_issue(), stitching_issue(), gender_issue()))


def needs_repair(issues: str | Column = "issues") -> Column:
    return F.exists(issues, lambda i: i["severity"] == "hard")


def structured_pieces(text: Column) -> Column:
    counted = [F.regexp_extract(text, p, 1).try_cast("int") for p in (r"\bunstitched\s+([1-4])\s*[- ]?\s*(?:pc|pcs|piece|pieces)\b", r"\b([1-4])\s*[- ]?\s*(?:pc|pcs|piece|pieces)\s+(?:outfit|suit|stitched|unstitched)\b")]
    return F.coalesce(*counted, rules.pieces_in_title(text))


def overlap() -> Column:
    """array<ISSUE> of a stored listing, by words that field and text share; none of these is hard or soft by itself ("audit")."""
    desc, name = F.lower(_text("description")), F.lower(_text("name"))
    letters = lambda t: F.filter(F.split(F.lower(t), "[^a-z]+"), lambda w: w != "")
    field, fabrics = F.trim(_text("fabric")), labels(desc, "fabric", LOOSE_END)
    shared = F.exists(fabrics, lambda f: F.arrays_overlap(letters(f), letters(field)) | either_holds(tight(f), tight(field)))
    fabric = issue("audit", "FABRIC", (field != "") & (F.size(fabrics) > 0) & ~shared, "field '", field, "', label ", _list(fabrics))
    told = F.coalesce(structured_pieces(name), structured_pieces(F.substring(desc, 1, 120)))
    pieces = issue("audit", "PIECE_COUNT", (F.col("pieces") > 0) & (told != F.col("pieces")), "field ", F.col("pieces"), ", text ", told)
    raw = F.concat(name, F.lit(" "), desc)
    stitched = issue("audit", "STITCHED_TYPE", (F.col("stitching") == "stitched") & (raw.rlike(r"\bunstitched\b") | name.rlike(r"\brts\b")), "field 'stitched', text unstitched")
    gender = issue("audit", "GENDER", (F.col("gender") == "women") & raw.rlike(r"\bmen'?s\b") & ~raw.rlike(r"\bwomen"), "field 'women', text men's")
    said = F.try_element_at(labels(desc, "colou?r", LOOSE_END), F.lit(-1))
    family = color.infer(said)["primary"]
    fields = F.array_compact(F.concat(F.coalesce(F.col("colors"), F.array().cast("array<string>")), F.array("primary_color")))
    print_only = F.forall(letters(said), lambda w: w.isin(NO_COLOR_WORDS))
    tone = issue("audit", "COLOR", said.isNotNull() & ~print_only & (family != "Multicolor") & ~F.array_contains(fields, family), "label '", said, "' (", family, "), field ", F.col("primary_color"))
    return F.array_compact(F.array(fabric, pieces, stitched, gender, tone))


def shoe_gender() -> Column:
    """array<ISSUE> of shoes: women's by the field, men's or children's by the name or by tags that aren't codes."""
    clean = F.filter(F.coalesce(F.col("tags"), F.array().cast("array<string>")), lambda t: ~t.rlike(r"(?i)\d|size|chart|guide|care|wash|dhldes|desc"))
    text = F.lower(F.concat(_text("name"), F.lit(" "), F.array_join(clean, " ")))
    mine = (F.col("gender") == "women") & ~text.rlike(r"\b(women|womens|ladies)\b")
    men = issue("audit", "GENDER", mine & text.rlike(r"\b(men|mens|men's|gents)\b"), "field 'women', text men's")
    kids = issue("audit", "GENDER", mine & text.rlike(r"\b(girls?|boys?|kids?|child|junior|toddler)\b"), "field 'women', text children's")
    return F.array_compact(F.array(men, kids))


def audited(df: DataFrame, key: str, check: Callable[[], Column] = consistency) -> DataFrame:
    """(key, severity, type, detail): a row for each issue. Rules cost far more than a row's move: rows are dealt to all cores first,
    for a table may lie in one small file, which one task would read."""
    return _dealt(df, key).select(key, F.inline(check()))


def _dealt(df: DataFrame, key: str) -> DataFrame:
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, key)


def rates(df: DataFrame, check: Callable[[], Column] = consistency) -> DataFrame:
    """(severity, type, n, share) of the listings that have an issue, in one pass."""
    found = df.select(check().alias("issues"))
    total = found.agg(F.count(F.lit(1)).alias("total"))  # one row
    counts = found.select(F.inline("issues")).groupBy("severity", "type").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("severity", "type", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))
