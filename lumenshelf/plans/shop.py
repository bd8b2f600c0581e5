"""Queries over probes, audits and what else a shop's catalog needs, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, evaluate, extras, filters, ingest, intents, outfits, probes, search, smoke
from ..session import shared_folder
from ..sources import brands, selectors
from ..streaming import worker
from .catalog import HARD, INTENT, ORACLE_SQL, PAIRS, QUERIES, SOFT, query, with_products
from .products import products, table

__all__ = ["ORACLE_SQL", "QUERIES"]  # all queries, those of `catalog` included

# --- relaxation --------------------------------------------------------------------------------------------------------

NAMES = filters.given(INTENT)
MISSES = {**SOFT, "color_exact": "list_contains([lower(split_part(name, ' ', 1))], 'red')", "color_family": SOFT["color"]}


@query(
    with_products(
        f""", facts AS (SELECT price, {' + '.join(f"CASE WHEN coalesce({MISSES[c]}, false) THEN 0 ELSE {1 << i} END" for i, c in enumerate(NAMES))} AS missed FROM products WHERE {HARD} AND sub_category NOT IN ('dupatta', 'scarves', 'jewelry', 'bags')),
sums AS (SELECT mask, count(*) FILTER (price <= {INTENT.max_budget}) AS n, count(*) AS lifted, min(price) AS cheapest FROM range({1 << len(NAMES)}) r(mask) JOIN facts ON missed & ~mask = 0 GROUP BY mask)
SELECT mask::INT AS mask, array_to_string(list_filter([{', '.join(f"CASE WHEN mask & {1 << i} <> 0 THEN '{c}' END" for i, c in enumerate(NAMES))}], lambda x: x IS NOT NULL), ',') AS dropped, n, lifted, cheapest FROM sums"""
    )
)
def relax_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of dropped constraints: matches, matches at any price, lowest price."""
    return probes.probes(products(spark, sf_dir), INTENT).withColumn("dropped", F.array_join("dropped", ","))


# --- audit -------------------------------------------------------------------------------------------------------------


def labelled_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as listings whose descriptions carry labels, of which some agree with the fields and some don't."""
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda c, *values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (c % len(values) + 1).cast("int"))
    first = F.split("p_name", " ")[0]
    count = (k % 3 + 1).cast("string")
    fabric = F.concat(F.lit("Fabric: "), pick(k, "Lawn", "Yarn Dyed Silk", "Silk Chiffon", "Raw Silk", "Premium Lawn", None), F.lit(". "))
    tone = F.when(k % 4 == 0, F.concat(F.lit("Color: "), F.initcap(first))).otherwise(pick(k, None, "Color: Peacock Blue", "Color: Digital Printed", "Color: Pink. Color: Candlelight Red"))
    head = F.when(k % 5 == 0, F.concat(F.lit("Unstitched "), count, F.lit("-Piece. "))).when(k % 5 == 1, F.concat(count, F.lit(" Pc Outfit. "))).otherwise(F.lit("1 Pc Embroidered Front. "))
    whom = F.when(k % 11 == 0, " Men's kurta").when(k % 13 == 0, " For ladies").otherwise("")
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        F.when(k % 7 == 0, F.concat("p_name", F.lit(" "), count, F.lit("-Piece"))).otherwise(F.col("p_name")).alias("name"),
        F.concat(head, F.coalesce(fabric, F.lit("")), tone, F.lit("."), whom).alias("description"),
        pick(size, "Lawn", "Cotton Lawn", "Yarn Silk", "Chiffon", None).alias("fabric"),
        F.array(F.lower(first)).alias("exact_colors"),
        F.array(F.initcap(first)).alias("colors"),
        F.initcap(first).alias("primary_color"),
        (size % 3 + 1).alias("pieces"),
        F.when(size % 3 == 0, "unstitched").otherwise("stitched").alias("stitching"),
        F.when(size % 4 == 0, "men").when(size % 4 == 1, "kids").otherwise("women").alias("gender"),
    )


_BASE = lambda c: f"regexp_replace(CASE {' '.join(f"WHEN contains(lower({c}), '{a}') THEN '{b}'" for a, b in audit.SAME_FABRIC)} ELSE lower({c}) END, '[^a-z0-9]', '', 'g')"
_TIGHT = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
_SHORT = lambda c: f"array_to_string(list_filter(string_split(lower({c}), ' '), lambda w: NOT list_contains({audit.FILLERS}, w)), '')"
_HOLDS = lambda a, b: f"(contains({a}, {b}) OR contains({b}, {a}))"

LISTINGS = f"""WITH l AS (
  SELECT p_partkey AS id, lower(split_part(p_name, ' ', 1)) AS shade, p_size % 3 + 1 AS pieces, ['Lawn', 'Cotton Lawn', 'Yarn Silk', 'Chiffon', NULL][p_size % 5 + 1] AS fabric,
    CASE WHEN p_size % 3 = 0 THEN 'unstitched' ELSE 'stitched' END AS stitching, CASE p_size % 4 WHEN 0 THEN 'men' WHEN 1 THEN 'kids' ELSE 'women' END AS gender,
    p_name || CASE WHEN p_partkey % 7 = 0 THEN ' ' || (p_partkey % 3 + 1) || '-Piece' ELSE '' END AS name,
    CASE p_partkey % 5 WHEN 0 THEN 'Unstitched ' || (p_partkey % 3 + 1) || '-Piece. ' WHEN 1 THEN (p_partkey % 3 + 1) || ' Pc Outfit. ' ELSE '1 Pc Embroidered Front. ' END
    || coalesce('Fabric: ' || ['Lawn', 'Yarn Dyed Silk', 'Silk Chiffon', 'Raw Silk', 'Premium Lawn', NULL][p_partkey % 6 + 1] || '. ', '')
    || CASE p_partkey % 4 WHEN 0 THEN 'Color: ' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] WHEN 1 THEN 'Color: Peacock Blue' WHEN 2 THEN 'Color: Digital Printed' ELSE 'Color: Pink. Color: Candlelight Red' END
    || '.' || CASE WHEN p_partkey % 11 = 0 THEN ' Men''s kurta' WHEN p_partkey % 13 = 0 THEN ' For ladies' ELSE '' END AS description FROM part),
t AS (
  SELECT *, nullif(trim(regexp_extract(description, 'Fabric: ([A-Za-z ]+)\\.', 1)), '') AS said, trim(list_extract(regexp_extract_all(description, 'Color: ([A-Za-z ]+)\\.', 1), -1)) AS tone,
    lower(description || ' ' || name) AS whole,
    coalesce(nullif(regexp_extract(lower(name), '([1-4])-piece', 1), ''), nullif(regexp_extract(lower(description), 'unstitched ([1-4])-piece', 1), ''), nullif(regexp_extract(lower(description), '([1-4]) pc outfit', 1), ''))::INT AS told,
    coalesce(nullif(regexp_extract(lower(name), '([1-4])-piece', 1), ''), nullif(regexp_extract(lower(description), '([1-4])(-piece| pc)', 1), ''))::INT AS any_told FROM l)"""


@query(f"""{LISTINGS}
SELECT id, CASE WHEN {_HOLDS(_TIGHT('fabric'), _TIGHT('said'))} OR {_HOLDS(_BASE('fabric'), _BASE('said'))} THEN NULL WHEN {_HOLDS(_SHORT('fabric'), _SHORT('said'))} THEN 'soft' ELSE 'hard' END AS severity, 'FABRIC' AS type FROM t
WHERE fabric IS NOT NULL AND said IS NOT NULL AND severity IS NOT NULL
UNION ALL SELECT id, 'soft', 'COLOR' FROM t WHERE NOT list_contains({audit.NO_COLOR}, lower(tone)) AND length(tone) > 2 AND NOT {_HOLDS(_TIGHT('tone'), 'shade')}
  AND len(list_filter(string_split(lower(tone), ' '), lambda w: length(w) > 3 AND {_HOLDS('shade', 'w')})) = 0
UNION ALL SELECT id, 'hard', 'PIECE_COUNT' FROM t WHERE told <> pieces
UNION ALL SELECT id, 'hard', 'STITCHED_TYPE' FROM t WHERE stitching = 'stitched' AND regexp_matches(whole, '\\bunstitched\\b')
UNION ALL SELECT id, 'soft', 'GENDER' FROM t WHERE (gender = 'women' AND regexp_matches(whole, '\\bmen''?s\\b') AND NOT regexp_matches(whole, '\\bwomen')) OR (gender = 'men' AND regexp_matches(whole, '\\bwomen\\b|\\bladies\\b'))""")
def audit_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(labelled_listings(spark, sf_dir), "id").select("id", "severity", "type")


_FAMILY = "CASE WHEN contains(lower(tone), 'red') THEN 'Red' WHEN contains(lower(tone), 'peacock') THEN 'Teal' WHEN contains(lower(tone), 'blue') THEN 'Blue' END"


@query(f"""{LISTINGS}
SELECT id, 'FABRIC' AS type FROM t WHERE fabric IS NOT NULL AND said IS NOT NULL AND NOT list_has_any(string_split(lower(fabric), ' '), string_split(lower(said), ' ')) AND NOT {_HOLDS(_TIGHT('fabric'), _TIGHT('said'))}
UNION ALL SELECT id, 'PIECE_COUNT' FROM t WHERE any_told <> pieces
UNION ALL SELECT id, 'STITCHED_TYPE' FROM t WHERE stitching = 'stitched' AND regexp_matches(whole, '\\bunstitched\\b')
UNION ALL SELECT id, 'GENDER' FROM t WHERE gender = 'women' AND regexp_matches(whole, '\\bmen''?s\\b') AND NOT regexp_matches(whole, '\\bwomen')
UNION ALL SELECT id, 'COLOR' FROM t WHERE lower(tone) <> 'digital printed' AND {_FAMILY} IS NOT NULL AND lower({_FAMILY}) <> shade""")
def audit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(labelled_listings(spark, sf_dir), "id", audit.overlap).select("id", "type")


# --- events that are worked on once -----------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 7 = 6 THEN NULL ELSE event_id % 4 END AS f, CASE WHEN event_id % 7 = 6 THEN 3 ELSE least(event_id % 4 + 1, 3) END AS n FROM events),
a AS (SELECT *, unnest(range(1, n + 1)) AS attempt FROM e)
SELECT event_id, attempt::INT AS attempt, ts + to_microseconds((100000 * (pow(2, attempt - 1) - 1))::BIGINT) AS due, coalesce(attempt > f, false) AS ok,
CASE WHEN coalesce(attempt > f, false) THEN 'stored' WHEN attempt = 3 THEN 'dead' ELSE 'retry' END AS outcome FROM a""")
def retry_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which some fail a few times, and some each time."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 7 != 6, F.col("event_id") % 4).alias("failures"))
    return worker.attempts(e, "event_id", "ts", "failures").withColumn("due", F.col("due").cast("timestamp_ntz"))


@query("""WITH r AS (SELECT user_id, ts, event_type <> 'error' AS ok, event_type, row_number() OVER w AS k, count(*) FILTER (event_type <> 'error') OVER p AS good, count(*) FILTER (event_type = 'error') OVER p AS bad
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts), p AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT user_id, count(*)::INT AS tries, arg_max(ok, ts) AS ok, max(ts) AS last, arg_max(event_type, ts) AS error FROM r WHERE good = 0 AND bad < 3 GROUP BY user_id)
SELECT user_id, tries, CASE WHEN ok THEN 'done' WHEN tries >= 3 THEN 'dead' ELSE 'waiting' END AS status, CASE WHEN NOT ok AND tries < 3 THEN last + to_microseconds((100000 * pow(2, tries - 1))::BIGINT) END AS next_at,
CASE WHEN NOT ok AND tries >= 3 THEN 'store failed after 3 attempts: ' || error END AS reason FROM c""")
def retry_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as attempts at one thing."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", (F.col("event_type") != "error").alias("ok"), "event_type")
    return worker.settle(e, "user_id", "ts", "ok", "event_type").withColumn("next_at", F.col("next_at").cast("timestamp_ntz"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 AND event_id % 10 <> 0 THEN 'pending' ELSE 'done' END AS status, CASE WHEN event_id % 10 = 0 THEN 0 ELSE event_id % 3 END AS batch,
value < 50 AS low FROM events""")
def ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of events, with some that came in an earlier one and one batch that comes again; the last one is never completed."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    ledger = worker.Ledger(spark, shared_folder(spark, "ledger"))
    decide = lambda rows: rows.withColumn("low", F.col("value") < 50)
    for batch in (0, 1, 1, 2):
        rows = ledger.begin(e.where((F.col("event_id") % 3 == batch) | (F.col("event_id") % 10 == 0)), batch, decide)
        if rows is not None and batch < 2:
            ledger.complete(batch)
    return ledger.status().select("event_id", "status", F.col("batch").cast("long").alias("batch"), "low")


# --- sources ---------------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT p_brand, 'https://shop' || regexp_replace(p_brand, '[^0-9]', '', 'g') || '.example' AS base, CASE WHEN hash_of % 2 = 0 THEN 'shoes' ELSE 'clothing' END AS category
  FROM (SELECT DISTINCT p_brand, regexp_replace(p_brand, '[^0-9]', '', 'g')::INT AS hash_of FROM part)),
c AS (SELECT *, base || '/collections/' || path AS url, gender FROM d, (VALUES ('new', 'women'), ('sale', 'men')) v(path, gender))
SELECT p_partkey, c.url, c.gender FROM part JOIN c USING (p_brand) WHERE lower(p_brand) IN ('brand#3', 'brand#7', 'brand#12') AND category = 'clothing'""")
def brand_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over some brands: listings stored by brand, joined with the stored dimension of their collections."""
    part = table(spark, sf_dir, "part")
    number = F.regexp_replace("p_brand", "[^0-9]", "")
    none = F.array().cast("array<string>")
    shelves = F.array(*(F.struct(F.lit(f"/collections/{p}").alias("path"), F.lit(None).cast("string").alias("sub_category"), none.alias("occasion"), none.alias("style"), F.lit(g).alias("gender")) for p, g in (("new", "women"), ("sale", "men"))))
    config = part.select("p_brand").distinct().select(F.col("p_brand").alias("brand"), F.concat(F.lit("https://shop"), number, F.lit(".example/")).alias("base_url"), F.lit("A").alias("adapter"), F.when(number.cast("int") % 2 == 0, "shoes").otherwise("clothing").alias("category"), shelves.alias("collections"))
    root = shared_folder(spark, "brands")
    brands.store_dimension(brands.collections(config), f"{root}/dimension")
    brands.store_listings(part, f"{root}/listings", "p_brand")
    return brands.run(spark, f"{root}/listings", f"{root}/dimension", "Brand#3, brand#7,BRAND#12, brand#4", "clothing").select("p_partkey", "url", "gender")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as saved listing pages of 24 cards, in three themes; one page in five has no cards."""
    k = F.col("p_partkey")
    theme = F.floor(k / 24) % 5
    href = F.concat(F.lit("/products/"), k.cast("string"))
    price = F.concat(F.lit("Rs. "), F.format_number("p_retailprice", 2))
    card = (
        F.when(theme == 0, F.format_string('<div class="product-card x"><h2><a href="%s">%s</a></h2><img src="/blank.gif"><img class="product-image" src="//cdn.example/%s_{width}.jpg"><p class="price"><span class="money">%s</span></div>', href, "p_name", k, price))
        .when(theme == 1, F.format_string('<li class="item product"><a class="product-name" href="https://b.example%s">%s<br></a><img data-src="/i/product%s.png"><span class="price-item--sale">%s</span>', href, "p_name", k, price))
        .when(theme == 2, F.format_string('<a href="%s"><span data-product-id="1"><b class="name">%s</b><img src="https://cdn.shopify/%s.jpg"><i class="now-price">%s</i></span></a>', href, "p_name", k, price))
        .otherwise(F.concat(F.lit("<p>"), "p_name", F.lit("</p>")))
    )
    rows = table(spark, sf_dir, "part").select(F.floor(k / 24).alias("page"), F.struct(k.alias("k"), card.alias("c")).alias("card"))
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list("card")).alias("cards"))  # 24 a page
    return pages.select(F.concat(F.lit("https://a.example/list/"), F.col("page").cast("string")).alias("url"), F.concat(F.lit("<!DOCTYPE html><html><body><ul>"), F.array_join(F.transform("cards", lambda c: c["c"]), "\n"), F.lit("</ul></body>")).alias("html"))


@query("""WITH p AS (SELECT *, p_partkey // 24 AS page, (p_partkey // 24) % 5 AS theme, count(*) OVER (PARTITION BY p_partkey // 24) AS n FROM part)
SELECT 'https://a.example/list/' || page AS page, row_number() OVER (PARTITION BY page ORDER BY p_partkey)::INT AS position, p_name AS title, CASE theme WHEN 0 THEN 'https://cdn.example/' || p_partkey || '_600.jpg' WHEN 1 THEN 'https://a.example/i/product' || p_partkey || '.png' ELSE 'https://cdn.shopify/' || p_partkey || '.jpg' END AS image_url,
CASE WHEN theme = 1 THEN 'https://b.example' ELSE 'https://a.example' END || '/products/' || p_partkey AS product_url, round(p_retailprice)::BIGINT AS price FROM p WHERE theme < 3 AND n >= 2""")
def selector_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of saved listing pages, by the first container selector that fits each page."""
    return selectors.cards(listing_pages(spark, sf_dir), most=None).select("page", "position", "title", "image_url", "product_url", "price")


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` with what a product page has besides: JSON-LD of several forms, a stock notice, sizes, a description."""
    k = F.col("page_id")
    word = F.when(k % 2 == 0, "InStock").otherwise("SoldOut")
    offer = F.concat(F.lit('{"availability": "https://schema.org/'), word, F.lit('"}'))
    ld = (
        F.when(k % 6 == 0, F.concat(F.lit('{"@type": "Product", "offers": '), offer, F.lit("}")))
        .when(k % 6 == 1, F.concat(F.lit('{"@graph": [{"@type": "WebSite"}, {"offers": ['), offer, F.lit("]}]}")))
        .when(k % 6 == 2, F.concat(F.lit('[{"offers": '), offer, F.lit('}, {"name": "x"}]')))
        .when(k % 6 == 3, F.lit('{"offers": {broken'))
        .otherwise(F.lit('{"@type": "Product"}'))
    )
    notice = F.when(k % 4 == 3, "<div class='availability'><b>Item is currently Out of Stock</b></div>").otherwise("")
    box = F.concat(F.lit("<div class='description-and-detail'><p>"), F.lit("Page <b>"), k.cast("string"), F.lit("</b><div>deep</div></div>"))
    sizes = F.concat(F.lit("<div class='size-item'><input id='m'><input data-attr-value='"), (k % 90 + 10).cast("string"), F.lit("'><input id='3PC'><input id='M'></div>"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit("<script type='application/ld+json'>"), ld, F.lit("</script>"), notice, box, sizes).alias("html"))


@query("""SELECT page_id, CASE WHEN page_id % 6 IN (0, 1, 2) THEN page_id % 2 = 0 WHEN page_id % 4 = 3 THEN false END AS available, 'Page ' || page_id || ' deep' AS description, 'M,' || (page_id % 90 + 10) AS sizes FROM pages""")
def product_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = selectors.product_pages(detail_pages(spark, sf_dir))
    return read.select("page_id", "available", F.regexp_replace("description", r"\s+", " ").alias("description"), F.array_join("sizes", ",").alias("sizes"))


# --- outfits ---------------------------------------------------------------------------------------------------------------


def wardrobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as clothes with what the outfit rules read."""
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda c, *values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (c % len(values) + 1).cast("int"))
    sets = F.when(size % 6 == 0, F.array(F.lit("Kameez"), F.lit("Dupatta"))).when(size % 6 == 1, F.array(F.lit("shirt"), F.lit("trouser"))).when(size % 6 == 2, F.array(F.lit("shirt"), F.lit("dupatta"), F.lit("shalwar")))
    occasion = F.when(k % 4 == 0, F.array(F.lit("party"), F.lit("Eid"))).when(k % 4 == 1, F.array(F.lit("casual"))).when(k % 4 == 2, F.array(F.lit("eid"), F.lit("casual")))
    return table(spark, sf_dir, "part").select(
        k.alias("id"), "p_name", F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.initcap(F.split("p_name", " ")[0]).alias("primary_color"), occasion.alias("occasion"), sets.alias("includes"),
        pick(size, "dupatta", "pants", "shalwar", "suit", "kurta", "western", None).alias("sub_category"), pick(size, "top", "trouser", "kurta", None).alias("dress_style"),
        F.when(size % 5 == 0, "western").when(size % 5 < 4, "eastern").alias("fashion_type"), F.when(k % 3 == 0, "men").when(k % 3 == 1, "women").when(k % 5 == 0, "unisex").alias("gender"), pick(size, "1-piece", "2-piece", "3-piece").alias("pieces"),
    )


WARDROBE = """WITH w AS (SELECT p_partkey AS id, p_name AS name, p_retailprice AS price, split_part(p_name, ' ', 1) AS tone, CASE p_size % 6 WHEN 0 THEN ['kameez', 'dupatta'] WHEN 1 THEN ['shirt', 'trouser'] WHEN 2 THEN ['shirt', 'dupatta', 'shalwar'] ELSE [] END AS has,
  CASE p_partkey % 4 WHEN 0 THEN ['party', 'eid'] WHEN 1 THEN ['casual'] WHEN 2 THEN ['eid', 'casual'] ELSE [] END AS occ, coalesce(['dupatta', 'pants', 'shalwar', 'suit', 'kurta', 'western', NULL][p_size % 7 + 1], '') AS sub, coalesce(['top', 'trouser', 'kurta', NULL][p_size % 4 + 1], '') AS style,
  p_size % 5 = 0 AS western, CASE WHEN p_partkey % 3 = 0 THEN 'men' WHEN p_partkey % 3 = 1 THEN 'women' WHEN p_partkey % 5 = 0 THEN 'unisex' ELSE 'women' END AS gender, ['1-piece', '2-piece', '3-piece'][p_size % 3 + 1] AS pieces FROM part),
h AS (SELECT id AS hero_id, price AS hero_price, tone AS hero_tone, occ AS hero_occ, gender AS hero_gender, unnest(list_filter([
  CASE WHEN western AND gender = 'women' AND (style IN ('top', 't-shirt', 'polo') OR contains(sub, 'western') OR regexp_matches(name, 'top|tee|shirt')) THEN {'turn': 0, 'slot': 'western_bottom', 'role': 'bottom', 'pool': 'w', 'most': 2} END,
  CASE WHEN NOT western AND pieces = '2-piece' AND NOT list_contains(has, 'dupatta') THEN {'turn': 1, 'slot': 'dupatta_two', 'role': 'dupatta', 'pool': 'd', 'most': 2} END,
  CASE WHEN NOT western AND list_has_any(has, ['shirt', 'kameez']) AND list_contains(has, 'dupatta') AND NOT list_has_any(has, ['trouser', 'shalwar']) THEN {'turn': 2, 'slot': 'bottom_set', 'role': 'bottom', 'pool': 't', 'most': 2} END,
  CASE WHEN NOT western AND (pieces = '1-piece' OR sub = 'kurta') THEN {'turn': 3, 'slot': 'dupatta_one', 'role': 'dupatta', 'pool': 'd', 'most': 1} END,
  CASE WHEN NOT western AND (pieces = '1-piece' OR sub = 'kurta') THEN {'turn': 4, 'slot': 'bottom_one', 'role': 'bottom', 'pool': 'b', 'most': 1} END], lambda x: x IS NOT NULL)) AS s FROM w WHERE id % 50 = 0),
m AS (SELECT hero_id, s.turn AS turn, s.slot AS slot, s.role AS role, s.most AS most, id, 2 * list_has_any(occ, hero_occ)::INT + (tone = hero_tone)::INT AS score FROM h JOIN w ON id <> hero_id AND gender IN (hero_gender, 'unisex') AND price <= round(hero_price * 1.4)
  AND CASE s.pool WHEN 'w' THEN style = 'trouser' OR sub = 'western' OR regexp_matches(name, 'jean|denim|trouser|pant') WHEN 'd' THEN sub = 'dupatta' WHEN 't' THEN sub IN ('pants', 'shalwar') OR style = 'trouser' ELSE sub IN ('pants', 'shalwar') END),
r AS (SELECT *, row_number() OVER (PARTITION BY hero_id, turn ORDER BY score DESC, id) AS k FROM m), p AS (SELECT *, row_number() OVER (PARTITION BY hero_id ORDER BY turn, k) AS place FROM r WHERE k <= most)
SELECT hero_id, place::INT AS place, role, slot, id, score FROM p WHERE place <= 5"""


@query(WARDROBE)
def outfit_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    clothes = wardrobe(spark, sf_dir)
    return outfits.complete(clothes, clothes.where("id % 50 = 0"), "id").select("hero_id", "place", "role", "slot", "id", "score")


# --- accessories, pools, smoke checks -------------------------------------------------------------------------------------


def trinkets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`part` as accessories."""
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda c, *values: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (c % len(values) + 1).cast("int"))
    occasion = F.when(k % 4 == 0, F.array(F.lit("party"), F.lit("eid"))).when(k % 4 == 1, F.array(F.lit("casual"))).when(k % 4 == 2, F.array().cast("array<string>"))
    shade = F.initcap(F.split("p_name", " ")[0])
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.when(shade.isin("Red", "Blue"), shade).otherwise("Multicolor").alias("primary_color"), F.lit(None).cast("array<string>").alias("colors"), occasion.alias("occasion"),
        (size % 10 != 0).alias("in_stock"), F.when(k % 3 == 0, "men").when(k % 3 == 1, "women").otherwise("unisex").alias("gender"), pick(size, "heel", "flat", "sandal", "sneaker", "khussa", None).alias("shoe_type"),
        pick(size, "jhumka", "stud", "choker", "ring", None).alias("jewelry_type"), pick(size, "ear", "ear", "neck", "hand", None).alias("jewelry_category"), pick(size, "dress", "sports", "digital", None).alias("watch_type"), F.lit(None).cast("string").alias("dial_color"),
        F.col("p_type").alias("type"),
    )


TRINKETS = """WITH w AS (SELECT p_partkey AS id, p_retailprice AS price, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'Red' WHEN 'blue' THEN 'Blue' ELSE 'Multicolor' END AS tone, CASE p_partkey % 4 WHEN 0 THEN ['party', 'eid'] WHEN 1 THEN ['casual'] WHEN 2 THEN []::VARCHAR[] END AS occ, p_size % 10 <> 0 AS stock,
CASE p_partkey % 3 WHEN 0 THEN 'men' WHEN 1 THEN 'women' ELSE 'unisex' END AS gender, ['heel', 'flat', 'sandal', 'sneaker', 'khussa', NULL][p_size % 6 + 1] AS shoe, coalesce(['jhumka', 'stud', 'choker', 'ring', NULL][p_size % 5 + 1], 'other') AS jewel, coalesce(['dress', 'sports', 'digital', NULL][p_size % 4 + 1], '') AS watch, p_type AS type, p_name AS name FROM part)"""


@query(f"""{TRINKETS}, f AS (SELECT *, tone = 'Green' AS c, coalesce(list_has_any(occ, ['eid']), false) OR occ IS NULL OR len(occ) = 0 AS o, coalesce(shoe IN ('heel', 'stiletto', 'block-heel', 'court-shoe', 'pump'), false) AS t FROM w WHERE stock AND gender IN ('women', 'unisex') AND price <= 1000),
s AS (SELECT *, CASE WHEN c AND o AND t THEN 0 WHEN o AND t THEN 1 WHEN t THEN 2 ELSE 3 END AS step FROM f), m AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM s WHERE step = (SELECT min(step) FROM s)),
p AS (SELECT *, CASE WHEN tone IN ('Green', 'Blue') THEN 3 ELSE 0 END + CASE WHEN coalesce(list_contains(occ, 'eid'), false) THEN 2 ELSE 0 END + 1 AS score FROM m WHERE n <= 100),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM p) SELECT id, score::INT AS score, rank, step, ['colour', 'occasion', 'high heels'][step] AS relaxed FROM r WHERE rank <= 30""")
def accessory_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    wish = extras.Wish(kind="high heels", color="Green", families=("Green", "Blue"), occasion=("eid",), gender="women", max_budget=1000)
    return extras.only(trinkets(spark, sf_dir), wish, "shoes", "id").select("id", "score", "rank", "step", "relaxed")


@query(f"""{TRINKETS}, b AS (SELECT * FROM w WHERE stock AND gender IN ('men', 'unisex') AND price <= 1215)
SELECT 'narrow' AS pool, id FROM b WHERE watch IN ('sports') OR (SELECT count(*) FROM b WHERE watch IN ('sports')) < 5 UNION ALL SELECT 'wide', id FROM b WHERE watch IN ('pocket') OR (SELECT count(*) FROM b WHERE watch IN ('pocket')) < 5""")
def accessory_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trinkets(spark, sf_dir)
    of = lambda name, types: extras.pool(rows, "watches", types, "watch_type", "men", 900).select(F.lit(name).alias("pool"), "id")
    return of("narrow", ["sports"]).union(of("wide", ["pocket"]))


@query(f"""{TRINKETS}, pairs(a, b, s) AS (VALUES {PAIRS}), d AS (SELECT id AS dress, tone AS dt, coalesce(occ, []) AS docc FROM w WHERE type = 'LARGE'), j AS (SELECT * FROM w WHERE type = 'PROMO'),
m AS (SELECT dress, id AS item, jewel AS kind, round(round(s * 0.45 + CASE WHEN list_has_any(docc, coalesce(occ, [])) THEN 0.35 ELSE 0.12 END * CASE WHEN jewel IN ('jhumka', 'choker') THEN 1.2 ELSE 1.0 END, 3) * CASE WHEN jewel IN ('jhumka', 'choker') THEN 1.18 WHEN jewel = 'stud' THEN 0.92 ELSE 1.0 END, 3)::DOUBLE AS score
  FROM d, j JOIN pairs ON b = j.tone WHERE a = d.dt),
r AS (SELECT *, row_number() OVER (PARTITION BY dress ORDER BY score DESC, item) AS k FROM m), t AS (SELECT r.*, row_number() OVER (PARTITION BY dress, kind ORDER BY k) AS n FROM r WHERE k > 2),
u AS (SELECT dress, item, kind, score, k FROM r WHERE k <= 2 UNION ALL SELECT dress, item, kind, score, k FROM t WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.dress = t.dress AND r.k <= 2 AND r.kind = t.kind)),
p AS (SELECT *, row_number() OVER (PARTITION BY dress ORDER BY k) AS place FROM u) SELECT dress, item, kind, score, place::INT AS place FROM p WHERE place <= 5""")
def jewelry_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trinkets(spark, sf_dir)
    dresses = rows.where("type = 'LARGE'").withColumnRenamed("id", "dress")
    return extras.jewelry_sets(dresses, rows.where("type = 'PROMO'").withColumnRenamed("id", "item"), "dress", "item", ("wedding",), ("statement_jewelry",))


@query(f"""{TRINKETS}, pairs(a, b, s) AS (VALUES {PAIRS}), m AS (SELECT d.id AS dress, x.id AS item, round(s * 0.45 + CASE WHEN list_has_any(coalesce(x.occ, []), ['casual', 'party']) THEN 0.35 ELSE 0.15 END + CASE WHEN x.watch IN ('sports', 'digital') THEN 0.2 ELSE 0.1 END, 3)::DOUBLE AS score
  FROM w d JOIN w x ON d.type = 'LARGE' AND x.type = 'SMALL' JOIN pairs ON a = d.tone AND b = x.tone)
SELECT dress, item, score FROM (SELECT *, row_number() OVER (PARTITION BY dress ORDER BY score DESC, item) AS k FROM m) WHERE k = 1""")
def watch_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trinkets(spark, sf_dir)
    return extras.watches(rows.where("type = 'LARGE'").withColumnRenamed("id", "dress"), rows.where("type = 'SMALL'").withColumnRenamed("id", "item"), "dress", "item", ("casual", "party"))


@query("""WITH r AS (SELECT p_brand, p_partkey, p_size % 9 = 0 AND substr(p_brand, 7)::INT % 4 <> 3 OR p_size = 50 AS ok, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS spot, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
c AS (SELECT p_brand, max(n) AS n, count(*) FILTER (ok AND spot <= 15) AS a, count(*) FILTER (ok AND spot <= 30) AS b FROM r GROUP BY p_brand),
t AS (SELECT p_brand, CASE WHEN a >= least(3, n) OR n <= 15 THEN 1 WHEN b >= least(3, n) OR n <= 30 THEN 2 ELSE 3 END AS round, n FROM c), p AS (SELECT *, least(n, 15 * (1 << (round - 1)))::INT AS pool FROM t),
k AS (SELECT r.p_brand, p_partkey, round, pool, row_number() OVER (PARTITION BY r.p_brand ORDER BY spot) AS k FROM r JOIN p USING (p_brand) WHERE ok AND spot <= pool) SELECT p_brand, p_partkey, round, pool FROM k WHERE k <= 3""")
def widen_and_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts for each brand, from as few of its dearest as will do."""
    part = table(spark, sf_dir, "part")
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")))
    ok = ((F.col("p_size") % 9 == 0) & (F.substring("p_brand", 7, 3).cast("int") % 4 != 3)) | (F.col("p_size") == 50)
    return search.widen(ranked, "p_brand", "rank", ok, want=3).select("p_brand", "p_partkey", "round", "pool")


@query("""WITH b AS (SELECT *, p_size % 10 <> 0 AS stock FROM part), s AS (
  SELECT 'dear' AS search, * FROM (SELECT p_type AS catalog, stock, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS position FROM b) WHERE position <= 40
  UNION ALL SELECT 'stocked', * FROM (SELECT p_type, stock, row_number() OVER (ORDER BY p_partkey) AS position FROM b WHERE stock) WHERE position <= 10
  UNION ALL SELECT 'none', p_type, stock, 1 FROM b WHERE p_name = 'no such name'),
g AS (SELECT search, count(*) AS n, count(*) FILTER (NOT stock) AS sold_out, arg_min(catalog, position) AS top FROM s GROUP BY search)
SELECT search, 'sold out' AS problem, sold_out || ' returned' AS detail, n AS results FROM g WHERE sold_out > 0
UNION ALL SELECT search, 'wrong catalog', top || ' instead of HATS', n FROM g WHERE search = 'dear'
UNION ALL SELECT 'none', 'no results', '', 0 WHERE NOT EXISTS (SELECT 1 FROM g WHERE search = 'none')""")
def smoke_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", F.col("p_type").alias("catalog"), (F.col("p_size") % 10 != 0).alias("in_stock"))
    placed = lambda df, n, *order: df.orderBy(*order).limit(n).withColumn("position", F.row_number().over(Window.orderBy(*order)))  # noqa: E731  of n rows
    searches = [
        smoke.Search("dear", placed(b, 40, F.desc("p_retailprice"), F.col("p_partkey")), "HATS"),
        smoke.Search("stocked", placed(b.where("in_stock"), 10, F.col("p_partkey"))),
        smoke.Search("none", placed(b.where("p_name = 'no such name'"), 10, F.col("p_partkey")), "SMALL"),
    ]
    return smoke.check(spark, searches)


@query("""SELECT p_partkey FROM part WHERE p_size % 10 <> 0 AND (regexp_matches(p_name, '^red') OR regexp_matches(p_name, 'gear') OR regexp_matches(p_type, '(?i)promo'))""")
def colour_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.initcap(F.split("p_name", " ")[0])
    none = F.lit(None).cast("array<string>")
    rows = table(spark, sf_dir, "part").withColumns({"primary_color": first, "primary_exact_color": F.lower(first), "exact_colors": none, "colors": F.array(first), "name": F.col("p_name"), "tags": F.array("p_type"), "description": F.lit(None).cast("string"), "in_stock": F.col("p_size") % 10 != 0})
    return rows.where(search.colour_or_keyword(["RED"], ["Gear", "promo", "", "zz", "qq", "ring"])).select("p_partkey")


@query("SELECT count(*) AS rows, count(DISTINCT event_id % 1000) AS ids, count(*) - count(DISTINCT event_id % 1000) AS repeated FROM events")
def event_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.copies(table(spark, sf_dir, "events").withColumn("id", F.col("event_id") % 1000), "id")


# --- requests --------------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 7 AS k, conv_id % 3 AS g FROM conversations)
SELECT conv_id, turn, CASE WHEN k = 5 THEN 'shoes' WHEN k = 4 THEN 'watches' ELSE 'clothing' END AS search_catalog, CASE k WHEN 0 THEN 'Red' WHEN 1 THEN 'Teal' WHEN 2 THEN 'Blue' ELSE 'Any' END AS color,
CASE WHEN k = 2 THEN 3 END::INT AS pieces, CASE WHEN g = 1 THEN 'men' WHEN g = 2 THEN 'women' ELSE 'unisex' END AS gender, CASE k WHEN 0 THEN 'saree' WHEN 2 THEN 'kurta' END AS dress_style, CASE WHEN k = 0 THEN 4500.5 ELSE 0 END::DOUBLE AS max_budget,
CASE k WHEN 0 THEN 'occasion,color' WHEN 1 THEN 'color,occasion' WHEN 2 THEN 'fabric,color' WHEN 3 THEN 'print,season,color' ELSE 'occasion' END AS priority FROM c""")
def request_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as messages, each with what a model may have made of it."""
    c = table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 7
    gender = F.when(F.col("conv_id") % 3 == 1, "men").when(F.col("conv_id") % 3 == 2, "kids").otherwise("unisex")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"color": "Red", "occasion": ["wedding"], "piece": "Silk Saree", "maxBudget": 4500.5, "gender": "'), gender, F.lit('"}')))
        .when(k == 1, F.concat(F.lit('{"color": "Any", "shade": "Ferozi", "pieces": 9, "dressStyle": "other", "gender": "'), gender, F.lit('"}')))
        .when(k == 2, F.concat(F.lit('{"color": "dark Blue", "pieces": 3, "dressStyle": "Kurta", "constraintPriority": ["fabric", "Color", "junk", "fabric"], "gender": "'), gender, F.lit('"}')))
        .when(k == 3, F.concat(F.lit('{"maxBudget": "many", "season": "monsoon", "constraintPriority": ["color"], "gender": "'), gender, F.lit('"}')))
        .when(k == 4, F.concat(F.lit('{"searchCatalog": "Watch", "gender": "'), gender, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"gender": "'), gender, F.lit('"}')))
    )
    message = F.concat(F.when(k == 5, "7 heels").otherwise("a dress"), F.when(F.col("conv_id") % 3 == 1, " for my husband").otherwise(""))
    rows = c.select("conv_id", "turn", raw.alias("raw"), message.alias("message"), F.when(k == 3, "embroidery first, then the season").alias("hint"))
    made = intents.intents(rows, hint="hint")
    return made.select("conv_id", "turn", "search_catalog", "color", "pieces", "gender", "dress_style", "max_budget", F.array_join("priority", ",").alias("priority"))


# --- profiles and alerts ---------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT p_retailprice AS median FROM (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice) - 1 AS i, count(*) OVER () AS n FROM part WHERE p_retailprice > 0) WHERE i = n // 2),
c AS (SELECT count(*) AS rows, count(DISTINCT p_brand) AS brands, count(*) FILTER (p_size % 10 <> 0) AS stock, count(*) FILTER (p_retailprice < median * 0.1 OR p_retailprice > median * 10) AS odd, count(*) FILTER (length(p_name) < 8) AS short FROM part, m),
d AS (SELECT count(*) AS n FROM (SELECT 1 FROM part GROUP BY p_brand, lower(trim(p_name)) HAVING count(*) > 1))
SELECT unnest([{'measure': 'rows', 'n': rows, 'share': NULL::DOUBLE}, {'measure': 'brands', 'n': brands, 'share': NULL}, {'measure': 'in stock', 'n': stock, 'share': round(stock / rows, 4)}, {'measure': 'no price', 'n': 0, 'share': 0.0}, {'measure': 'odd price', 'n': odd, 'share': round(odd / rows, 4)},
  {'measure': 'short name', 'n': short, 'share': round(short / rows, 4)}, {'measure': 'repeated names', 'n': d.n, 'share': NULL}], recursive := true) FROM c, d""")
def catalog_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("in_stock", F.col("p_size") % 10 != 0)
    return evaluate.profile(part, {"short name": F.length("p_name") < 8}, "p_retailprice", "p_brand", "p_name")


@query("""SELECT p_brand, count(*) AS n, count(*) FILTER (length(p_name) < 8) AS short, count(*) FILTER (p_size % 10 = 0) AS sold_out, round((count(*) FILTER (length(p_name) < 8) + count(*) FILTER (p_size % 10 = 0)) / count(*), 4) AS share
FROM part GROUP BY p_brand ORDER BY (count(*) FILTER (length(p_name) < 8) + count(*) FILTER (p_size % 10 = 0)) / count(*) DESC, p_brand LIMIT 5""")
def worst_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.worst_groups(table(spark, sf_dir, "part"), "p_brand", {"short": F.length("p_name") < 8, "sold_out": F.col("p_size") % 10 == 0})


@query("SELECT event_type, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY) AS last_week FROM events GROUP BY event_type")
def recent_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), evaluate.recent(e, "ts", "2024-01-20").alias("last_week"))


RATES = """WITH r AS (SELECT time_bucket(INTERVAL 12 HOURS, ts) AS start, event_type, count(*) AS n, round(count(*) / 43200, 6) AS per_second, round(count(*) FILTER (value > 60) / count(*), 4) AS share FROM events GROUP BY ALL)"""


@query(RATES + " SELECT * FROM r")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = evaluate.rates(table(spark, sf_dir, "events"), "ts", "12 hours", ["event_type"], F.col("value") > 60)
    return rated.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(RATES + """, a AS (SELECT *, min(share) OVER w AS least, count(*) OVER w AS seen FROM r WINDOW w AS (PARTITION BY event_type ORDER BY start ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) SELECT event_type, start, share FROM a WHERE least > 0.3 AND seen = 2""")
def rate_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = evaluate.rates(table(spark, sf_dir, "events"), "ts", "12 hours", ["event_type"], F.col("value") > 60)
    return evaluate.alerts(rated, 0.3).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH b AS (SELECT p_brand, p_size, substr(p_brand, 7)::INT AS k, CASE WHEN p_size % 5 > 0 THEN 'x' ELSE '' END AS image FROM part), a AS (SELECT p_brand, CASE WHEN k % 4 = 1 AND p_size % 3 > 0 THEN NULL ELSE image END AS image FROM b WHERE p_size > CASE WHEN k % 4 = 0 THEN 30 ELSE 2 END),
x AS (SELECT p_brand, count(*) AS before, round(count(*) FILTER (image <> '') / count(*), 4) AS images_before FROM b GROUP BY p_brand), y AS (SELECT p_brand, count(*) AS after, round(count(*) FILTER (image <> '') / count(*), 4) AS images_after FROM a GROUP BY p_brand)
SELECT p_brand, before, images_before, coalesce(after, 0) AS after, coalesce(images_after, 0) AS images_after, before >= 20 AND coalesce(after, 0) < 0.5 * before AS few, before >= 20 AND coalesce(after, 0) > 0 AND coalesce(images_after, 0) < 0.5 * images_before AS bare FROM x LEFT JOIN y USING (p_brand)""")
def refresh_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("p_brand", 7, 3).cast("int")
    before = table(spark, sf_dir, "part").select("p_brand", "p_size", F.when(F.col("p_size") % 5 > 0, "x").otherwise("").alias("image"))
    after = before.where(F.col("p_size") > F.when(k % 4 == 0, 30).otherwise(2)).withColumn("image", F.when((k % 4 == 1) & (F.col("p_size") % 3 > 0), None).otherwise(F.col("image")))
    return ingest.drop_report(before, after, "p_brand", "image")
