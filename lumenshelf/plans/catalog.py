"""Queries over the catalog operators, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color, rules, text, vector
from ..operators import evaluate, filters, ingest, recommend, search
from ..streaming import events as E
from .products import SQL, products, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def with_products(sql: str) -> str:
    return f"WITH {SQL}\n{sql}"


# --- vectors -----------------------------------------------------------------------------------------------------------

COSINE = "list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))"


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


@query(f"SELECT e.vec_id, round({COSINE}, 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.vector_scan(e, query_vector(spark, sf_dir), "vec_id").select("vec_id", "score")


@query(f"""SELECT vec_id, round({COSINE}, 4) AS score FROM (SELECT vec_id, embedding[1:16] AS embedding FROM embeddings) e,
(SELECT embedding[1:16] AS embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20""")
def vector_prefix_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", vector.prefix("embedding", 16).alias("embedding"))
    return search.vector_scan(e, query_vector(spark, sf_dir)[:16], "vec_id").select("vec_id", "score")


HYBRID = f"""WITH scored AS (SELECT e.vec_id, round(0.5 * {COSINE} + 0.5 * CASE WHEN e.label = q.label THEN 1.0 ELSE 0.22 END, 4) AS score
FROM embeddings e, (SELECT embedding, label FROM embeddings WHERE vec_id = 0) q)
SELECT vec_id, score FROM scored WHERE score >= 0.14 ORDER BY score DESC, vec_id LIMIT 20"""


@query(HYBRID)
def vector_hybrid_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    first = e.where("vec_id = 0").first()
    q = F.array(*(F.lit(float(x)) for x in first["embedding"]))
    facet = F.when(F.col("label") == first["label"], 1.0).otherwise(0.22)
    scored = e.withColumn("score", search.hybrid_score(vector.cosine("embedding", q), facet, 0.5))
    return search.above_floor_or_best(scored, "score", "vec_id", search.floor_of(False, True), 20).select("vec_id", "score")


@query(f"""WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank_a FROM (
  SELECT e.vec_id, round({COSINE}, 4) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY s DESC, vec_id LIMIT 30)),
b AS (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank_b FROM (
  SELECT e.vec_id, round({COSINE}, 4) AS s FROM (SELECT vec_id, embedding[1:32] AS embedding FROM embeddings) e,
  (SELECT embedding[1:32] AS embedding FROM embeddings WHERE vec_id = 0) q ORDER BY s DESC, vec_id LIMIT 30))
SELECT vec_id, rank_a, rank_b, round((coalesce(1 / (60 + rank_a), 0) + coalesce(1 / (60 + rank_b), 0)) * 1000, 3) AS fused FROM a FULL JOIN b USING (vec_id)""")
def rrf_full_vs_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir)
    a = search.vector_scan(e, q, "vec_id", k=30)
    b = search.vector_scan(e.select("vec_id", vector.prefix("embedding", 32).alias("embedding")), q[:32], "vec_id", k=30)
    return search.fuse(a, b, "vec_id", "score", "score")


@query(f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round({COSINE} * 0.5 + CASE WHEN e.label = q.label THEN 0.75 ELSE 0.5 END * 0.2 + 0.4 * 0.2 + 0.4 * 0.1, 3) AS score
  FROM embeddings e JOIN embeddings q ON q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 3""")
def pair_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    # labels stand for colours that aren't in the table; occasions and styles are unknown
    bonus = lambda mine, theirs: np.where(mine[:, None] == theirs[None, :], color.SAME, color.CLASH) * 0.2 + 0.4 * 0.2 + 0.4 * 0.1
    return search.matrix_topk(e, e, "vec_id", "embedding", 3, "label", bonus, cell_queries=25_000)


# --- search and browsing -----------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_retailprice DESC, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand, p_name) AS n FROM part)
SELECT p_partkey, p_brand, p_name, p_retailprice, CASE WHEN n > 1 THEN n END AS variants FROM r WHERE k = 1""")
def style_group_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("style", F.concat_ws(":", "p_brand", "p_name"))
    return search.collapse(part, "style", "p_partkey", "p_retailprice").select("p_partkey", "p_brand", "p_name", "p_retailprice", "variants")


@query("""WITH rows AS (SELECT p_partkey AS id, p_name AS t, 'part' AS source FROM part UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier),
f AS (SELECT source, id, regexp_matches(lower(t), '(^|[^a-z0-9])blue($|[^a-z0-9])')::INT + regexp_matches(lower(t), '(^|[^a-z0-9])upplier($|[^a-z0-9])')::INT AS hits,
  contains(lower(t), 'blue') OR contains(lower(t), 'upplier') AS part FROM rows),
s AS (SELECT source, max(hits) AS best FROM f WHERE hits > 0 OR part GROUP BY source)
SELECT source, id, hits, best = 0 AS fallback FROM f JOIN s USING (source) WHERE (hits > 0 OR part) AND (hits > 0 OR best = 0) ORDER BY hits DESC, source, id LIMIT 300""")
def keyword_search_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("t"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("t"))
    both = search.union_catalogs({"part": part, "supplier": supplier}, "catalog")
    return search.keyword_search(both, "blue upplier", "id", F.col("t"), F.col("catalog"), 300).select("source", "id", "hits", "fallback")


@query("""WITH p AS (SELECT 'part' AS source, p_partkey AS id, p_name AS name, 0 AS pos FROM part WHERE contains(lower(p_name), 'r1') ORDER BY name, id LIMIT 5),
s AS (SELECT 'supplier' AS source, s_suppkey AS id, s_name AS name, 1 AS pos FROM supplier WHERE contains(lower(s_name), 'r#0') ORDER BY name, id LIMIT 5),
c AS (SELECT 'customer' AS source, c_custkey AS id, c_name AS name, 2 AS pos FROM customer WHERE contains(lower(c_name), 'r#0') ORDER BY name, id LIMIT 5)
SELECT source, id, name FROM (SELECT * FROM s UNION ALL SELECT * FROM c ORDER BY pos, name, id LIMIT 10)""")
def autocomplete_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("part", "supplier", "customer")}
    return search.autocomplete({"part": (t["part"], "p_partkey", "p_name"), "supplier": (t["supplier"], "s_suppkey", "s_name"), "customer": (t["customer"], "c_custkey", "c_name")}, "r#0")


@query(with_products("""SELECT id, name, price FROM products WHERE in_stock IS DISTINCT FROM false AND gender IN ('women', 'kids') AND price >= 905 AND price <= 1000
AND contains(lower(brand), 'brand#1') AND list_has_any(occasion, ['casual', 'party']) ORDER BY price DESC, id LIMIT 24 OFFSET 24"""))
def browse_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = filters.in_stock() & filters.gender_in(filters.parse_genders("women,kids,other")) & filters.price_between(905, 1000) & filters.contains_text("brand", "Brand#1") & filters.any_of("occasion", ["casual", "party"])
    return search.page(products(spark, sf_dir).where(fits), [F.desc("price"), F.col("id")], 2, 24).select("id", "name", "price")


@query(with_products("""SELECT id, round(0.34 * CASE WHEN coalesce(len(occasion), 0) = 0 THEN 0.35 WHEN list_contains(occasion, 'party') THEN 1.0 ELSE 0.12 END
 + 0.34 * CASE WHEN primary_color = 'Red' THEN 1.0 ELSE 0.1 END + 0.12 * CASE WHEN contains(name, 'ring') THEN 1.0 ELSE 0.25 END
 + 0.2 * (0.35 + 0.65 * ((contains(lower(description), 'red')::INT + contains(lower(description), 'party')::INT + contains(lower(description), 'ring')::INT) / 3)), 4) AS facet FROM products"""))
def facet_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = lambda *x: F.array(*(F.lit(v) for v in x))
    p = products(spark, sf_dir)
    facet = search.facet_score(search.occasion_facet(lit("party"), F.col("occasion")), search.color_facet(lit("Red"), F.col("primary_color"), F.col("colors")), search.garment_facet(lit("ring"), F.col("name"), F.col("sub_category")), search.keyword_facet(F.lit("red party ring"), F.col("description")))
    return p.select("id", facet.alias("facet"))


@query(with_products("SELECT id, primary_color FROM products WHERE primary_color = 'Red'"))
def photo_color_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keep_if_enough(products(spark, sf_dir), F.col("primary_color") == "Red").select("id", "primary_color")


# --- statistics --------------------------------------------------------------------------------------------------------


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 12")
def brand_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(12)


@query("SELECT coalesce(min(p_retailprice), 0) AS low, coalesce(max(p_retailprice), 0) AS high, coalesce(round(avg(p_retailprice), 4), 0) AS mean FROM part")
def price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_retailprice")
    return table(spark, sf_dir, "part").agg(F.coalesce(F.min(p), F.lit(0.0)).alias("low"), F.coalesce(F.max(p), F.lit(0.0)).alias("high"), F.coalesce(F.round(F.avg(p), 4), F.lit(0.0)).alias("mean"))


@query(with_products("""SELECT type, count(*) AS total, count(*) FILTER (in_stock IS DISTINCT FROM false) AS available, count(*) FILTER (in_stock = false) AS sold_out,
count(*) FILTER (occasion IS NULL) AS without_occasion FROM products GROUP BY type"""))
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    return products(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("total"), n(filters.in_stock()).alias("available"), n(~filters.in_stock()).alias("sold_out"), n(F.col("occasion").isNull()).alias("without_occasion"))


@query("""WITH b AS (SELECT p_brand, count(*) AS before FROM part GROUP BY p_brand), a AS (SELECT p_brand, count(*) AS after FROM part WHERE p_size > CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 40 ELSE 5 END GROUP BY p_brand)
SELECT p_brand, before, coalesce(after, 0) AS after FROM b LEFT JOIN a USING (p_brand) WHERE before >= 20 AND coalesce(after, 0) < 0.5 * before""")
def refresh_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    after = part.where(F.col("p_size") > F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), 40).otherwise(5))
    return ingest.big_drops(part, after, "p_brand")


@query("""WITH r AS (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_retailprice IS NOT NULL),
m AS (SELECT p_brand, max(p_retailprice) FILTER (i = n // 2) AS median, max(n) AS n FROM r GROUP BY p_brand)
SELECT p_brand, m.n, median, count(*) FILTER (p_retailprice > 1.05 * median) AS outliers, count(*) FILTER (p_size IS NULL) AS no_size FROM part JOIN m USING (p_brand) GROUP BY ALL""")
def profile_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    med = evaluate.upper_median(part, "p_retailprice", "p_brand")
    return part.join(F.broadcast(med), "p_brand").groupBy("p_brand", "median").agg(F.count("p_retailprice").alias("n"), F.count(F.when(F.col("p_retailprice") > 1.05 * F.col("median"), 1)).alias("outliers"), F.count(F.when(F.col("p_size").isNull(), 1)).alias("no_size"))


@query("SELECT p_brand AS k0, lower(trim(p_name)) AS k1, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.duplicate_groups(table(spark, sf_dir, "part"), F.col("p_brand"), F.lower(F.trim("p_name")))


@query("SELECT * FROM part ORDER BY md5(p_partkey || ':42'), p_partkey LIMIT 24")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy(F.md5(F.concat_ws(":", F.col("p_partkey").cast("string"), F.lit("42"))), "p_partkey").limit(24)


@query("""SELECT p_brand, grouping(p_brand)::INT AS is_total, count(*) AS n, count(*) FILTER (p_size % 10 = 0) AS failed FROM part GROUP BY ROLLUP (p_brand)""")
def rollup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").rollup("p_brand").agg(F.grouping("p_brand").cast("int").alias("is_total"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("p_size") % 10 == 0, 1)).alias("failed"))


# --- rules and text ----------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'Red' WHEN 'blue' THEN 'Blue' ELSE 'Multicolor' END AS primary_color,
CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'red' WHEN 'blue' THEN 'blue' ELSE 'multicolor' END AS coarse, CASE WHEN regexp_matches(p_name, 'ring') THEN 'jewelry' WHEN regexp_matches(p_name, 'plate|rod') THEN 'metal' END AS kind,
p_retailprice < 905 AS cheap FROM part""")
def color_infer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tone = color.infer("p_name")["primary"]
    kind = rules.first_match(F.col("p_name"), [("jewelry", "ring"), ("metal", "plate|rod")], compat=True)
    return table(spark, sf_dir, "part").select("p_partkey", tone.alias("primary_color"), color.coarse(tone).alias("coarse"), kind.alias("kind"), (F.col("p_retailprice") < 905).alias("cheap"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice * 4 < 3000 THEN 'low' WHEN p_retailprice * 4 <= 4000 THEN 'mid' ELSE 'high' END AS band,
CASE WHEN p_size % 2 = 0 AND p_size BETWEEN 24 AND 40 THEN 'waist' ELSE 'numeric' END AS size_type, p_size::VARCHAR AS size_value FROM part""")
def price_band_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_retailprice") * 4
    band = F.when(rules.price_band(p) == "low", "low").when(p <= 4000, "mid").otherwise("high")
    return table(spark, sf_dir, "part").select("p_partkey", band.alias("band"), rules.sizes(F.array(F.col("p_size").cast("string")))[0].alias("s")).select("p_partkey", "band", F.col("s.type").alias("size_type"), F.col("s.value").alias("size_value"))


@query("""SELECT p_partkey, (p_size % 4 + 1)::INT AS pieces, CASE p_size % 3 WHEN 0 THEN 'unstitched' WHEN 1 THEN 'stitched' ELSE 'semi-stitched' END AS stitching FROM part""")
def piece_and_stitching(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.when(F.col("p_size") % 3 == 0, "unstitched ").when(F.col("p_size") % 3 == 1, "rtw ").otherwise("semi-stitched "), (F.col("p_size") % 4 + 1).cast("string"), F.lit(" pc suit"))
    return table(spark, sf_dir, "part").select("p_partkey", rules.pieces_in_title(title).alias("pieces"), rules.stitching(title, F.lit("")).alias("stitching"))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<script[\\s\\S]*?</script>|<style[\\s\\S]*?</style>', ' ', 'gi'), '<[^>]*>', ' ', 'g'), '[\\s\\x{00a0}\\x{200b}]+', ' ', 'g')) AS body FROM pages""")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags("html").alias("body"))


@query("""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script[\\s\\S]*?</script>|<style[\\s\\S]*?</style>', ' ', 'gi'), '<[^>]*>', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&quot;', '"'), '&amp;', '&') AS t FROM s)
SELECT page_id, substr(trim(regexp_replace(t, '[\\s\\x{00a0}\\x{200b}]+', ' ', 'g')), 1, 2000) AS body FROM d""")
def html_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html("html", 2000).alias("body"))


@query("""WITH s AS (SELECT page_id, url, regexp_replace(list_extract(list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), -1), '\\.(html?|php)$', '', 'i') AS seg,
  regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, seg, regexp_replace(lower(seg), '[^a-z0-9]+', '-', 'g') AS slug, regexp_replace(url, '[?#].*$', '') AS bare, host <> '' AND NOT contains(host, '@') AS safe FROM s""")
def url_slug_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = text.last_segment("url")
    return table(spark, sf_dir, "pages").select("page_id", seg.alias("seg"), text.slug(seg).alias("slug"), text.strip_query("url").alias("bare"), filters.safe_url("url").alias("safe"))


@query("""SELECT event_id, substr(sha256(event_type || '|' || user_id || '|' || CASE WHEN value = floor(value) THEN floor(value)::BIGINT::VARCHAR ELSE value::VARCHAR END), 1, 32) AS fact_id,
substr(sha256('salt:' || user_id), 1, 24) AS actor FROM events""")
def event_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.event_id("event_type", "user_id", text.number_text("value")).alias("fact_id"), text.actor_hash("user_id", "salt").alias("actor"))


@query("""SELECT doc_id, substr(sha1(text), 1, 16) AS hash, doc_id % 3 <> 0 AS stale FROM documents""")
def text_hash_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = text.text_hash("text")
    docs = table(spark, sf_dir, "documents").withColumns({"hash": h, "stored": F.when(F.col("doc_id") % 3 == 0, h), "vec": F.array(F.lit(1.0)), "model": F.lit("m")})
    return docs.select("doc_id", "hash", filters.needs_embedding("vec", "model", F.col("hash"), "stored", "m").alias("stale"))


@query("""WITH t AS (SELECT p_partkey, lower(p_type) || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 's' ELSE 'xx' END AS token FROM part)
SELECT p_partkey, token, CASE WHEN token LIKE '%xx' OR true THEN regexp_replace(token, '(s|xx)$', '') END AS resolved FROM t""")
def fuzzy_enum_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.concat(F.lower("p_type"), F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "s").otherwise("xx"))
    return table(spark, sf_dir, "part").select("p_partkey", token.alias("token"), text.fuzzy_resolve(token, ["economy", "standard", "promo", "large", "small", "medium"]).alias("resolved"))


@query("""SELECT conv_id, turn, length(text) AS n, round(0.3 + 0.6 * contains(lower(text), 'the')::INT, 4)::DOUBLE AS fit FROM conversations WHERE text IS NOT NULL""")
def textual_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.length("text").alias("n"), text.textual_match(F.col("text"), F.lit("the")).alias("fit"))


# --- colour pairs and picks --------------------------------------------------------------------------------------------

PAIRS = ", ".join(f"('{a}', '{b}', {s})" for a, b, s in color.pair_table() if a in ("Red", "Blue", "Multicolor") and b in ("Red", "Blue", "Multicolor"))


@query(with_products(f""", pairs(a, b, s) AS (VALUES {PAIRS}), scored AS (
  SELECT d.id AS dress, x.id AS other, round(least(1.0, s + CASE WHEN d.primary_color = x.primary_color THEN 0.05 ELSE 0 END + CASE WHEN d.primary_color IN ('Red', 'Blue') AND x.primary_color = 'Multicolor' THEN 0.08 ELSE 0 END
   + CASE WHEN list_has_any(d.occasion, x.occasion) THEN 0.18 ELSE 0.06 END + 0.1), 3)::DOUBLE AS score
  FROM products d JOIN products x ON x.type = 'PROMO' AND x.price < 950 JOIN pairs ON a = d.primary_color AND b = x.primary_color WHERE d.type = 'LARGE'),
r AS (SELECT *, row_number() OVER (PARTITION BY dress ORDER BY score DESC, other) AS rank FROM scored)
SELECT dress, other, score, rank FROM r WHERE rank <= 2"""))
def color_compat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    dresses = p.where("type = 'LARGE'").select(F.col("id").alias("dress"), F.col("primary_color").alias("dc"), F.col("occasion").alias("do"))
    pool = p.where("type = 'PROMO' and price < 950").select(F.col("id").alias("other"), F.col("primary_color").alias("sc"), F.col("occasion").alias("so"))
    score = recommend.footwear_score(F.col("dc"), F.col("sc"), F.col("do"), F.col("so"), F.lit("large"), F.lit("promo"))
    return recommend.best_partner(dresses, pool, "dress", "other", score, (["dc", "do"], ["sc", "so"]), k=2).select("dress", "other", "score", "rank")


@query(with_products(f""", pairs(a, b, s) AS (VALUES {PAIRS}), scored AS (
  SELECT d.id // 100 AS request, d.id AS dress, x.id AS shoe, round(s + x.price / 100000, 6)::DOUBLE AS score FROM products d JOIN products x ON d.id // 100 = x.id // 100 AND x.type = 'PROMO' JOIN pairs ON a = d.primary_color AND b = x.primary_color WHERE d.type = 'LARGE'),
options AS (SELECT request, dress, list(shoe ORDER BY score DESC, shoe) AS shoes, row_number() OVER (PARTITION BY request ORDER BY dress) AS k FROM scored GROUP BY request, dress),
walk AS (SELECT DISTINCT request, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS dress, NULL::BIGINT AS shoe FROM options
  UNION ALL SELECT w.request, o.k, CASE WHEN len(free) > 0 THEN list_append(w.taken, free[1]) ELSE w.taken END, o.dress, free[1] FROM walk w JOIN (SELECT * FROM options) o ON o.request = w.request AND o.k = w.k + 1, LATERAL (SELECT list_filter(o.shoes, lambda x: NOT list_contains(w.taken, x)) AS free))
SELECT request, dress, shoe, score FROM walk JOIN scored USING (request, dress, shoe)""").replace("WITH", "WITH RECURSIVE", 1))
def greedy_unique_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)  # a hundred listings a request
    left = p.where("type = 'LARGE'").select(F.floor(F.col("id") / 100).alias("request"), F.col("id").alias("dress"), F.col("primary_color").alias("dc"))
    right = p.where("type = 'PROMO'").select(F.floor(F.col("id") / 100).alias("request"), F.col("id").alias("shoe"), F.col("primary_color").alias("sc"), "price")
    scored = left.join(right, "request").withColumn("score", F.round(color.compatibility("dc", "sc") + F.col("price") / 100000, 6))
    return recommend.greedy_unique(scored, "request", "dress", "shoe", "score")


@query("""WITH r AS (SELECT p_brand, p_partkey, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part),
first AS (SELECT * FROM r WHERE k <= 2), later AS (
  SELECT p_brand, p_partkey, p_type, k, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY k) AS t FROM r WHERE k > 2),
fresh AS (SELECT l.p_brand, l.p_partkey, l.k FROM later l WHERE t = 1 AND NOT EXISTS (SELECT 1 FROM first f WHERE f.p_brand = l.p_brand AND f.p_type = l.p_type)),
u AS (SELECT p_brand, p_partkey, k FROM first UNION ALL SELECT p_brand, p_partkey, k FROM fresh), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY k) AS place FROM u)
SELECT p_brand, p_partkey, place FROM n WHERE place <= 4""")
def diversity_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    # ranked first within each type, so that only a few rows of a brand are gathered
    by_type = part.withColumns({"k": F.row_number().over(w), "t": F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_retailprice"), "p_partkey"))}).where("k <= 2 or t <= 3")
    items = F.array_sort(F.collect_list(F.struct("k", F.col("p_type").alias("kind"), "p_partkey")))
    picked = by_type.groupBy("p_brand").agg(recommend.diverse(items, 4).alias("picked"))
    return picked.select("p_brand", F.posexplode("picked").alias("at", "x")).select("p_brand", F.col("x.p_partkey").alias("p_partkey"), (F.col("at") + 1).alias("place"))


@query(with_products(f""", pairs(a, b, s) AS (VALUES {PAIRS}), s AS (SELECT h.id AS hero_id, p.id, round(s, 3)::DOUBLE AS score FROM products h JOIN products p
  ON p.in_stock IS DISTINCT FROM false AND p.gender = h.gender AND p.id <> h.id AND p.price <= 1.4 * h.price JOIN pairs ON a = h.primary_color AND b = p.primary_color WHERE h.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY hero_id ORDER BY score DESC, id) AS rank FROM s) SELECT hero_id, id, score, rank FROM r WHERE rank <= 5"""))
def outfit_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    return recommend.complete(p, p.where("id % 50 = 0"), "id").select("hero_id", "id", "score", "rank")


# --- relaxation --------------------------------------------------------------------------------------------------------

INTENT = filters.Intent(occasion=("party",), print="plain", stitching="unstitched", pieces=1, fabric="ring", season="winter", color_exact="red", color_families=("Red",), max_budget=960)
HARD = "in_stock IS DISTINCT FROM false AND NOT regexp_matches(name, '(?i)dupatta|stole|scarf|scarves|clutch|bag|jewelry|jewellery')"
SOFT = {
    "occasion": "coalesce(list_contains(occasion, 'party'), false)", "print": "pattern = 'plain'", "stitching": "stitching = 'unstitched'", "pieces": "pieces = 1", "fabric": "contains(fabric, 'ring')",
    "season": "(season IS NULL OR len(season) = 0)", "color": "primary_color = 'Red'",
}


def _level_sql() -> str:
    parts = []
    for i, rung in enumerate(recommend.levels(INTENT)):
        kept = [c for name, c in SOFT.items() if name not in rung.dropped and (name != "color" or rung.color != "none")]
        fits = " AND ".join([HARD, *kept])
        label = f"'{rung.label}'" if rung.label else "NULL::VARCHAR"
        parts.append(f"SELECT {i} AS level, {label} AS relaxed, count(*) FILTER ({fits} AND price <= 960) AS n, min(price) FILTER ({fits}) AS cheapest FROM products")
    return with_products(" UNION ALL ".join(parts))


@query(_level_sql())
def relax_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.level_counts(products(spark, sf_dir), INTENT)


def _choice_sql() -> str:
    rungs = recommend.levels(INTENT)
    fits = [" AND ".join([HARD, "price <= 960", *(c for name, c in SOFT.items() if name not in r.dropped and (name != "color" or r.color != "none"))]) for r in rungs]
    points = {"pieces": 2, "stitching": 2, "print": 1, "fabric": 1, "occasion": 1, "season": 1, "color": 3}
    score = " + ".join([*(f"CASE WHEN {SOFT[c]} THEN {p} ELSE 0 END" for c, p in points.items()), "CASE WHEN price <= 960 THEN 1 ELSE 0 END"])
    return with_products(f""", counts AS ({_level_sql().removeprefix(with_products(""))}),
ends AS (SELECT min(level) FILTER (n >= 8) AS enough, min(level) FILTER (n = 0 AND cheapest IS NOT NULL) AS blocked, arg_max(level, n * 1000 - level) FILTER (n > 0) AS most FROM counts),
chosen AS (SELECT CASE WHEN blocked < coalesce(enough, 1000) THEN -1 ELSE coalesce(enough, most, -1) END AS level FROM ends),
found AS (SELECT p.*, ({score})::INT AS score, level FROM products p, chosen WHERE CASE level {' '.join(f'WHEN {i} THEN {f}' for i, f in enumerate(fits))} ELSE false END)
SELECT id, name, price, score, CASE WHEN level = 0 THEN 'exact' WHEN score >= 8 THEN 'close' WHEN score >= 4 THEN 'similar' ELSE 'loose' END AS tier FROM found ORDER BY score DESC, id LIMIT 20""")


@query(_choice_sql())
def relax_choose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommend.recommend(products(spark, sf_dir), INTENT, "id").select("id", "name", "price", "score", "tier")


@query(with_products("""SELECT id, (CASE WHEN pieces = 1 THEN 2 ELSE 0 END + CASE WHEN stitching = 'unstitched' THEN 2 ELSE 0 END + CASE WHEN pattern = 'plain' THEN 1 ELSE 0 END
+ CASE WHEN contains(fabric, 'ring') THEN 1 ELSE 0 END + CASE WHEN coalesce(list_contains(occasion, 'party'), false) THEN 1 ELSE 0 END + CASE WHEN season IS NULL THEN 1 ELSE 0 END
+ CASE WHEN primary_color = 'Red' THEN 3 ELSE 0 END + CASE WHEN price <= 960 THEN 1 ELSE 0 END)::INT AS score FROM products"""))
def intent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("id", recommend.local_score(INTENT).alias("score"))


# --- snapshots ---------------------------------------------------------------------------------------------------------


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two crawls of `part`: the second lost some listings, has new ones and other prices."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("url"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 10 != 0).alias("in_stock"))
    return p.where("url % 7 <> 0"), p.where("url % 5 <> 0").withColumn("price", F.when(F.col("url") % 11 == 0, F.col("price") - 10).otherwise(F.col("price")))


SNAPSHOTS = """WITH p AS (SELECT p_partkey AS url, p_brand AS brand, p_name AS name, p_retailprice AS price, p_size % 10 <> 0 AS in_stock FROM part),
old AS (SELECT * FROM p WHERE url % 7 <> 0), new AS (SELECT url, brand, name, CASE WHEN url % 11 = 0 THEN price - 10 ELSE price END AS price, in_stock FROM p WHERE url % 5 <> 0),
u AS (SELECT coalesce(o.url, n.url) AS url, o.price AS old_price, n.price AS new_price,
  CASE WHEN o.url IS NULL THEN 'inserted' WHEN n.url IS NULL THEN 'unseen' WHEN o.price IS DISTINCT FROM n.price OR o.name IS DISTINCT FROM n.name THEN 'updated' ELSE 'unchanged' END AS outcome FROM old o FULL JOIN new n ON o.url = n.url)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    differs = ~(F.col("old.price").eqNullSafe(F.col("new.price")) & F.col("old.name").eqNullSafe(F.col("new.name")))
    return ingest.upsert(old, new, "url", differs)


@query(SNAPSHOTS + "SELECT * FROM u")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).select("url", F.col("old.price").alias("old_price"), F.col("new.price").alias("new_price"), "outcome")


@query(SNAPSHOTS + """SELECT CASE WHEN outcome = 'inserted' THEN 'discovered' ELSE 'price_changed' END AS type, url, old_price, new_price,
 substr(sha256(CASE WHEN outcome = 'inserted' THEN 'discovered|' || url || '|' ELSE 'price_changed|' || url || '|' || CASE WHEN old_price = floor(old_price) THEN floor(old_price)::BIGINT::VARCHAR ELSE old_price::VARCHAR END || '|' END
 || CASE WHEN new_price = floor(new_price) THEN floor(new_price)::BIGINT::VARCHAR ELSE new_price::VARCHAR END), 1, 32) AS event_id
 FROM u WHERE outcome = 'inserted' OR (outcome = 'updated' AND old_price <> new_price)""")
def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.run_events(_outcomes(spark, sf_dir), "url")


@query(SNAPSHOTS + "SELECT o.url, o.brand FROM old o WHERE o.in_stock IS DISTINCT FROM false AND NOT EXISTS (SELECT 1 FROM new n WHERE n.url = o.url AND n.brand = o.brand)")
def stock_sweep_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return ingest.unseen(old, new, ["brand", "url"]).select("url", "brand")


@query(SNAPSHOTS + """, s AS (SELECT brand, count(*) AS seen FROM new GROUP BY brand), b AS (SELECT brand, count(*) FILTER (in_stock) AS in_stock, (row_number() OVER (ORDER BY brand) % 4)::BIGINT AS failed FROM old GROUP BY brand),
 d AS (SELECT b.*, CASE WHEN b.failed = 3 THEN 1 ELSE coalesce(seen, 0) END AS seen FROM b LEFT JOIN s USING (brand))
 SELECT brand, seen, in_stock, failed, CASE WHEN seen = 0 THEN 'nothing seen' WHEN failed / 4 > 0.34 THEN 'run incomplete' WHEN in_stock >= 20 AND seen < in_stock * 0.3 THEN 'too few seen' END AS reason FROM d""")
def sweep_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    seen = new.groupBy("brand").agg(F.count(F.lit(1)).alias("seen"))
    base = old.groupBy("brand").agg(F.count(F.when(F.col("in_stock"), 1)).alias("in_stock")).withColumn("failed", (F.row_number().over(Window.orderBy("brand")) % 4).cast("long"))  # one row a brand
    both = base.join(seen, "brand", "left").withColumn("seen", F.when(F.col("failed") == 3, 1).otherwise(F.coalesce("seen", F.lit(0))).cast("long"))
    _, reason = ingest.sweep_decision(F.col("seen"), F.col("in_stock"), F.col("failed"), F.lit(4))
    return both.select("brand", "seen", "in_stock", "failed", reason.alias("reason"))


@query("SELECT p_partkey, 'p_type' AS field, p_type AS old, lower(p_type) AS new FROM part UNION ALL SELECT p_partkey, 'p_name', p_name, upper(p_name) FROM part WHERE p_size > 40")
def repair_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return ingest.patch(part, "p_partkey", {"p_type": F.lower("p_type"), "p_name": F.when(F.col("p_size") > 40, F.upper("p_name"))})


@query("""SELECT CASE WHEN p_size % 10 = 0 THEN 'hard' END AS severity, 'sold-out' AS type, count(*) AS n FROM part WHERE p_size % 10 = 0 GROUP BY ALL
UNION ALL SELECT 'soft', 'no-color', count(*) FROM part WHERE split_part(p_name, ' ', 1) NOT IN ('red', 'blue') HAVING count(*) > 0""")
def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    found = p.withColumn("issues", evaluate.issues({"sold-out": ("hard", ~filters.in_stock()), "no-color": ("soft", F.col("primary_color") == "Multicolor")}))
    return evaluate.issue_counts(found)


# --- joins -------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, c.kind, c.name FROM orders JOIN (SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier) c
ON c.id = o_custkey AND c.kind = CASE WHEN o_orderkey % 2 = 0 THEN 'customer' ELSE 'supplier' END""")
def favorites_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = search.union_catalogs({"customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))}, "kind")
    facts = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "customer").otherwise("supplier").alias("kind"))
    return facts.join(people, ["kind", "id"]).select("o_orderkey", "kind", "name")


@query("""WITH o AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey))) AS items FROM lineitem GROUP BY l_orderkey),
x AS (SELECT l_orderkey, unnest(items) AS id, generate_subscripts(items, 1) AS pos FROM o)
SELECT l_orderkey, string_agg(p_name, ',' ORDER BY pos) AS names, count(*) AS n FROM x LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = id GROUP BY l_orderkey""")
def outfit_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    outfits = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("items"))
    parts = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"), "p_name")
    x = outfits.select("l_orderkey", F.posexplode_outer("items").alias("at", "id")).join(parts, "id", "left")
    named = F.array_sort(F.collect_list(F.when(F.col("p_name").isNotNull(), F.struct("at", "p_name"))))
    names = F.transform(named, lambda s: s["p_name"])
    return x.groupBy("l_orderkey").agg(F.when(F.size(names) > 0, F.array_join(names, ",")).alias("names"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""WITH all_ids AS (SELECT p_partkey AS id, p_name AS name, 0 AS pos FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier UNION ALL SELECT c_custkey, c_name, 2 FROM customer)
SELECT id, arg_min(name, pos) AS name, min(pos)::INT AS pos FROM all_ids GROUP BY id""")
def find_by_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, k, n, at: table(spark, sf_dir, t).select(F.col(k).cast("long").alias("id"), F.col(n).alias("name"), F.lit(at).alias("pos"))
    rows = one("part", "p_partkey", "p_name", 0).where("id % 3 = 0").union(one("supplier", "s_suppkey", "s_name", 1)).union(one("customer", "c_custkey", "c_name", 2))
    return rows.groupBy("id").agg(F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos"))


@query("SELECT count(*) AS favorites, count(*) FILTER (p_partkey IS NULL) AS missing FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON p_partkey = l_partkey")
def favorites_relink(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "part").where("p_size > 5").select("p_partkey")
    return table(spark, sf_dir, "lineitem").join(kept, F.col("l_partkey") == F.col("p_partkey"), "left").agg(F.count(F.lit(1)).alias("favorites"), F.count(F.when(F.col("p_partkey").isNull(), 1)).alias("missing"))


# --- events ------------------------------------------------------------------------------------------------------------


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as JSON messages: some repeated, some broken, some invalid."""
    e = table(spark, sf_dir, "events").withColumn("n", F.col("event_id"))
    price = F.when(F.col("n") % 17 == 0, -1.0).otherwise(F.col("value"))
    payload = F.struct(F.concat(F.lit("https://shop.example/p/"), F.col("user_id").cast("string")).alias("product_url"), F.lit("b").alias("brand"), F.lit("item").alias("name"), price.alias("price"))
    kind = F.when(F.col("n") % 19 == 0, "unknown").otherwise("discovered")
    when = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    msg = F.to_json(F.struct(F.concat(F.lit("event-number-"), F.col("n").cast("string")).alias("event_id"), kind.alias("type"), F.lit(1).alias("version"), when.alias("occurred_at"), F.lit("test").alias("source"), payload.alias("payload")))
    copies = F.when(F.col("n") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return e.select("n", F.when(F.col("n") % 23 == 0, F.lit("{broken")).otherwise(msg).alias("value"), F.explode(copies).alias("copy"))


REASON = "CASE WHEN n % 23 = 0 THEN 'not JSON' WHEN n % 19 = 0 THEN 'envelope: type' WHEN n % 17 = 0 THEN 'payload: price' END"


@query(f"WITH r AS (SELECT event_id AS n, unnest(CASE WHEN event_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM events) SELECT coalesce({REASON}, 'valid') AS reason, count(*) AS n FROM r GROUP BY 1")
def event_validate_dlq(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, dead = E.split(E.parse(raw_events(spark, sf_dir)))
    return dead.select("reason").unionByName(valid.select(F.lit("valid").alias("reason"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'event-number-' || event_id AS event_id, round(value, 4) AS price FROM (SELECT *, event_id AS n FROM events) WHERE {REASON} IS NULL")
def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = E.split(E.parse(raw_events(spark, sf_dir)))
    return E.dedupe(valid).select("event_id", F.round("payload.price", 4).alias("price"))


@query("SELECT user_id, arg_max(value, ts) AS value, min(ts) AS first_seen, max(ts) AS last_event, count(*) AS events FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latest(table(spark, sf_dir, "events"), "user_id", "value")


@query("WITH l AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_value FROM events) SELECT event_id, user_id, old_value, value, floor((old_value - value) / old_value * 100 + 0.5)::INT AS pct FROM l WHERE value < old_value")
def price_drop_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    drops = E.price_drops(table(spark, sf_dir, "events"), "user_id", "value")
    return drops.select("event_id", "user_id", "old_value", "value", text.notification(F.lit("item"), "old_value", "value", F.lit("PKR"))[1].alias("pct"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def label_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_distinct("user_id").alias("users"))


@query("""WITH h AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([10.0, 25.0, 50.0, 100.0, 250.0, 'inf'::DOUBLE]) AS le) GROUP BY ALL),
m AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY le), 0) AS below, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0) AS low, max(n) OVER (PARTITION BY event_type) AS total FROM h)
SELECT event_type, round(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (0.9 * total - below) / (n - below) END, 4) AS p90 FROM m WHERE n >= 0.9 * total AND below < 0.9 * total""")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = evaluate.histogram(table(spark, sf_dir, "events"), "value", [10, 25, 50, 100, 250], "event_type")
    return evaluate.quantile_of_buckets(h, 0.9, "event_type").select("event_type", F.round("quantile", 4).alias("p90"))


@query("SELECT user_id % 3 AS part, sum(CASE WHEN event_id % 5 = 0 THEN event_id ELSE greatest(event_id - 10, 0) END)::BIGINT AS lag FROM events GROUP BY 1")
def lag_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 3).alias("part")).agg(F.sum(F.when(F.col("event_id") % 5 == 0, F.col("event_id")).otherwise(F.greatest(F.col("event_id") - 10, F.lit(0)))).alias("lag"))


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: clock-aligned windows."""
    six = F.window(F.col("ts").cast("timestamp_ntz"), "6 hours")
    return table(spark, sf_dir, "events").groupBy(six.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query()
def approx_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: approximate distinct counts."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS provider, ts, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
walk AS (SELECT provider, k, CASE WHEN ok THEN 0 ELSE 1 END AS run, NULL::TIMESTAMP AS until, false AS refused FROM e WHERE k = 1
  UNION ALL SELECT e.provider, e.k, CASE WHEN e.ts < w.until THEN w.run WHEN e.ok OR w.run + 1 >= 2 THEN 0 ELSE w.run + 1 END, CASE WHEN NOT coalesce(e.ts < w.until, false) AND NOT e.ok AND w.run + 1 >= 2 THEN e.ts + INTERVAL 1 DAY ELSE w.until END, coalesce(e.ts < w.until, false)
  FROM walk w JOIN e ON e.provider = w.provider AND e.k = w.k + 1)
SELECT provider, count(*) FILTER (refused) AS refused, count(*) AS attempts FROM walk GROUP BY provider""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("provider"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    return E.breaker(e, "provider", "ok", failures=2, open_seconds=86400).groupBy("provider").agg(F.count(F.when(F.col("open"), 1)).alias("refused"), F.count(F.lit(1)).alias("attempts"))


# --- evaluation --------------------------------------------------------------------------------------------------------

SPECS = {"q1": [("lang", ["en"]), ("source", ["src1"])], "q2": [("lang", ["fr"]), ("source", ["src2", "src3"])], "q3": [("lang", ["xx"]), ("source", ["src1"])]}


@query(
    "WITH "
    + ", ".join(f"""{q}_g AS (SELECT doc_id, n_chars, {' + '.join(f"regexp_matches(lower({c}), '(^|[^a-z0-9])({'|'.join(w)})')::INT" for c, w in spec)} AS grade FROM documents),
{q} AS (SELECT '{q}' AS query, grade, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position, (SELECT count(*) FROM {q}_g WHERE grade = 2) AS total FROM {q}_g ORDER BY n_chars DESC, doc_id LIMIT 10)""" for q, spec in SPECS.items())
    + f""", r AS ({' UNION ALL '.join(f'SELECT * FROM {q}' for q in SPECS)}),
m AS (SELECT query, max(total) AS relevant_total, count(*) AS n, count(*) FILTER (grade = 2) AS hits, min(position) FILTER (grade = 2) AS first, sum((pow(2, grade) - 1) / log2(position + 1)) AS dcg FROM r GROUP BY query),
i AS (SELECT m.*, (SELECT sum(3 / log2(k + 1)) FROM range(1, 11) t(k) WHERE k <= m.relevant_total) AS ideal FROM m)
SELECT query, hits, relevant_total, round(hits / n, 4) AS precision, round(CASE WHEN relevant_total > 0 THEN hits / least(relevant_total, 10) END, 4) AS recall, round(coalesce(1 / first, 0), 4) AS rr,
round(CASE WHEN relevant_total > 0 THEN least(1.0, dcg / ideal) END, 4) AS ndcg FROM i"""
)
def eval_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", *sorted({c for spec in SPECS.values() for c, _ in spec}))
    grades = {q: evaluate.grade(spec) for q, spec in SPECS.items()}
    # one scan counts for all queries; the queries rank alike here, so one scan finds the top rows of all
    totals = docs.agg(*(F.count_if(g == len(SPECS[q])).alias(q) for q, g in grades.items()))  # one row
    top = docs.orderBy(F.desc("n_chars"), "doc_id").limit(10).withColumn("position", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")))
    each = F.array(*(F.struct(F.lit(q).alias("query"), g.alias("grade"), F.col(q).alias("relevant_total")) for q, g in grades.items()))
    ranked = top.crossJoin(F.broadcast(totals)).select("position", F.inline(each))
    return evaluate.ranking_metrics(ranked, 2)
