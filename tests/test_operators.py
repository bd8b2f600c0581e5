import json
import os

import pytest
from pyspark.sql import functions as F

from lumenshelf.operators import evaluate, ingest, normalize, recommend, search
from lumenshelf.plans.products import products
from lumenshelf.sources import listings, sinks
from lumenshelf.streaming import events as E

SF = "/root/testdata/sf0.001"
RAW = "title string, handle string, images array<string>, price double, product_url string, sizes array<string>, tags array<string>, variant_options array<string>, description string, vendor string, product_type string, brand string, category string, sub_category string, occasion array<string>, style array<string>, gender string"


def listing(**kw):
    base = {"title": "Printed Lawn Suit", "handle": "h", "images": ["i"], "price": 4000.0, "product_url": "https://s.pk/p/x", "sizes": ["S"], "tags": [], "variant_options": ["Navy Blue"], "description": "Unstitched 3-Piece lawn shirt, trouser and dupatta", "vendor": "v", "product_type": "", "brand": "B", "category": "clothing", "sub_category": "other", "occasion": [], "style": [], "gender": "women"}
    return base | kw


def test_normalize(spark):
    rows = [listing(), listing(title="Silver Ring"), listing(price=None), listing(tags=["Spring 2026"], product_url="b")]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], RAW)
    got = normalize.normalize(df).collect()
    assert [r.reject for r in got] == [None, "not clothing", "price", None]
    assert (got[0].primary_color, got[0].piece_type, got[0].stitching, got[0].sub_category, got[0].price_range) == ("Blue", "3-piece", "unstitched", "unstitched-3-piece", "mid")
    assert normalize.normalize(df, compat=True).collect()[3].reject == "not clothing"


def test_style_key(spark):
    df = spark.createDataFrame([("Lawn Suit", "https://x.y/p/lawn-suit-ec327-navy", "Br"), ("Lawn Suit", "https://x.y/p/lawn-suit", "Br"), ("A", "https://x.y/p/other-words", "Br")], "name string, product_url string, brand string")
    code, group, token = normalize.style_key()
    assert [tuple(r) for r in df.select(code, group, token).collect()] == [("EC327", "br:ec327", "navy"), (None, None, None), (None, None, None)]


def test_shop_json_and_cards(spark, tmp_path):
    page = {"products": [{"title": "T", "handle": "t-1", "body_html": "<p>Hi&amp;</p>", "vendor": "v", "product_type": "Suit", "tags": "a, b", "images": [{"src": "i"}], "variants": [{"price": "1,200.50", "compare_at_price": None, "option1": "S", "option2": "Red", "option3": None, "available": False}, {"price": "9", "option1": "S", "option2": "Blue", "available": True}]}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    r = listings.read_shop_json(spark, str(tmp_path / "p.json"), "https://s.pk").first()
    assert (r.price, r.sizes, r.variant_options, r.tags, r.is_available, r.description, r.product_url) == (1200.5, ["S"], ["Red", "Blue"], ["a", "b"], True, "Hi&", "https://s.pk/products/t-1")
    html = "".join(f'<div class="product-card"><a href="/p/{i}"><img src="i{i}"></a><h3 class="title">Name {i}</h3><span class="price">Rs {i}00</span></div>' for i in (1, 2, 2))
    got = listings.html_cards(spark.createDataFrame([("u", html), ("v", None)], "url string, html string")).orderBy("product_url").collect()
    assert [(c.title, c.price, c.product_url) for c in got] == [("Name 1", 100.0, "/p/1"), ("Name 2", 200.0, "/p/2")]
    pages = spark.createDataFrame([('{"availability": "https://schema.org/OutOfStock"}',), ("Add to bag",), ("",)], "h string")
    assert [x[0] for x in pages.select(listings.availability("h")).collect()] == [False, True, None]


def test_export_and_backup(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 'x "y"\nz')], "id long, tags array<string>, t string")
    sinks.export(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out/csv")).first()
    assert (back.tags, back.t) == ("a | b", 'x "y" z')
    assert sinks.backup({"d": df}, str(tmp_path / "b")).first().rows == 1
    assert sinks.may_wipe(5, "products") and not sinks.may_wipe(5, "users") and not sinks.may_wipe(90, "products")


def test_search_floor_and_fallback(spark):
    df = spark.createDataFrame([(1, 0.05), (2, 0.02)], "id long, score double")
    assert search.above_floor_or_best(df, "score", "id", 0.1, 5).count() == 2
    assert search.above_floor_or_best(df, "score", "id", 0.03, 5).count() == 1
    assert search.blend_weight(10, True) == 0.34


def test_recommend_and_budget(spark):
    p = products(spark, SF)
    from lumenshelf.operators.filters import Intent

    found = recommend.choose(p, Intent(fabric="ring", max_budget=1.0))
    assert found.budget_block is not None and found.budget_block[0] == 1.0
    assert recommend.choose(p, Intent(fabric="ring"), least=1).relaxed == ()
    assert recommend.recommend(p, Intent(fabric="ring", season="winter"), "id", 5).count() == 5


def test_greedy_matches_plain_loop(spark):
    rows = [(1, d, s, float((d * 7 + s * 3) % 5)) for d in range(4) for s in range(3)]
    got = {r.d: r.s for r in recommend.greedy_unique(spark.createDataFrame(rows, "g long, d long, s long, score double"), "g", "d", "s", "score").collect()}
    used, want = set(), {}
    for d in range(4):
        free = [(-x[3], x[2]) for x in rows if x[1] == d and x[2] not in used]
        if free:
            want[d] = min(free)[1]
            used.add(want[d])
    assert got == want


def test_changed_ignores_size_order(spark):
    schema = "url string, price double, compare_at_price double, name string, description string, image_url string, sizes array<string>"
    a = spark.createDataFrame([("u", 1.0, None, "n", "", "i", ["S", "M"]), ("w", 1.0, None, "n", None, "i", None)], schema)
    b = spark.createDataFrame([("u", 1.0, None, "n", None, "i", ["M", "S"]), ("w", 2.0, None, "n", None, "i", None), ("x", 1.0, None, "n", None, "i", None)], schema)
    assert {r.url: r.outcome for r in ingest.upsert(a, b, "url").collect()} == {"u": "unchanged", "w": "updated", "x": "inserted"}


def test_metrics(spark):
    ranked = spark.createDataFrame([("a", 1, 1, 3), ("a", 2, 2, 3), ("b", 1, 0, 0)], "query string, position int, grade int, relevant_total long")
    m = {r["query"]: r for r in evaluate.ranking_metrics(ranked, 2).collect()}
    assert (m["a"].precision, m["a"].recall, m["a"].rr) == (0.5, 0.3333, 0.5)
    assert m["b"].recall is None
    s = evaluate.summary(evaluate.ranking_metrics(ranked, 2))
    assert s.first().unanswerable == ["b"]
    assert [r.metric for r in evaluate.regressions(s, {"precision": 0.9, "mrr": 0.5}).collect()] == ["precision"]


def test_breaker(spark):
    rows = [("p", i, i not in (1, 2)) for i in range(6)]
    df = spark.createDataFrame(rows, "p string, s long, ok boolean").withColumn("ts", F.timestamp_seconds(F.col("s") * 10))
    got = {r.s: r.open for r in E.breaker(df, "p", "ok", failures=2, open_seconds=25).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: True, 5: False}


def event(i, price, ts, kind="discovered", **kw):
    payload = {"product_url": "https://s.pk/1", "brand": "b", "name": "n", "price": price} | kw
    return json.dumps({"event_id": f"event-{i:05d}", "type": kind, "version": 1, "occurred_at": ts, "source": "s", "payload": payload})


def test_validation_reasons(spark):
    good = event(1, 5.0, "2024-01-01T00:00:00Z")
    bad = ["{", event(2, -1.0, "2024-01-01T00:00:00Z"), event(3, 1.0, "yesterday"), event(4, 1.0, "2024-01-01T00:00:00Z", "other"), event(5, 1.0, "2024-01-01T00:00:00Z", name="")]
    df = spark.createDataFrame([(x,) for x in [good, *bad]], "value string")
    assert [r.reason for r in E.parse(df).collect()] == [None, "not JSON", "payload: price", "envelope: occurred_at", "envelope: type", "payload: name"]
    assert E.fan_out(E.split(E.parse(df))[0])["feedback"].count() == 0


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    df = spark.createDataFrame([("a",), ("b",)], "event_id string")
    E.append_once(df, path, batch_id=0)
    E.append_once(df.union(spark.createDataFrame([("c",)], "event_id string")), path, batch_id=1)
    E.append_once(df.union(spark.createDataFrame([("c",)], "event_id string")), path, batch_id=1)
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_stream_state_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    schema = "event_id long, user_id long, value double, ts timestamp"
    rows = [(1, 1, 1000.0, "2024-01-01 00:00:01"), (2, 1, 800.0, "2024-01-01 00:00:03"), (3, 1, 900.0, "2024-01-01 00:00:02"), (4, 2, 5.0, "2024-01-01 00:00:01")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "event_id long, user_id long, value double, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        part = next((tmp_path / f"w{i}").glob("part-*"))
        part.rename(src / f"{i}.parquet")
        os.utime(src / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = E.fold_stream(stream, "user_id", "value").writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("folded")
    drops = [(r.old_price, r.price) for r in got.where("old_price is not null").collect()]
    assert drops == [(1000.0, 800.0)]
    final = {r.key: (r.price, r.n) for r in got.groupBy("key").agg(F.max_by("price", "n").alias("price"), F.max("n").alias("n")).collect()}
    batch = {r.user_id: (r.value, r.events) for r in E.latest(spark.read.parquet(str(src)), "user_id", "value").collect()}
    assert final == batch


def test_dedupe_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:00:00")], "event_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = E.dedupe_stream(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 2


@pytest.mark.parametrize("name", ["vector_topk", "browse_page"])
def test_plans_push_down(spark, name):
    from lumenshelf.plans import catalog

    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan or "GlobalLimit" in plan
    assert "html" not in plan
