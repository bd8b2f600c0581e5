"""Brands by folder, selectors over pages, product pages."""

import json

import pytest
from pyspark.sql import functions as F

from lumenshelf.sources import brands, selectors

CONFIG = [
    {"brand": "Alder", "base_url": "https://k.example/", "adapter": "A", "category": "clothing", "collections": [{"path": "/new", "sub_category": "kurta", "occasion": ["eid"], "style": [], "gender": "women"}, {"path": "/men", "gender": "men"}]},
    {"brand": "Birch B", "base_url": "https://m.example", "adapter": "A", "category": "clothing", "collections": []},
    {"brand": "Cedar", "base_url": "https://s.example", "adapter": "B", "category": "shoes", "collections": [{"path": "/heels", "gender": "women"}]},
]


def test_runs_read_only_the_folders_of_their_brands(spark, tmp_path):
    (tmp_path / "config.json").write_text(json.dumps(CONFIG))
    dimension = brands.read_config(spark, str(tmp_path / "config.json"))
    assert [(r.brand, r.url) for r in dimension.orderBy("brand", "url").collect()] == [("Alder", "https://k.example/men"), ("Alder", "https://k.example/new"), ("Birch B", None), ("Cedar", "https://s.example/heels")]
    brands.store_dimension(dimension, str(tmp_path / "dimension"))
    listings = spark.range(3000).select("id", F.element_at(F.array(F.lit("ALDER"), F.lit("Birch B "), F.lit("Cedar")), (F.col("id") % 3 + 1).cast("int")).alias("brand"), F.lit("x" * 50).alias("text"))
    brands.store_listings(listings, str(tmp_path / "listings"))
    run = brands.run(spark, str(tmp_path / "listings"), str(tmp_path / "dimension"), " alder , Birch B", "clothing")
    assert run.count() == 1000 * 2 + 1000
    plan = run._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()
    run.collect()
    assert {r[0] for r in run.select("brand_key").distinct().collect()} == {"alder", "birch b"}
    assert brands.run(spark, str(tmp_path / "listings"), str(tmp_path / "dimension")).count() == 1000 * 4
    assert brands.parse_only(None) == [] and brands.parse_only(" , A,") == ["a"]
    df = spark.createDataFrame([("Alder",), (None,)], "brand string")
    assert df.where(brands.allowed(["alder"])).count() == 1 and df.where(brands.allowed([])).count() == 2


def page(*cards):
    return "<!doctype html><html><body><div class=grid>" + "".join(cards) + "</div></body></html>"


CARD = '<a href="/products/{n}?x=1"><img src="//c.example/{n}.jpg"></a><h3><a href="#">Item {n}</a></h3><span class="price">Rs. {n}00.40</span>'


@pytest.mark.parametrize("box", ['<div class="a product-item b">', '<div class="product-card">', '<div class="grid__item">', '<div class="product-grid-item">', '<li class="product  item">', '<div class="grid-view-item">', '<div class="product">', '<section data-product-id>', '<div class="card--product">'])
def test_each_container(spark, box):
    end = f"</{box[1:].split()[0].rstrip('>')}>"
    html = page(*(box + CARD.format(n=n) + end for n in (12, 13, 14)))
    got = selectors.cards(spark.createDataFrame([("https://s.example/c?p=1", html)], "url string, html string")).orderBy("position").collect()
    assert [(r.position, r.title, r.price, r.image_url, r.product_url) for r in got] == [(i + 1, f"Item {n}", n * 100, f"https://c.example/{n}.jpg", f"https://s.example/products/{n}?x=1") for i, n in enumerate((12, 13, 14))]


def one_card(spark, inside, **options):
    html = page(*(f'<div class="product-card">{inside}</div>' for _ in range(2)))
    got = selectors.cards(spark.createDataFrame([("https://s.example", html)], "url string, html string"), **options).collect()
    return got[0] if got else None


def test_titles_prices_images_links(spark):
    shell = '<img src="https://i/a.jpg"><a href="/products/1">go</a>'
    for inside in ('<b class="product-item__title">Name</b>', '<b class="product-title">Name</b>', '<div class="card__heading"><i><a>Name</a></i></div>', '<a class="product-item-link">Name</a>', "<h2><a>Name</a></h2>", "<h3> <a>\nName\nmore</a></h3>", '<p class="title"><a>Name</a></p>', '<a class="product-name">Name</a>', '<i class="name">Name'):
        assert one_card(spark, shell + inside).title == "Name"
    for inside, price in (('<p class="price--sale"><i class="money">Rs 1,299</i></p><p class="price">1</p>', 1299), ('<p class="price"><i class="money">PKR 2,000.60</i></p>', 2001), ('<p class="price-item--regular">950</p>', 950), ('<p class="now-price-box">Rs.875</p>', 875), ("<p>900</p>", None), ('<p class="price">free</p>', None)):
        assert one_card(spark, shell + '<b class="name">Name</b>' + inside).price == price
    named = '<b class="name">Name</b><a href="https://s.example/products/1">go</a>'
    for inside, image in (('<img data-src="/a_{width}.jpg" src="/b.jpg">', "https://s.example/a_600.jpg"), ('<img src="/placeholder.png"><img src="//cdn.shopify/x.jpg">', "https://cdn.shopify/x.jpg"), ('<img class="product-image" srcset="/p.jpg 2x, /q.jpg">', "https://s.example/p.jpg")):
        assert one_card(spark, named + inside).image_url == image
    assert one_card(spark, named) is None  # no picture
    assert one_card(spark, '<b class="name">Name</b><img src="/a.jpg"><a href="/other/1">go</a>') is None
    assert one_card(spark, '<b class="name">Name</b><img src="/a.jpg"><a href="/other/1">go</a>', link_has="/other/").product_url == "https://s.example/other/1"
    assert one_card(spark, '<b class="name">Na</b><img src="/a.jpg"><a href="/products/1">go</a>') is None


def test_pages_that_are_null_broken_or_bare(spark):
    rows = [("u", None), ("u", ""), ("u", "<div class='product-card'>"), ("https://s.example", "<ul><li class='product'><a href='/products/1'><img src=/1.jpg><b class=name>One two<li class=product><a href='/products/2'><img src='/2.jpg'><b class='name'>Three</b></p></i>"), (None, page(*["<div class=product-card>" + CARD.format(n=5) + "</div>"] * 2)), ("https://s.example", "<<<a <!-- <b>" + "<div>" * 3000)]
    got = selectors.cards(spark.createDataFrame(rows, "url string, html string")).collect()
    assert [(r.title, r.product_url) for r in got] == [("One two", "https://s.example/products/1"), ("Three", "https://s.example/products/2")]
    assert selectors.cards(spark.createDataFrame([], "url string, html string")).count() == 0


def test_selectors():
    root = selectors.Tree("<div id=x class='a b'><p data-k='v1'>one<p>two<br>three</div><p>four").root
    texts = lambda s: [n.text() for n in selectors.find(root, selectors.parse(s))]
    assert texts("div p") == ["one", "twothree"] and texts("p") == ["one", "twothree", "four"] and texts(".b.a [data-k]") == ["one"]
    assert texts("#x [data-k^=v]") == texts('p[data-k="v1"]') == texts("[data-k$='1']") == texts("* [data-k*='v']") == ["one"] and texts("p div") == []
    for bad in ("a > b", "a:first-child", "", "a,b"):
        with pytest.raises(ValueError, match="not a selector"):
            selectors.parse(bad)


def test_product_pages(spark):
    ld = lambda x: f'<script type="application/ld+json">{x}</script>'
    rows = [
        ld('{"offers": {"availability": "http://schema.org/InStock"}}') + "<p class='availability'>Out of stock</p>",
        ld('{"@graph": [{"name": "x"}, {"offers": [{"availability": "OutOfStock"}]}]}'),
        ld("{broken") + ld('[{"offers": {"availability": "SoldOut"}}]'),
        ld('{"offers": {"availability": "InStock"}}') + ld('{"offers": {"offers": [{"availability": "SoldOut"}]}}'),
        ld("{broken") + "<div class='product-availability'>Item is currently <b>Out of Stock</b></div>",
        "<div class='availability'>In stock soon</div>",
        None,
        "<div class='description-and-detail'><p>Lawn &amp; silk</p><div>Care: <b>hand</b></div></div><div class='description-and-detail'>no</div><div class='size-item'><input id='s'><input id='3PC'><input data-attr-value='36'><input id='S'><input id='One Size'><input id='7'></div>",
    ]
    got = selectors.product_pages(spark.createDataFrame([(i, h, "clash") for i, h in enumerate(rows)], "id int, html string, ld string")).orderBy("id").collect()
    assert [r.available for r in got] == [True, False, False, False, False, None, None, None]
    assert got[7].description.split() == ["Lawn", "&", "silk", "Care:", "hand"] and got[7].sizes == ["S", "36", "ONE SIZE"]
    assert got[6].description == "" and got[6].sizes == [] and got[0].ld == "clash"
