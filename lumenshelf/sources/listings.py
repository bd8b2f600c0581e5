"""Product listings: shop JSON, HTML cards and product pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import price_number, strip_html

VARIANT = "struct<price: string, compare_at_price: string, option1: string, option2: string, option3: string, available: boolean>"
PRODUCT = f"struct<title: string, handle: string, body_html: string, vendor: string, product_type: string, tags: string, images: array<struct<src: string>>, variants: array<{VARIANT}>>"
PAGE = f"products array<{PRODUCT}>"


def collection_url(url: str, page: int = 1, size: int = 250) -> str:
    """The JSON address of a page of a collection."""
    base = re.sub(r"[?#].*$", "", url).rstrip("/")
    return f"{base}/products.json?limit={size}&page={page}"


def site_url(origin: str, size: int = 250) -> str:
    return f"{origin.rstrip('/')}/products.json?limit={size}&page=1"


def read_shop_json(spark: SparkSession, path: str, origin: str, most: int | None = None) -> DataFrame:
    """Saved collection pages (one JSON document a file), a row for each product."""
    rows = spark.read.schema(PAGE).json(path, multiLine=True).select(F.explode("products").alias("p"))
    out = map_product(rows.select("p.*"), origin)
    return out.limit(most) if most else out


def map_product(df: DataFrame, origin: str) -> DataFrame:
    """Raw product -> listing: the first variant's price, distinct sizes and options, available if any variant is."""
    distinct = lambda c: F.array_distinct(F.filter(c, lambda x: x.isNotNull() & ~F.lower(x).isin("", "default title")))
    option = lambda n: F.transform("variants", lambda v: v[f"option{n}"])
    tags = F.when(F.col("tags").startswith("["), F.from_json("tags", "array<string>")).otherwise(F.transform(F.split("tags", ","), lambda t: F.trim(t)))
    first = F.get("variants", F.lit(0))
    return df.select(
        F.col("title"),
        "handle",
        F.transform("images", lambda i: i["src"]).alias("images"),
        price_number(first["price"]).alias("price"),
        price_number(first["compare_at_price"]).alias("compare_at_price"),
        F.concat(F.lit(origin.rstrip("/") + "/products/"), "handle").alias("product_url"),
        distinct(option(1)).alias("sizes"),
        F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t != "").alias("tags"),
        distinct(F.concat(option(2), option(3))).alias("variant_options"),
        strip_html("body_html", 2000).alias("description"),
        "vendor",
        "product_type",
        F.exists("variants", lambda v: F.coalesce(v["available"], F.lit(False))).alias("is_available"),
    )


def any_keyword(df: DataFrame, words: list[str]) -> DataFrame:
    """Listings whose title, type or tags hold one of the words; all of them without words."""
    blob = F.lower(F.concat_ws(" ", "title", "product_type", F.array_join("tags", " ")))
    return df.where(F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(blob, w))) if words else df


def first_source(*attempts: DataFrame) -> DataFrame:
    """The first of several sources that has rows; the last one if none has."""
    for df in attempts[:-1]:
        if not df.isEmpty():
            return df
    return attempts[-1]


class _Cards(HTMLParser):
    """Elements with data-gtmdata JSON, or product links with an image and a price."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cards: list[dict] = []
        self.open: dict | None = None
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if a.get("data-gtmdata"):
            try:
                g = json.loads(a["data-gtmdata"] or "")
            except ValueError:
                g = {}
            if isinstance(g, dict):
                self.cards.append({"title": g.get("name"), "price": g.get("price"), "product_url": g.get("url"), "image_url": g.get("image")})
        kind = a.get("class") or ""
        if self.open is None and re.search(r"(product|grid)-?(card|item|tile)", kind):
            self.open, self.depth = {"title": "", "price": "", "product_url": None, "image_url": None, "in": ""}, 0
        if self.open is not None:
            if tag not in ("img", "br", "input", "meta", "link", "hr", "source"):
                self.depth += 1
            if tag == "a" and a.get("href") and not self.open["product_url"]:
                self.open["product_url"] = a["href"]
            if tag == "img" and not self.open["image_url"]:
                self.open["image_url"] = a.get("src") or a.get("data-src")
            self.open["in"] = "price" if "price" in kind else "title" if re.search("title|name", kind) or tag in ("h2", "h3") else self.open["in"]

    def handle_data(self, data: str) -> None:
        if self.open is not None and self.open["in"] and data.strip():
            self.open[self.open["in"]] += data.strip() + " "

    def handle_endtag(self, tag: str) -> None:
        if self.open is not None:
            self.depth -= 1
            self.open["in"] = ""
            if self.depth <= 0:
                self.open.pop("in")
                self.cards.append(self.open)
                self.open = None


CARDS = "page string, title string, price string, product_url string, image_url string"


def html_cards(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Product cards of listing pages, each product_url once a page; pages with fewer than two cards have none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page", "title", "price", "product_url", "image_url"]
        for pdf in batches:
            out = []
            for page, source in zip(pdf["page"], pdf["html"], strict=True):
                p = _Cards()
                p.feed(source or "")
                found = {c["product_url"]: c for c in reversed(p.cards) if c.get("product_url")}
                if len(found) >= 2:
                    out += [{"page": page, **{k: None if v is None else str(v).strip() for k, v in c.items()}} for c in reversed(found.values())]
            yield pd.DataFrame(out, columns=names)

    rows = pages.select(F.col(url).alias("page"), F.col(html).alias("html")).mapInPandas(parse, CARDS)
    return rows.withColumn("price", price_number("price")).dropDuplicates(["page", "product_url"])


def availability(html: str | Column) -> Column:
    """Whether a product page says that the product is in stock: its JSON-LD availability, else its text; null if neither does."""
    h = F.col(html) if isinstance(html, str) else html
    ld = F.lower(F.regexp_extract(h, r'"availability"\s*:\s*"(?:https?://schema\.org/)?([A-Za-z]+)"', 1))
    words = F.lower(h)
    return F.when(ld != "", ld.isin("instock", "limitedavailability", "preorder")).when(words.rlike(r"out of stock|sold out"), False).when(words.rlike(r"add to (bag|cart)"), True)


def page_sizes(html: str | Column) -> Column:
    """Sizes offered on a product page: letters or one or two digits."""
    h = F.col(html) if isinstance(html, str) else html
    found = F.regexp_extract_all(h, F.lit(r'data-attr-value="([^"]+)"'), F.lit(1))
    return F.array_distinct(F.filter(found, lambda s: s.rlike(r"^(?i)(XXS|XS|S|M|L|XL|XXL|XXXL|\d{1,2})$")))
