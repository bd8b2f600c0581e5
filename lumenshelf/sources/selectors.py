"""Product cards and product pages by lists of selectors, the most specific first.

A page is read once by the standard library's event parser into a small tree; selectors (tag, #id, .class, [attr], [attr=v], [attr*=v],
[attr^=v], [attr$=v], descendants by blanks) are matched against it. JSON-LD goes back to Spark as text and is read there as VARIANT.
A page is parsed by one task; broken HTML gives what can be made of it, null gives nothing. A page without an address keeps absolute
addresses only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_html

#: What cards, titles, prices, pictures and links look like in common shop themes.
CONTAINERS = [".product-item", ".product-card", ".grid__item", ".product-grid-item", "li.item.product", ".grid-view-item", ".product", "[data-product-id]", ".card--product"]
TITLES = [".product-item__title", ".product-title", ".card__heading a", ".product-item-link", "h2 a", "h3 a", ".title a", "a.product-name", ".name"]
PRICES = [".price--sale .money", ".price .money", ".price-item--sale", ".price-item--regular", ".price", ".money", '[class*="price"]']
IMAGES = ["img[data-src]", 'img[src*="cdn.shopify"]', 'img[src*="product"]', "img.product-image", ".product-image-photo", "img"]
LINKS = ["a.product-item__link", 'a[href*="/products/"]', "h2 a", "h3 a", ".card__heading a", "a"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"article", "aside", "blockquote", "body", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "html", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "ul"}
#: An open element of these kinds ends where another one begins, unless one of the second kinds lies between.
CLOSES = {t: ({"p"}, BLOCKS - {"p"}) for t in BLOCKS - {"body", "html", "td", "th"}}
CLOSES |= {"li": ({"li"}, {"ul", "ol"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "a": ({"a"}, BLOCKS)}
STEP = re.compile(r"""(\*|[a-zA-Z][\w-]*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]*)))?\s*\]""")


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None
    inside: list[Node | str] = field(default_factory=list)
    first: int = 0  # where its markup begins and ends in the page
    last: int = 0

    def below(self) -> Iterator[Node]:
        todo = [x for x in reversed(self.inside) if isinstance(x, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [x for x in reversed(node.inside) if isinstance(x, Node)]

    def text(self) -> str:
        out, todo = [], [*reversed(self.inside)]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.inside)
        return "".join(out)


class Tree(HTMLParser):
    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.lines = [0, *(m.end() for m in re.finditer("\n", page))]
        self.feed(page)
        self.close()
        while self.at is not self.root:
            self._end(len(page))

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _end(self, place: int) -> None:
        self.at.last, self.at = place, self.at.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends, held_by = CLOSES.get(tag, ((), ()))
        open_one = self.at
        while open_one is not self.root and open_one.tag not in ends and open_one.tag not in held_by:
            open_one = open_one.parent
        if open_one.tag in ends:
            while self.at is not open_one.parent:
                self._end(self._place())
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, first=self._place() + len(self.get_starttag_text() or ""))
        self.at.inside.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is self.root:
            return  # never opened
        while self.at is not node:
            self._end(self._place())
        self._end(self._place())

    def handle_data(self, data: str) -> None:
        self.at.inside.append(data)


Compound = list[tuple[str, str, str, str]]  # kind, name, operator, value


def parse(selector: str) -> list[Compound]:
    """Compound selectors from ancestor to descendant."""
    out: list[Compound] = []
    spaced = re.sub(r"\s+(?![^\[]*\])", "\n", selector.strip())
    for part in spaced.split("\n"):
        tests: Compound = []
        for m in STEP.finditer(part):
            tag, cls, ident, name, op, *values = m.groups()
            value = next((v for v in values if v is not None), "")
            tests.append(("tag", tag, "", "") if tag else ("class", cls, "", "") if cls else ("attr", "id", "=", ident) if ident else ("attr", name, op or "", value))
        if "".join(m.group(0) for m in STEP.finditer(part)) != part or not tests:
            raise ValueError(f"not a selector: {selector}")
        out.append(tests)
    return out


def fits(node: Node, tests: Compound) -> bool:
    for kind, name, op, value in tests:
        if kind == "tag":
            ok = name == "*" or node.tag == name.lower()
        elif kind == "class":
            ok = name in node.attrs.get("class", "").split()
        else:
            has = node.attrs.get(name.lower())
            ok = has is not None and {"": True, "=": has == value, "*=": bool(value) and value in has, "^=": bool(value) and has.startswith(value), "$=": bool(value) and has.endswith(value)}[op]
        if not ok:
            return False
    return True


def find(top: Node, selector: list[Compound]) -> Iterator[Node]:
    """Nodes below `top`, in the order of the page; their ancestors may lie above it."""
    *above, own = selector
    for node in top.below():
        if not fits(node, own):
            continue
        left, up = [*above], node.parent
        while left and up is not None:
            if fits(up, left[-1]):
                left.pop()
            up = up.parent
        if not left:
            yield node


def first(top: Node, selector: list[Compound]) -> Node | None:
    return next(find(top, selector), None)


def text_of(top: Node, selectors: list[list[Compound]]) -> str:
    """The first line of the first text of three characters or more."""
    for s in selectors:
        node = first(top, s)
        text = node.text().strip() if node else ""
        if len(text) > 2:
            return text.split("\n")[0].strip()
    return ""


def image_of(top: Node, selectors: list[list[Compound]], origin: str) -> str | None:
    for s in selectors:
        node = first(top, s)
        a = node.attrs if node else {}
        src = a.get("data-src") or a.get("data-srcset", "").split(" ")[0] or a.get("srcset", "").split(" ")[0] or a.get("src")
        if not src or "placeholder" in src or "blank" in src:
            continue
        src = ("https:" + src if src.startswith("//") else src).replace("{width}", "600", 1)
        src = src if src.startswith("http") else origin + src
        if src.startswith("http"):
            return src
    return None


def link_of(top: Node, selectors: list[list[Compound]], origin: str) -> str | None:
    around, outer = top, None
    while around is not None and outer is None:
        outer = around.attrs.get("href") if around.tag == "a" else None
        around = around.parent
    for s in selectors:
        node = first(top, s)
        href = (node.attrs.get("href") if node else None) or outer
        if href and href.startswith("http"):
            return href
        if href and href.startswith("/") and origin:
            return origin + href
    return None


def origin_of(url: str) -> str:
    try:
        parts = urlsplit(url or "")
    except ValueError:
        return ""
    return f"{parts.scheme}://{parts.netloc}" if parts.scheme and parts.netloc else ""


CARDS = "page string, position int, container string, title string, price_text string, image_url string, product_url string"


def cards(pages: DataFrame, url: str = "url", html: str = "html", containers: list[str] = CONTAINERS, titles: list[str] = TITLES, prices: list[str] = PRICES, images: list[str] = IMAGES, links: list[str] = LINKS, most: int = 50, link_has: str = "/products/") -> DataFrame:
    """Cards of listing pages with `price`: of the first container selector that has two hits or more and gives a card with a title, a
    picture and a product's address. `most` is the page's limit of cards (None: no limit)."""
    lists = [[(s, parse(s)) for s in containers], *([parse(s) for s in x] for x in (titles, prices, images, links))]
    names = [c.split()[0] for c in CARDS.split(", ")]

    def of_page(page: str | None, source: str | None) -> list[tuple]:
        if not source:
            return []
        boxes, title_s, price_s, image_s, link_s = lists
        root, origin, out = Tree(source).root, origin_of(page), []
        for name, box in boxes:
            hits = list(find(root, box))
            if len(hits) < 2:
                continue
            for node in hits:
                title, image, link = text_of(node, title_s), image_of(node, image_s, origin), link_of(node, link_s, origin)
                if len(title) > 2 and image and link and link_has in link and (most is None or len(out) < most):
                    out.append((page, len(out) + 1, name, title[:200], text_of(node, price_s), image, link))
            if out:
                break
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int32() if n == "position" else pa.string()) for n in names])
        for batch in batches:
            rows = [r for page, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in of_page(page, source)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(names), schema, strict=True)], schema=schema)

    found = pages.select(F.col(url).cast("string"), F.col(html).cast("string")).mapInArrow(run, CARDS)
    # a point before the first digit belongs to the currency (Rs.); eight characters at most count
    number = F.substring(F.regexp_replace(F.regexp_replace("price_text", r"[^\d.]", ""), r"^\.+", ""), 1, 8)
    price = F.round(F.regexp_extract(number, r"^(\d*\.?\d+|\d+)", 1).try_cast("double")).cast("long")
    return found.withColumn("price", F.when(price > 0, price)).drop("price_text")


# --- product pages ------------------------------------------------------------------------------------------------------

SIZE = r"^(?i)(xxs|xs|s|m|l|xl|xxl|xxxl|2xl|3xl|\d{2}|free size|one size)$"
PARTS = "struct<ld:array<string>, stock_text:string, description_html:string, size_labels:array<string>>"


def page_parts(html: Column, stock: list[str], description: str, sizes: str) -> Column:
    """(PARTS) A page's JSON-LD texts, the text of its stock notice, the markup of its description, the labels of its sizes."""
    notes, desc, size = [parse(s) for s in stock], parse(description), parse(sizes)
    ld = parse('script[type="application/ld+json"]')

    def of_page(source: str | None) -> tuple:
        if not source:
            return [], None, None, []
        root = Tree(source).root
        note = next((n for s in notes for n in find(root, s)), None)
        box = first(root, desc)
        labels = [(n.attrs.get("id") or n.attrs.get("data-attr-value") or "").strip() for n in find(root, size)]
        return [n.text() for n in find(root, ld)], note.text() if note else None, source[box.first : box.last] if box else None, labels

    @F.pandas_udf(PARTS)
    def parts(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of_page(x) for x in column], columns=["ld", "stock_text", "description_html", "size_labels"])

    return parts(html.cast("string"))


def graph_nodes(ld: Column) -> Column:
    """array<variant> of the objects of JSON-LD texts: each text's own object, those of a list, those of its @graph. A text that is no
    JSON gives none."""
    none = F.array().cast("array<variant>")
    listed = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), none)
    tops = F.flatten(F.transform(F.filter(F.transform(ld, F.try_parse_json), lambda v: v.isNotNull()), lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), listed(v, "$")).otherwise(F.array(v))))
    return F.flatten(F.transform(tops, lambda v: F.concat(F.array(v), listed(v, "$['@graph']"))))


def ld_availability(nodes: Column) -> Column:
    """What the last node with an offer in or out of stock says; null if none does."""
    said = lambda v: F.coalesce(F.try_variant_get(v, "$.offers.availability", "string"), F.try_variant_get(v, "$.offers[0].availability", "string"), F.try_variant_get(v, "$.offers.offers[0].availability", "string"))
    each = F.array_compact(F.transform(nodes, lambda v: F.when(said(v).rlike("(?i)InStock"), True).when(said(v).rlike("(?i)OutOfStock|SoldOut"), False)))
    return F.try_element_at(each, F.lit(-1))


def product_pages(pages: DataFrame, html: str = "html", stock: list[str] | None = None, description: str = ".description-and-detail", sizes: str = ".size-item input") -> DataFrame:
    """All other columns, with available (JSON-LD first, else the stock notice says out of stock, else null), description (text, 2,000
    characters at most) and sizes (real garment sizes only, capitals, each once)."""
    name = "_parts"
    while name in {c.lower() for c in pages.columns}:
        name += "_"
    read = pages.withColumn(name, page_parts(F.col(html), stock or [".availability", ".product-availability"], description, sizes))
    part = F.col(name)
    notice = F.when(part["stock_text"].rlike("(?i)out of stock"), False)
    real = F.array_distinct(F.transform(F.filter(part["size_labels"], lambda s: s.rlike(SIZE)), F.upper))
    rest = [c for c in pages.columns if c.lower() not in ("available", "description", "sizes")]
    text = strip_html(F.coalesce(part["description_html"], F.lit("")), 2000)
    return read.select(*rest, F.coalesce(ld_availability(graph_nodes(part["ld"])), notice).alias("available"), text.alias("description"), real.alias("sizes"))
