"""Shops' pages as offers: listing cards, product pages, descriptions, links to further pages.

Pages are a table; a narrow Arrow map parses each page once and returns the texts that the
shop's rule names, and everything that is told from those texts (prices, stock, links,
JSON-LD) is DataFrame functions.  Nothing is fetched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.price import digits_only, parse_price
from ..functions.text import collapse, infer_category
from .forms import Forms
from .markup import Page, first_of, pick
from .shops import DESCRIPTIONS, DETAILS, LISTINGS, META_DESCRIPTIONS, NEXT_LABELS, NEXT_LINKS, PAGE_PARAMETERS, DetailRule, ListingRule

_KEY = ["page_id", "url", "html", "shop"]
#: Pages that are Python objects at a time, and result rows from which on a batch is handed over.
_SLICE, _MOST_ROWS = 64, 8_192


def absolute(base: str, href: str) -> str:
    """A link as an address: as it is, with a scheme, or behind the shop's own."""
    if not href or href.startswith("http"):
        return href
    if href.startswith("//"):
        return f"https:{href}"
    return f"{base}{'' if href.startswith('/') else '/'}{href}"


_PLAIN_BASE = re.compile(r"https?://[a-z0-9.-]+(?=[/?#]|\Z)")


def base_of(url: str) -> str:
    if plain := _PLAIN_BASE.match(url):
        return plain[0]
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}"


def _rows(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``function`` gives the result rows of one page; a page at a time, in Arrow batches of bounded size."""
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for begin in range(0, batch.num_rows, _SLICE):
                for values in zip(*(c.to_pylist() for c in batch.slice(begin, _SLICE).columns), strict=True):
                    rows += function(*values)
                    if len(rows) >= _MOST_ROWS:
                        yield packed(rows)
                        rows = []
        yield packed(rows)

    return df.mapInArrow(run, schema)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row: a plan that runs projections together would do so at each use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


_CARD = "page_id long, url string, shop string, position int, raw_name string, raw_link string, raw_price string, raw_list string, raw_stock string, variants string, brand string, image string"


def cards(pages: DataFrame, rules: dict[str, ListingRule] = LISTINGS) -> DataFrame:
    """Cards of listing pages (page_id, url, html, shop), as texts; pages of shops without a rule have none."""

    def read(page_id, url, html, shop):
        rule = rules.get(shop)
        if rule is None or not html:
            return
        base = base_of(url or "")
        for (name, link, price, list_price, variants, brand, image), (stock,), seen in _card_forms(rule).cards(html) or _cards(html, rule):
            image = image.split(",")[0].split(" ")[0]
            yield (
                page_id, url, shop, seen, name, absolute(base, link), price, list_price, stock, variants,
                brand or None, absolute(base, image) or C.DEFAULT_IMAGE,
            )

    return _rows(pages.select(*_KEY), read, _CARD)


def _card_parts(rule: ListingRule) -> list[tuple[str, ...]]:
    return [rule.name, rule.link, rule.price, rule.list_price, rule.variants, rule.brand, rule.image]


@lru_cache(maxsize=64)
def _card_forms(rule: ListingRule) -> Forms:
    return Forms(_card_parts(rule), [rule.stock], card=rule.card)


def _cards(html: str, rule: ListingRule) -> Iterator[tuple]:
    """What ``Forms.cards`` gives, of any page."""
    page, seen = Page(html), -1
    for card in page.find(rule.card):
        if card.at <= seen:  # a card inside a card is part of it
            continue
        seen = card.last
        yield [first_of(page, card, where) for where in _card_parts(rule)], [" ".join(pick(page, card, w) for w in rule.stock)], seen


def stock_of_variants(variants: Column) -> Column:
    """Stock of the first of a JSON list of variants; up to three is low."""
    first = F.element_at(F.from_json(variants, "array<struct<available boolean, stock double>>"), 1)
    return (
        F.when((first["available"] == F.lit(False)) | (first["stock"] == 0), "out-of-stock")
        .when((first["stock"] > 0) & (first["stock"] <= 3), "low-stock")
        .when(first["available"] | (first["stock"] > 0), "in-stock")
        .otherwise("unknown")
    )


def _has(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def _stock(rule: ListingRule | DetailRule) -> Column:
    """The stock that a rule tells from raw_stock, variants and name."""
    text, name = F.lower("raw_stock"), F.lower("raw_name")
    there = getattr(rule, "there", ())
    told = F.when(_has(text, rule.sold_out), "out-of-stock").when(_has(text, rule.low), "low-stock")
    if rule.variants:
        return told.otherwise(stock_of_variants(F.col("variants")))
    if there:
        return told.when(F.trim(text) == "", rule.silent).when(_has(text, there), "in-stock").otherwise("unknown")
    told = told.when(F.trim(text) == "", rule.silent) if rule.stock else told
    if isinstance(rule, ListingRule):
        told = told.when(_has(name, rule.sold_out_name), "out-of-stock").when(_has(name, rule.low_name), "low-stock")
    return told.otherwise("in-stock")


def _read_price(text: Column, reading: str) -> Column:
    if reading == "whole":
        return digits_only(F.split_part(text, F.lit(","), F.lit(1)))
    if reading == "amount":
        return digits_only(F.split_part(F.regexp_extract(text, r"\$?([\d.]+)(,\d+)?", 0), F.lit(","), F.lit(1)))
    return parse_price(text)


def by_shop(rules: dict, value: Callable, by: str | None = None) -> Column:
    """The value that the row's shop's rule gives; shops with the same ``by`` in their rules share one expression."""
    shared: dict = {}
    for shop, rule in rules.items():
        shared.setdefault(shop if by is None else getattr(rule, by), []).append((shop, rule))
    return F.coalesce(*(F.when(F.col("shop").isin(*(s for s, _ in same)), value(same[0][1])) for same in shared.values()))


_OFFER = ("page_id", "position", "shop", "name", "price", "list_price", "stock", "brand", "image")


def offers(pages: DataFrame, rules: dict[str, ListingRule] = LISTINGS, wanted: tuple[str, ...] = _OFFER) -> DataFrame:
    """Offers of listing pages: cards with a name, a fitting link and a positive, plausible price, each link once (the first).

    Where not all of an offer is ``wanted``, the rest is not dealt by link either, and null.
    """
    found = cards(pages, rules)
    until = lambda r: collapse(F.split_part("raw_name", F.lit(r.name_until), F.lit(1)) if r.name_until else F.col("raw_name"))
    found = _once(
        found.filter(F.col("raw_link") != ""),
        name=by_shop(rules, until, "name_until"),
        price=by_shop(rules, lambda r: _read_price(F.col("raw_price"), r.reading), "reading"),
        list_price=F.when(F.col("raw_list") != "", parse_price(F.col("raw_list"))).otherwise(0),
        stock=by_shop(rules, _stock),
    )
    fits = by_shop(rules, lambda r: F.col("raw_link").rlike(r.needs) if r.needs else F.lit(True))
    plausible = by_shop(rules, lambda r: F.col("price") <= r.most if r.most else F.lit(True))
    usable = found.filter((F.col("name") != "") & (F.col("price") > 0) & fits & plausible)
    first = usable.groupBy(F.col("raw_link").alias("link")).agg(
        F.min_by(F.struct(*(c for c in _OFFER if c in wanted)), F.struct("page_id", "position")).alias("o")
    )
    kinds = {"page_id": "long", "position": "int", "price": "long", "list_price": "long"}
    first = first.select("link", F.struct(*((F.col(f"o.{c}") if c in wanted else F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in _OFFER)).alias("o"))
    return first.select(
        "o.page_id", F.col("o.shop").alias("store_id"), "o.name", infer_category(F.col("o.name")).alias("category"), "o.price",
        F.when(F.col("o.list_price") > F.col("o.price"), F.col("o.list_price")).alias("original_price"), "o.stock", "o.brand", "link", "o.image",
    )


_DETAIL = "page_id long, url string, shop string, raw_name string, raw_link string, raw_price string, raw_stock string, variants string, raw_image string, raw_description string, scripts array<string>"


def _product_of(scripts: Column) -> Column:
    """The first JSON-LD object of type product, at the top of a block or in its list, as a variant."""
    parsed = F.transform(scripts, F.try_parse_json)
    lists = F.transform(parsed, lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v)))
    kind = lambda v: F.lower(F.try_variant_get(v, "$['@type']", "string"))
    return F.get(F.filter(F.flatten(F.array_compact(lists)), lambda v: kind(v) == "product"), F.lit(0))


def _stock_of_offer(said: Column, level: Column) -> Column:
    """Stock by the offer's availability, in small letters, and inventory; up to three is low."""
    return (
        F.when(said.contains("outofstock") | (level <= 0), "out-of-stock")
        .when(level <= 3, "low-stock")
        .when(level.isNotNull() | said.contains("instock"), "in-stock")
    )


def details(pages: DataFrame, rules: dict[str, DetailRule] = DETAILS) -> DataFrame:
    """Product pages (page_id, url, html, shop) as one offer each; pages without a name or a positive price have none."""

    def read(page_id, url, html, shop):
        rule = rules.get(shop)
        if rule is None or not html:
            return
        base, found = base_of(url or ""), _page_forms(rule).read(html)
        (name, link, price, variants, image, description), (stock,), scripts = found[:3] if found else _parts(html, rule)
        yield page_id, url, shop, name, absolute(base, link) or url, price, stock, variants, absolute(base, image), description, scripts

    found = _once(_rows(pages.select(*_KEY), read, _DETAIL), ld=_product_of(F.col("scripts")))
    offer = F.try_variant_get("ld", "$.offers", "variant")
    offer = F.coalesce(F.try_variant_get(offer, "$[0]", "variant"), offer)
    found = _once(found, offer=offer)
    of = lambda path: F.try_variant_get("ld", path, "string")
    text = lambda path, other: F.coalesce(F.nullif(collapse(of(path)), F.lit("")), F.nullif(other, F.lit("")))
    price = F.coalesce(F.nullif(F.try_variant_get("offer", "$.price", "string"), F.lit("")), F.col("raw_price"))
    said = F.lower(F.coalesce(F.try_variant_get("offer", "$.availability", "string"), F.lit("")))
    found = _once(found, said=price, available=said, level=F.try_variant_get("offer", "$.inventoryLevel.value", "string").try_cast("double"))
    plain = F.col("said").rlike(r"^\d+(\.\d+)?$")
    found = _once(
        found,
        name=text("$.name", F.col("raw_name")),
        price=F.when(plain, F.floor(F.col("said").try_cast("double") + 0.5).cast("long")).otherwise(parse_price(F.col("said"))),
        stock=F.coalesce(_stock_of_offer(F.col("available"), F.col("level")), by_shop(rules, _stock)),
        image=F.coalesce(of("$.image[0]"), F.try_variant_get("ld", "$.image", "string"), F.nullif("raw_image", F.lit(""))),
    )
    usable = found.filter(F.col("name").isNotNull() & (F.col("price") > 0))
    return usable.select(
        "page_id", F.col("shop").alias("store_id"), "name", "price", "stock", F.col("raw_link").alias("link"), F.coalesce("image", F.lit(C.DEFAULT_IMAGE)).alias("image"),
        F.coalesce(text("$.description", F.col("raw_description")), "name").alias("description"),
    )


_LD_JSON = 'script[type="application/ld+json"]'


def _page_parts(rule: DetailRule) -> list[tuple[str, ...]]:
    return [rule.name, rule.link, rule.price, rule.variants, rule.image, rule.description]


@lru_cache(maxsize=64)
def _page_forms(rule: DetailRule) -> Forms:
    return Forms(_page_parts(rule), [rule.stock], _LD_JSON if rule.json_ld else "")


def _parts(html: str, rule: DetailRule) -> tuple[list[str], list[str], list[str]]:
    """What ``Forms.read`` gives first, of any page."""
    page = Page(html)
    scripts = [page.text(e) for e in page.find(_LD_JSON)] if rule.json_ld else []
    return [first_of(page, None, where) for where in _page_parts(rule)], [" ".join(pick(page, None, w) for w in rule.stock)], scripts


def described(value, whole: bool = True) -> str:
    """The first description of a product in a JSON-LD value, in lists, graphs and members too."""
    if isinstance(value, list):
        return next((d for d in map(described, value) if d), "")
    if not isinstance(value, dict):
        return ""
    kind, own = str(value.get("@type") or "").lower(), value.get("description")
    if isinstance(own, str) and own and (not kind or "product" in kind):
        return own
    return described(value.get("@graph")) or next((d for d in map(described, value.values()) if d), "")


def shortened(text: str, limit: int = 700) -> str:
    """At most ``limit`` characters, ending with a sentence or a word where one ends behind the first 120."""
    if len(text) <= limit:
        return text
    cut = text[:limit]
    if (stop := cut.rfind(".")) > 120:
        return cut[: stop + 1].strip()
    return cut[:space].strip() if (space := cut.rfind(" ")) > 120 else cut.strip()


def describe(page: Page, name: str = "", least: int = 24) -> str:
    """Description of a product page: its own parts first, then JSON-LD, then its meta descriptions.

    Texts under ``least`` letters, and the product's name again, say nothing.
    """
    bare = lambda text: re.sub(r"[^\w\s]|_", "", " ".join(text.split()).lower())
    useful = lambda text: len(bare(text)) >= least and (not name or bare(text) != bare(name))
    if found := next((t for where in DESCRIPTIONS if useful(t := pick(page, None, where))), ""):
        return shortened(found)
    for script in page.find(_LD_JSON):
        try:
            text = " ".join(described(json.loads(page.text(script))).split())
        except (ValueError, RecursionError):
            continue
        if useful(text):
            return shortened(text)
    return next((shortened(t) for where in META_DESCRIPTIONS if useful(t := pick(page, None, where))), "")


def numbered(url: str) -> int | None:
    """The number of a listing page in its address, by parameter or as ``/page/N``."""
    parts = urlsplit(url)
    values = parse_qs(parts.query)
    said = next((values[p][0] for p in PAGE_PARAMETERS if p in values), "")
    if re.fullmatch(r"\s*\d+(\.\d+)?\s*", said) and float(said) >= 1:
        return int(float(said))
    m = re.search(r"/page/(\d+)/?$", parts.path, re.IGNORECASE)
    return int(m[1]) if m and int(m[1]) >= 1 else None


def next_page(page: Page, url: str) -> str | None:
    """The linked page of the smallest number above this one's, else a link labelled as next."""
    base, current = base_of(url), numbered(url) or 1
    links = [(absolute(base, e.attrs.get("href", "").strip()), e) for where in NEXT_LINKS for e in page.find(where)]
    above = [(n, link) for link, _ in links if link and link != url and (n := numbered(link)) is not None and n > current]
    if above:
        least = min(n for n, _ in above)
        return next(link for n, link in above if n == least)
    return next((link for link, e in links if link and link != url and " ".join(page.text(e).split()).lower() in NEXT_LABELS), None)


_PAGE = "page_id long, description string, next_url string, n_links long"


def page_facts(pages: DataFrame) -> DataFrame:
    """Description, next page and number of links of each page (page_id, url, html)."""

    def read(page_id, url, html):
        page = Page(html or "")
        yield page_id, describe(page), next_page(page, url or ""), sum(1 for _ in page.find("a[href]"))

    return _rows(pages.select("page_id", "url", "html"), read, _PAGE)
