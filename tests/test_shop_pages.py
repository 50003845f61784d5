"""Selectors, listing cards, product pages and chains of pages on hand-written pages."""

import time

import pytest
from pyspark.sql import functions as F

from catalith.sources import chains, listings
from catalith.sources.markup import Page, pick
from catalith.sources.shops import LISTINGS, ListingRule

HTML = '<div id="a" class="x y"><p>one<b>two</b></p><p class="z" data-k="v1">three<br>four</div><ul><li><a href="#t">t</a><li><a href="/p/7" rel="next">go</a></ul><p>five'


@pytest.mark.parametrize("selector, want", [
    ("p", ["onetwo", "threefour", "five"]), ("div p", ["onetwo", "threefour"]), ("div > b", []), ("p > b, .z", ["two", "threefour"]), ("#a .z", ["threefour"]),
    ("[data-k^=v]", ["threefour"]), ('a[href*="/p/"]', ["go"]), ('a[href]:not([href^="#"])', ["go"]), (".x.y > p.z", ["threefour"]), ("li a", ["t", "go"]), ("*", None),
])
def test_selectors(selector, want):
    page = Page(HTML)
    found = [page.text(e) for e in page.find(selector)]
    assert found == want if want is not None else len(found) == 11


def test_parts_of_a_card():
    page = Page(HTML)
    card = next(page.find("#a"))
    assert [pick(page, card, w) for w in ("p", "p+", "p~", "p.z@data-k", "@class", "*", "h1")] == ["onetwo", "onetwothreefour", "one", "v1", "x y", "onetwothreefour", ""]


def test_long_pages_take_time_in_proportion():
    for html in ("<div>" * 20_000, "<p>x</i>" * 30_000, "<li>a" * 30_000, "<b" * 3_000):
        began = time.perf_counter()
        list(Page(html).find(".card"))
        assert time.perf_counter() - began < 5


LISTING = """<html><body><div class="card"><h2 class="title">Mouse Logitech &amp; G502 $ 5</h2><img src="/a.png"><span class="price">$ 48.999</span><a href="/p/1">v</a></div>
<div class="card"><h2 class="title">No price</h2><span class="price">$ 0</span><a href="/p/3">v</a></div>
<div class="card"><h2 class="title">Teclado</h2><span class="price">$ 30.000</span><b class="stock">Sin stock</b><a href="/p/2">v</a></div>
<nav class="pagination"><a href="/c?page=3">3</a><a href="/c?page=2">2</a></nav>
<script type="application/ld+json">{"@graph":[{"@type":"Product","description":"Long  text about this very mouse"}]}</script></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, shop string, price string, name int")


def test_listing_pages(spark):
    rule = {"shop": ListingRule(".card", (".title",), ("a@href",), (".price",), stock=(".stock",), name_until="$", most=10_000_000)}
    rows = [(1, "http://s/c?page=1", LISTING), (2, "http://s/c?page=2", LISTING), (3, None, None), (4, "http://s", "<p>no cards")]
    table = pages(spark, [(*r, "shop", "x", 1) for r in rows] + [(5, "http://s", LISTING, "other", "x", 1), (6, "http://s", LISTING, None, "x", 1)])
    got = sorted((r["name"], r["price"], r["stock"], r["link"], r["page_id"]) for r in listings.offers(table, rule).collect())
    assert got == [("Mouse Logitech & G502", 48999, "in-stock", "http://s/p/1", 1), ("Teclado", 30000, "out-of-stock", "http://s/p/2", 1)]
    facts = {r["page_id"]: r for r in listings.page_facts(table).collect()}
    assert facts[1]["next_url"] == "http://s/c?page=2" and facts[1]["description"] == "Long text about this very mouse" and facts[3]["n_links"] == 0
    assert facts[2]["next_url"] == "http://s/c?page=3" and listings.offers(table.limit(0), rule).count() == 0


@pytest.mark.parametrize("html, url, want", [
    ('<div class="pager"><a href="/l/page/3/">3</a><a href="/l/page/2">2</a></div>', "https://s.example/l", "https://s.example/l/page/2"),
    ('<a rel="next" href="//cdn.example/l?paged=5">x</a>', "https://s.example/l?paged=4", "https://cdn.example/l?paged=5"),
    ('<div class="pagination"><a href="?x"> » </a></div>', "https://s.example/l?page=9", "https://s.example/?x"),
    ('<a class="next" href="/l?page=2">2</a>', "https://s.example/l?page=2", None),
    ('<nav aria-label="Pagination"><a href="/l?pagina=3">3</a></nav>', "https://s.example/l?pagina=2", "https://s.example/l?pagina=3"),
    ("<a href='/l?page=2'>2</a>", "https://s.example/l", None),
])
def test_next_page(html, url, want):
    assert listings.next_page(Page(html), url) == want


def test_descriptions_come_from_the_page_first():
    own, ld, meta = "A long text of the page about it.", "A long text of the block about it.", "A long text for cards about it."
    block, tag = f'<script type="application/ld+json">{{"@type":"Product","description":"{ld}"}}</script>', f'<meta property="og:description" content="{meta}">'
    of = lambda *parts, name="": listings.describe(Page("".join(parts)), name)
    assert of(f'<p class="descripcion">{own}</p>', block, tag) == own and of('<div id="description">short</div>', block, tag) == ld
    assert of(tag) == meta and of(tag, name="A LONG text, for cards about it") == "" and of("<p>none</p>") == ""
    assert of(f'<p class="short-description">{"word " * 300}</p>').endswith("word") and len(of(f'<p class="short-description">{"A sentence of words. " * 60}</p>')) <= 700


def test_product_pages(spark):
    woo = """<html><head><link rel="canonical" href="/producto/rtx-5070-ti/"/><meta property="og:description" content=" GPU premium "/></head><body>
<h1 class="product_title">Placa de video ASUS RTX 5070 Ti</h1><p class="price"><span class="woocommerce-Price-amount"><bdi>$ 1.249.999,00</bdi></span></p>
<div class="woocommerce-product-gallery__wrapper"><img src="/media/rtx.webp"/></div><p class="stock">Ultimas unidades</p></body></html>"""
    ld = '<script type="application/ld+json">{"@type":"Product","name":"SSD Kingston","image":["https://cdn/i.png"],"offers":{"price":"899999","inventoryLevel":{"value":5}}}</script><h1>other</h1>'
    gone = '<script type="application/ld+json">broken {</script><div class="js-product-container" data-variants="[{&quot;available&quot;:true,&quot;stock&quot;:2}]"><h1>Mouse</h1><span class="price">$ 9.500</span></div>'
    table = pages(spark, [(1, "https://t.test/producto/rtx-5070-ti/", woo, "woocommerce", "", 0), (2, "https://n.test/productos/ssd/", ld, "tiendanube", "", 0), (3, "https://n.test/m", gone, "tiendanube", "", 0), (4, "https://n.test/m", "<h1>x</h1>", "tiendanube", "", 0), (5, None, None, "woocommerce", "", 0)])
    got = {r["page_id"]: (r["name"], r["price"], r["stock"], r["link"], r["image"], r["description"]) for r in listings.details(table).collect()}
    assert got == {
        1: ("Placa de video ASUS RTX 5070 Ti", 1_249_999, "low-stock", "https://t.test/producto/rtx-5070-ti/", "https://t.test/media/rtx.webp", "GPU premium"),
        2: ("SSD Kingston", 899_999, "in-stock", "https://n.test/productos/ssd/", "https://cdn/i.png", "SSD Kingston"),
        3: ("Mouse", 9_500, "low-stock", "https://n.test/m", "/pixel-box.svg", "Mouse"),
    }


def test_rules_name_known_parts():
    assert len(LISTINGS) == 14 and all(r.card and r.name and r.link and r.price for r in LISTINGS.values())


def plain_chain(start, budget, links, shown, numbering):
    url, number, been, seen, visits = start, 1, set(), set(), []
    while url and number <= budget and url not in been:
        been.add(url)
        new = [i for i in dict.fromkeys(shown.get(url, [])) if i not in seen]
        seen.update(new)
        visits.append((number, url, len(new)))
        if not new or url not in links:
            break
        number += 1
        following = links[url]
        if numbering:
            base, _, asked = (following or start).partition("?")
            parts = [p for p in asked.split("&") if p and not p.startswith("page=")]
            following = f"{base}?{'&'.join([*parts, f'page={number}'])}"
        url = following
    return visits


@pytest.mark.parametrize("numbering", [True, False])
def test_chains_against_a_loop(spark, numbering):
    links = {"a": "a?page=2", "a?page=2": "a?page=3", "a?page=3": "a?page=2", "b": None, "b?page=2": None, "b?page=3": None, "c": "c", "d?x=1": "d?x=1&page=2", "d?x=1&page=2": None, "e": "a", "f": "gone"}
    shown = {"a": [1, 2], "a?page=2": [2, 3], "a?page=3": [4], "b": [1], "b?page=2": [2, 2], "b?page=3": [1, 2], "c": [9], "c?page=2": [9], "d?x=1": [5], "d?x=1&page=2": [5, 6], "e": [7], "f": [1]}
    table = spark.createDataFrame([*links.items(), ("a", "a?page=2")], "url string, next_url string")
    items = spark.createDataFrame([(u, i, k) for u, own in shown.items() for k, i in enumerate(own)], "url string, item long, place int")
    starts = [(f"{u}-{b}", u, b) for u in ("a", "b", "c", "d?x=1", "e", "f", "nowhere") for b in (0, 1, 2, 9)]
    visits, found = chains.follow(spark.createDataFrame(starts, "chain string, url string, budget int"), table, items, numbering)
    want = {(c, *v) for c, u, b in starts for v in plain_chain(u, b, links, shown, numbering)}
    assert {(r["chain"], r["number"], r["url"], r["n_new"]) for r in visits.collect()} == want
    assert found.groupBy("chain").count().filter("chain = 'a-9'").first()["count"] == (4 if not numbering else 4)
    empty, none = chains.follow(spark.createDataFrame([], "chain string, url string, budget int"), table, items)
    assert empty.count() == 0 and none.count() == 0
    assert found.filter(F.col("number") > 9).count() == 0


def shape(page):
    return [(e.tag, e.attrs, e.classes, e.parent.at if e.parent else None, e.last, page.text(e), page.first_text(e)) for e in page.elements], "".join(page.texts)


def test_plain_pages_read_as_the_parser_reads_them(monkeypatch):
    plain = [
        "<p class='a b' DATA-K=\"x&quot;y\" hidden>one &amp; two<br>three &lt three</p>tail &copy", "<div/><b>x</b></i></div>", "<UL><li>a<li class=\"\" class='c'>b</UL >",
        '<script type="application/ld+json">{"a":"&amp;"}</script><p>x', "<script></script>", "", "just & text", '<img alt="a &#39; b"/>', LISTING.replace("@graph", "@g"),
    ]
    other = ["<!-- <p> -->x", "<a href=x>y</a>", "<style>p > a</style>", "a < b <p>c", "<script>if (a < b) {}</script>z", "<title>a<b></title>", '<a href="?a=1&copy=2">x</a>', "<p", "<!doctype html><p>x"]
    fast = [Page(h) for h in plain + other]
    assert [p._read_plain(h) for p, h in zip([Page("") for _ in plain + other], plain + other, strict=True)] == [True] * len(plain) + [False] * len(other)
    monkeypatch.setattr(Page, "_read_plain", lambda self, html: False)
    assert [shape(p) for p in fast] == [shape(Page(h)) for h in plain + other]


def test_selectors_on_long_pages_find_what_going_through_all_finds(monkeypatch):
    from catalith.sources import markup

    html = "".join(f'<div class="c{k % 5} card" id="i{k}"><p><a href="/p/{k}">{k}</a></p><b class="x" data-k="{k % 3}">z</b></div>' for k in range(100))
    selectors = ["*", ".c1 a", "#i7 b, #i3 p", "div > b", "p, .x", "[data-k=1], .c2", ":not(.x)", "a:not([href$=\"3\"])", ".none, b", ".none", ".c3 > p > a[href*=\"8\"]", "div"]
    found = lambda: [[e.at for e in Page(html).find(s)] for s in selectors]
    by_places = found()
    monkeypatch.setattr(markup, "_FEW", 10**9)
    assert by_places == found() and all(by_places[k] for k in range(len(selectors)) if selectors[k] != ".none")


def test_chains_of_many_selectors_are_quick():
    """Page facts of a long listing page: selectors whose classes a page does not have cost nothing."""
    html = "<ul>" + '<li class="type-product"><h2>P</h2><a href="/producto/1/">ver</a><span class="amount">$ 10.000</span></li>' * 4_000 + "</ul>"
    page, began = Page(html), time.perf_counter()
    for _ in range(100):
        assert listings.describe(page) == ""
    assert time.perf_counter() - began < 0.5


def _shop_card(shop, form, name, n, price, said):
    from catalith.queries.shop_pages import CARDS

    parts = {"href": CARDS[shop][0].replace("{id}", str(n)), "price": price, "n": str(n), "said": said, "name": name}
    card = CARDS[shop][1 + form]
    for place, value in parts.items():
        card = card.replace(f"{{{place}}}", value)
    return card


ODD_PIECES = [
    "<!-- x -->", "<div class='x'>", '<a href="?a=1&copy=2">y</a>', "</p>", "text & <b>more</b>", '<div class="product item type-product"', "<script>var a = 1</script>",
    '<div class="product-list"><div class="product-list"><h3>in</h3></div></div>', "<A HREF=\"/one\" href=\"/two\">z</A>", "<i title=' src=\"x\"' src=\"x\">i</i>", "",
]


@pytest.mark.parametrize("shop", sorted(LISTINGS))
def test_cards_of_known_forms_are_those_of_whole_pages(shop):
    """Cards told by their form, among odd pieces, in either order and at the page's end, against the page's tree."""
    import random

    from catalith.queries.shop_pages import CARDS

    r, rule, told = random.Random(shop), LISTINGS[shop], 0
    names, prices = ["Mouse", "A &amp; B", "", "  two  spaces ", "5 > 4", "#", "x&copy"], ["$ 1.234", "", "$ 5,50 $ 6"]
    for trial in range(80):
        cards = [_shop_card(shop, r.randint(0, 1), r.choice(names) + str(k), k, r.choice(prices), r.choice([*CARDS[shop][3], "z"])) for k in range(r.randint(0, 5))]
        if trial % 2:
            cards.insert(r.randint(0, len(cards)), r.choice([*ODD_PIECES, *(c[: len(c) // 2] for c in cards), *(c.replace('"', "'") for c in cards), *(c.replace("</", "<x></", 1) for c in cards)]))
        html = f"<html><body><header><a href='/'>i</a></header><main>{r.choice(['', ' ']).join(cards)}</main></body></html>"[: r.choice([10**6, -1, -20])]
        found, want = listings._card_forms(rule).cards(html), [(a, b, place) for a, b, place in listings._cards(html, rule)]
        assert found is None or [(list(a), list(b), place) for a, b, place in found] == want
        told += bool(found)
    assert told > 4


def test_rules_are_worked_out_once_a_form(monkeypatch):
    """Reading many cards of one form builds the tree of a few pieces only."""
    cards = [_shop_card("woocommerce", k % 2, f"Mouse {k}", k, f"$ {k + 1}.000", "outofstock" if k % 3 else "") for k in range(3_000)]
    forms, read, seen = listings.Forms(listings._card_parts(LISTINGS["woocommerce"]), [LISTINGS["woocommerce"].stock], card=LISTINGS["woocommerce"].card), Page._read_plain, []
    monkeypatch.setattr(Page, "_read_plain", lambda self, html: seen.append(len(html)) or read(self, html))
    assert len(forms.cards(f"<ul>{''.join(cards)}</ul>")) == 3_000 and sum(seen) < 20_000


def test_pages_come_in_batches_of_bounded_size(spark):
    """Ten pages of a thousand cards each are not one batch of ten thousand rows and more."""
    import pyarrow as pa

    table = spark.range(10).selectExpr("id AS page_id", "repeat('<a>x</a>', 1000 * CAST(1 + id AS INT)) AS html").coalesce(1)
    found = listings._rows(table, lambda page_id, html: [(page_id, k) for k in range(html.count("<a>"))], "page_id long, n int")
    sizes = found.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in batches), "n long")
    assert found.groupBy("page_id").count().agg(F.sum("count")).first()[0] == 55_000 and max(r["n"] for r in sizes.collect()) < 20_000


def test_unwanted_parts_of_offers_are_null(spark):
    rule = {"shop": ListingRule(".card", (".title",), ("a@href",), (".price",), stock=(".stock",), name_until="$", most=10_000_000)}
    table = pages(spark, [(1, "http://s/c?page=1", LISTING, "shop", "x", 1)])
    whole, part = listings.offers(table, rule), listings.offers(table, rule, wanted=("name", "price"))
    assert whole.dtypes == part.dtypes and sorted(whole.select("link", "name", "price").collect()) == sorted(part.select("link", "name", "price").collect())
    assert part.filter("stock IS NOT NULL OR image IS NOT NULL OR page_id IS NOT NULL").count() == 0 and whole.filter("image IS NULL").count() == 0


def test_one_plain_amount_is_read_as_any_other(spark):
    from catalith.functions import price

    texts = ["$ 1.234.567", "1.234", "  $12", "0", "000", "$ 1.234,50", "1.23", "12.345.6", "$ 5 $ 6", "12 cuotas", "999999999999999", "1234567890123456", "1.000\n", "", "$", "1.234 ", "$ 0.000"]
    rows = spark.createDataFrame([(t, f"{t} ;") for t in texts], "a string, b string")
    found = rows.select("a", price.parse_price(F.col("a")).alias("x"), price.parse_price(F.col("b")).alias("y")).collect()
    assert [(r["a"], r["x"]) for r in found if r["x"] != r["y"]] == []


@pytest.mark.parametrize("shop", ["tiendanube", "woocommerce", "foxtienda", "xtpc", "portaltech"])
def test_product_pages_of_known_forms_are_those_of_whole_pages(shop, monkeypatch):
    from catalith.sources.shops import DETAILS

    rule = DETAILS[shop]
    bodies = [
        '<html><head><link rel="canonical" href="{h}"><meta property="og:title" content="{t}"><meta name="description" content="{d}"></head><body><h1 class="product_title">{t}</h1><p class="price"><b>{p}</b>$ 5</p><img src="{h}"><p class="stock">{s}</p></body></html>',
        '<link rel="canonical" href="{h}"><script type="application/ld+json">{{"name":"{t}"}}</script><script>var x</script><h1>{t}</h1><h2 class="descripcion-producto">{t}<i>!</i></h2><span class="price">{p}</span><div class="js-product-container" data-variants="{s}"></div>',
        "{t}<h1>{t}</h1>", "<h1 title='{t}' title=\"{h}\">{t}</h1><div itemprop='description'>{d}</div>",
    ]
    pages = [b.format(h=f"/p/{k}", t=t, d=d, p=f"$ {k}.000", s=s) for b in bodies for k, t in enumerate(["A", "B &amp; C", " x  y ", "5 &gt", "z"]) for d in ("", "long text") for s in ("", "Agotado", "[{&quot;stock&quot;:2}]")]
    known = [listings._page_forms(rule).read(p) for p in pages]
    assert [tuple(map(list, f[:3])) for f in known if f] == [tuple(map(list, listings._parts(p, rule))) for p, f in zip(pages, known, strict=True) if f] and sum(map(bool, known)) > 40
    read, seen = Page._read_plain, []
    monkeypatch.setattr(Page, "_read_plain", lambda self, html: seen.append(html) or read(self, html))
    assert all(listings._page_forms(rule).read(bodies[0].format(h=f"/q/{k}", t=f"T{k}", d="d", p=f"$ {k}", s="x")) for k in range(500)) and len(seen) < 9


@pytest.mark.parametrize("url", ["https://a.b/c?x#y", "http://a", "http://a?b", "https://a:80/x", "https://u@h/x", "HTTPS://A/x", " https://a/x", "https:///x", "//a/b", "", "https://a.b\\c/x", "https://a\tb/c"])
def test_base_of_an_address(url):
    from urllib.parse import urlsplit

    parts = urlsplit(url)
    assert listings.base_of(url) == f"{parts.scheme}://{parts.netloc}"


def test_chains_read_the_pages_they_come_to(spark):
    """Pages are read a round at a time, and those that no chain reaches are not; visits are those over tables of all pages."""
    links = {"a": "a?page=2", "a?page=2": "a?page=3", "a?page=3": None, "b": None, "far": "a", "b?page=2": None}
    shown = {"a": [1, 2], "a?page=2": [2, 3], "a?page=3": [4], "b": [1], "b?page=2": [1], "far": [7]}
    stored = spark.createDataFrame([(*x, shown[x[0]]) for x in links.items()], "url string, next_url string, own array<long>")
    items = lambda rows: rows.selectExpr("url", "posexplode(own) AS (place, item)")
    starts = spark.createDataFrame([("x", "a", 3), ("y", "b", 9), ("z", "gone", 2)], "chain string, url string, budget int")
    seen = []

    def read(rows):
        seen.append(sorted(r["url"] for r in rows.collect()))
        return rows.select("url", "next_url"), items(rows)

    visits, found = chains.follow_reading(starts, stored, read)
    want, all_found = chains.follow(starts, stored.select("url", "next_url"), items(stored))
    assert sorted(visits.collect()) == sorted(want.collect()) and sorted(found.collect()) == sorted(all_found.collect())
    assert seen == [["a", "b"], ["a?page=2", "b?page=2"], ["a?page=3"]]
