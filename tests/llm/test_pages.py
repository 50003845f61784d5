"""HTML extraction and WARC archives."""

import hashlib
import time

import pytest

from catalith.llm import html_extract, textkit, warc
from catalith.llm.textkit import shared_dir

PAGE = (
    "<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class='ad'>buy</div>"
    "<article><header><h1>Title &amp; more</h1></header><p>One&nbsp;two\n three<br>four<p><b>five</b>six<!-- gone -->"
    "<script>var t='</p>';</script><aside>side</aside><div class='comments'><p>reader</p></div><ul><li>i<li>j</ul></article>"
    "<footer>&copy; us</footer></body></html>"
)


def test_parse_page():
    assert html_extract.parse_page(PAGE) == ("article", ["Title & more", "One two three four", "fivesix", "i", "j"])
    assert html_extract.parse_page("") == ("open", [])
    assert html_extract.parse_page("<div>a</div>b <i>c</i><form>d</form>") == ("open", ["a", "b c"])
    assert html_extract.parse_page("<main role=main><p class='no-sidebar'>a<p hidden>b</main>c") == ("main", ["a"])
    long = "<p>word" * 20_000 + "<b" * 1000
    assert html_extract.parse_page(long)[1][:19_999] == ["word"] * 19_999


def test_implied_end_tags():
    parse = html_extract.parse_page
    assert parse("<article><p class='ad'>buy<p>real text one<p>real two</article>") == ("article", ["real text one", "real two"])
    assert parse("<ul><li class='share'>x<li>real item</ul><p hidden>h<p>v") == ("open", ["real item", "v"])
    assert parse("<article><table><tr><td class=ad>a<td>b<tr><td>c</table><dl><dt class=promo>d<dd>e</dl></article>") == ("article", ["b", "c", "e"])
    assert parse("<article class='ad'>x</article><article class='entry'>y<ul class=social><li>z<ul><li>w</ul></ul></article>") == ("article", ["y"])


def host_texts(pages):
    """Texts of all pages by counting every run of every host in plain Python."""
    parsed, contents = [], {}
    for page_id, url, html in pages:
        host = None if url is None else url.split("/")[2] if "//" in url else ""
        kind, blocks = html_extract.parse_page(html or "")
        kind = "open" if kind == "open" else "marked"
        parsed.append((page_id, (host, kind), blocks))
        if blocks:
            contents.setdefault((host, kind), set()).add(tuple(blocks))
    width = html_extract.RUN
    runs = lambda words: [(k, tuple(words[k : k + width])) for k in range(max(1, len(words) - width + 1))]
    boilerplate = {}
    for key, pages_of in contents.items():
        held = {}
        for blocks in pages_of:
            for run in {r for b in blocks for _, r in runs(b.split())}:
                held[run] = held.get(run, 0) + 1
        boilerplate[key] = {r for r, n in held.items() if n >= html_extract.PAGES[key[1]] and n >= html_extract.SHARE[key[1]] * len(pages_of)}
    out = []
    for page_id, key, blocks in parsed:
        kept = []
        for b in blocks:
            words = b.split()
            gone = {k + i for k, r in runs(words) if r in boilerplate[key] for i in range(len(r))}
            kept.append(" ".join(w for k, w in enumerate(words) if k not in gone))
        out.append((page_id, "\n".join(k for k in kept if k)))
    return sorted(out, key=str)


def test_extract_equals_brute_force_in_one_group_and_in_many(spark, monkeypatch):
    import random

    r = random.Random(4)
    words = lambda n: " ".join(r.choice("ab cd ef gh ij kl mn op".split()) + str(r.randint(0, 30)) for _ in range(n))
    share, notice, rare, phrase = words(12), words(9), words(20), words(4)
    pages = []
    for k in range(160):
        host = r.choice(["a", "a", "a", "b", "c"])
        url = None if k % 23 == 0 else f"http://{host}.example/{k}"
        text = f"<p>{words(r.randint(1, 40))} {phrase} {words(3)}<p>{words(r.randint(9, 30))} {rare if k % 9 == 0 else ''}"
        if k % 3:  # marked, with a share line in nearly every article of one host
            html = f"<nav>{words(3)}</nav><article>{text}" + (f"<p>{share}" if host == "a" and k % 10 else "") + "</article>"
        else:
            html = f"<div>{notice} {words(1) if k % 2 else ''}</div>{text}<div>Home Contact</div>"
        pages.append((k, url, html))
    pages += [(200 + k, "http://a.example/copy", pages[1][2]) for k in range(30)] + [(300, "", None), (301, None, ""), (None, "http://b.example/", "<p>x")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = host_texts(pages)
    read = lambda: sorted(((x["page_id"], x["text"]) for x in html_extract.extract(table).collect()), key=str)
    assert read() == want
    left = lambda phrase: sum(phrase in t for _, t in want)
    assert left(share) < 10 and left(notice) < 10 and left(rare) > 3  # pages without url are too few to tell
    monkeypatch.setattr(html_extract, "GROUP_PAGES", 7)
    monkeypatch.setattr(textkit, "BROADCAST_ROWS", 0)  # salted joins
    assert read() == want


def test_suffix_array_orders_suffixes():
    import numpy as np

    tokens = np.array([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 1, 4, 1, 5])
    order, _ = html_extract.suffix_array(tokens, len(tokens))
    assert order.tolist() == sorted(range(len(tokens)), key=lambda i: tokens[i:].tolist())


def test_host_boilerplate_goes_and_unique_runs_stay(spark):
    rows = [(k, f"http://h/{k}", f"<div>Share this page now</div><p>Text number {k} alone {'x' * k} here</p><div>All rights kept by us</div>") for k in range(1, 6)]
    rows += [(9, None, None), (10, "http://other/1", "<p>Share this page now</p>"), (11, "http://h/a", PAGE), (11, "http://h/a", PAGE)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as kind")
    out = {r["page_id"]: r for r in html_extract.extract(docs).collect()}
    assert [out[k]["text"] for k in range(1, 6)] == [f"Text number {k} alone {'x' * k} here" for k in range(1, 6)]
    assert out[9]["text"] == "" and out[9]["n_chars"] == 0 and out[10]["text"] == "Share this page now"
    assert out[11]["text"].startswith("Title & more\nOne two")
    assert html_extract.extract(docs).count() == len(rows) and html_extract.extract(docs.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/ü?q=1 2", big), (2, "http://b", big), (3, None, big), (4, "http://c", None), (5, "http://d", ""), (6, "x", "small"), (7, "y", "small"), (None, "z", "z" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as first")
    path = shared_dir(spark, "warc")
    warc.write_archives(pages, path)
    read = warc.read_archives(spark, path)
    got = {r["page_id"]: r for r in read.collect()}
    assert got[1]["url"] == rows[0][1] and got[3]["url"] is None
    for page_id, _, html in rows:
        data = (html or "").encode()
        r = got[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        if page_id in (1, 2):
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", 3, None)
        else:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("response", None, data)
    assert warc.index(spark, path).count() == len(rows)
    # Predicates on headers are taken by the source; payloads stay undecoded on request.
    picked = warc.read_archives(spark, path, payload=False).filter("record_type = 'revisit' and page_id in (2, 4)")
    assert [r["page_id"] for r in picked.collect()] == [2]
    reader = warc.WarcReader(path, True)
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload",), b"")])) == [warc.EqualTo(("payload",), b"")]
    assert reader.wanted == {"record_type": {"response"}}


def test_warc_without_pages(spark):
    path = shared_dir(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_archives_of_other_writers(spark):
    """Gzip without lengths, one member for all records, plain files; warcinfo, HTTP responses, base 32 digests."""
    import base64
    import gzip

    body = b"<p>caf\xc3\xa9</p>" * 200
    digest = hashlib.sha1(body).digest()

    def record(kind, payload, *headers):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", *headers, f"Content-Length: {len(payload)}", "", ""]
        return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    parts = [
        record("warcinfo", b"software: other\r\n", "WARC-Record-ID: <urn:uuid:1>"),
        record("response", http, "WARC-Target-URI: http://a/x", "Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode()),
        record("request", b"GET / HTTP/1.1\r\n\r\n", "warc-target-uri: http://a/x", "Content-Type: application/http"),
        record("resource", body, "WARC-Target-URI: http://a/y"),
    ]
    path = shared_dir(spark, "foreign")
    local = path.removeprefix("file://")
    import os

    os.makedirs(local)
    for name, data in (("a.warc.gz", b"".join(map(gzip.compress, parts))), ("b.warc.gz", gzip.compress(b"".join(parts))), ("c.warc", b"".join(parts)), ("d.txt", b"x")):
        with open(f"{local}/{name}", "wb") as f:
            f.write(data)
    rows = warc.read_archives(spark, path).collect()
    assert sorted(r["record_type"] for r in rows) == sorted(["request", "resource", "response", "warcinfo"] * 3)
    for r in rows:
        if r["record_type"] in ("response", "resource"):
            assert (r["payload"], r["payload_bytes"], r["payload_digest"], r["page_id"]) == (body, len(body), digest.hex(), None)
    headers = warc.read_archives(spark, path, payload=False).filter("record_type = 'response'").collect()
    assert [(r["url"], r["payload"], r["payload_digest"]) for r in headers] == [("http://a/x", None, digest.hex())] * 3


@pytest.mark.parametrize("page", ["<title " * 150_000, "<div>" * 150_000, "<p><table>" + "<div>" * 100_000, '<a "' * 200_000, "<!--" * 200_000, "</p>" * 200_000, "<li>" * 100_000, "<x" * 300_000, "<div></span>" * 80_000], ids=range(9))
def test_long_pages_take_time_in_proportion(page):
    began = time.perf_counter()
    html_extract.parse_page(page)
    assert time.perf_counter() - began < 4


def test_marks_inside_an_article_are_whole_words():
    page = '<article><p class="social-studies">A</p><section id="related-work">B</section><div class="share-buttons">C</div><div class="newsletter">D</div><p>E</p></article>'
    assert html_extract.parse_page(page) == ("article", ["A", "B", "E"])


def test_text_behind_the_last_tag():
    assert html_extract.parse_page("<p>a</p> b < c <!-- d") == ("open", ["a", "b < c"])
    assert html_extract.parse_page("<p>a<!-- b > c") == ("open", ["a"]) and html_extract.parse_page("a<title>b<i>c") == ("open", ["a"])
    assert html_extract.parse_page("<title</title>b") == ("open", []) and html_extract.parse_page("<p>a<script>b</script>c") == ("open", ["ac"])
