"""Main text of HTML pages: a suffix array per host over what the page's own structure leaves.

1. *Blocks.*  ``parse_page`` cuts a page into blocks and drops those that the page itself
   marks as menus, headers, footers, sidebars, notices, adverts, forms, scripts or comments.
   Blocks inside an article (or, failing that, a main element) are candidates; where a page
   marks neither, all its blocks are (an *open* page).
2. *Repeats.*  The token streams of a host's pages of one kind (marked or open) are
   concatenated, and a suffix array finds the runs of ``RUN`` tokens (whole blocks, if they
   are shorter) that recur on distinct pages.  Copies of a page are one content and count
   once.  Runs on ``PAGES`` contents and on the share ``SHARE`` of the host's contents of that
   kind are boilerplate; pages that mark their article must agree more widely.
3. *Removal.*  Tokens that a boilerplate run covers go; unique runs stay, in page order.

A host may hold a third of all pages, so its contents are dealt by hash to groups of about
``GROUP_PAGES``, each with a suffix array of its own.  A run on a share of the host is on
that share of some group at least, so the groups name every run that can qualify; those few
are then counted over all pages of the host, so the grouping does not change the result.
Each of the three passes parses the pages anew, and only the second half of the first moves
texts, each content once per task.

Edge cases: a null or empty page has an empty text; elements with implied ends (p, li, dd,
dt, tr, td, th, option) are closed as HTML closes them, other unclosed and crossed tags by
their ancestors; pages without url are a host of their own, pages of an empty one another;
repeated page_ids keep their rows; a page is parsed whole whatever its length.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import attach, cut, map_slices, mix64, slices, split_words, text_buffer

#: Tokens of a run; least contents and share of contents that make it boilerplate, by kind of page.
RUN = 8
PAGES = {"open": 3, "marked": 10}
SHARE = {"open": 0.2, "marked": 0.5}
GROUP_PAGES = 1000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|object|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*)[^>]*>"
    r"|<[!?][^>]*>",
    re.IGNORECASE | re.DOTALL,
)
_START = re.compile(r"<[a-z]+(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.IGNORECASE)
_ATTR = re.compile(r"([a-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
#: Fixed lists of HTML element names.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_SPACING = {"br", "td", "th", "img", "wbr", "option"}
_CHROME = set("nav aside form footer header button select dialog menu head label input".split())
_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Words in class names and ids that mark a block as something other than the text.
_MARKS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer form menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related replies share "
    "sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_HEADER_MARKS = {"header", "masthead", "topbar"}
#: What may stand beside a mark in a name inside the text, where a mark alone may be a word of the subject ("social-studies").
_PARTS = set(
    "area articles bar block body box btn button buttons card cards container content count group icon icons inner item items label line link links list main "
    "message nav outer overlay panel post posts section site slot stories strip text title top bottom left right unit wrap wrapper zone top1 js u c l o is".split()
)
#: Marks of articles that are not the page's own.
_TEASER_MARKS = set("ad ads advert adverts advertisement advertising promo related sponsor sponsored teaser".split())
#: Elements whose start closes others that are open, and what an open one must not lie behind.
_CLOSES_P = _BLOCK - set("body caption dd dt figcaption head html legend li summary tbody tfoot thead tr".split())
_IMPLIED = {
    "li": ({"li"}, _BLOCK - {"address", "div", "p", "li"}),
    "dd": ({"dd", "dt"}, _BLOCK - {"address", "div", "p", "dd", "dt"}),
    "dt": ({"dd", "dt"}, _BLOCK - {"address", "div", "p", "dd", "dt"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist"}),
} | {t: ({"thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")}
_P_SCOPE = {"table", "td", "th", "caption", "button", "object"}


def _marked(tag: str, attrs: str, in_text: bool) -> bool:
    """Whether an element and all it holds is chrome."""
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return any(m[1].lower() == "class" and _TEASER_MARKS & set(re.split(r"[-_ ]+", (m[2] or m[3] or m[4] or "").lower())) for m in _ATTR.finditer(attrs))
    if tag in _CHROME:
        return not (tag == "header" and in_text)
    if "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = set(re.split(r"[-_]+", word))
                if word.startswith(("no-", "has-", "with-", "without-")):
                    continue
                if parts & _MARKS and (not in_text or all(p in _MARKS or p in _PARTS or not p.isalpha() for p in parts)):
                    return True
                if not in_text and parts & _HEADER_MARKS:
                    return True
    return False


def _container(tag: str, attrs: str) -> str:
    if tag == "article" or "articlebody" in attrs.lower():
        return "article"
    return "main" if tag == "main" or re.search(r"role\s*=\s*[\"']?main\b", attrs, re.IGNORECASE) else ""


def _unended(m: re.Match) -> bool:
    """Whether a comment or an element that holds text alone runs to the end of the page."""
    if m["raw"]:
        return not re.search(rf"</{m['raw']}\s*>\Z", m[0][_START.match(m[0]).end() :], re.IGNORECASE)
    return m[0].startswith("<!--") and not m[0].endswith("-->")


def parse_page(page: str) -> tuple[str, list[str]]:
    """("article" | "main" | "open", blocks in page order) of a page."""
    blocks: dict[str, list[str]] = {"article": [], "main": [], "open": []}
    seen: set[str] = set()
    stack: list[tuple[str, bool, str]] = []  # (tag, chrome, container)
    places: dict[str, list[int]] = defaultdict(list)  # of each tag's open elements in the stack
    chrome, inside = 0, {"article": 0, "main": 0}
    pieces: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            blocks["open"].append(text)
            for kind in ("article", "main"):
                if inside[kind]:
                    blocks[kind].append(text)

    def pop() -> None:
        nonlocal chrome
        tag, was_chrome, kind = stack.pop()
        places[tag].pop()
        chrome -= was_chrome
        if kind:
            inside[kind] -= 1

    def last(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close(tags: set[str], barriers: set[str]) -> None:
        k = last(tags)
        if k > last(barriers):
            while len(stack) > k:
                pop()

    # Behind the last ">" nothing but an open comment can begin, so no tag is sought there.
    at, end = 0, page.rfind(">") + 1
    for m in _TOKEN.finditer(page, 0, end):
        if not chrome and m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        if at == end and _unended(m):
            at = len(page)
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag in _BLOCK:
            flush()
        elif tag in _SPACING:
            pieces.append(" ")
        if m["end"] or m["end2"]:
            if places.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _CLOSES_P:
            close({"p"}, _P_SCOPE)
        if tag in _IMPLIED:
            close(*_IMPLIED[tag])
        if tag not in _VOID and not (m["attrs"] or "").endswith("/"):
            if tag == "body":
                while stack and stack[-1][0] == "head":
                    pop()
            attrs = m["attrs"] or ""
            is_chrome = _marked(tag, attrs, bool(inside["article"] or inside["main"]))
            kind = "" if chrome or is_chrome else _container(tag, attrs)
            places[tag].append(len(stack))
            stack.append((tag, is_chrome, kind))
            chrome += is_chrome
            if kind:
                inside[kind] += 1
                seen.add(kind)
    if not chrome:
        pieces.append(page[at:].split("<!--")[0])
    flush()
    kind = "article" if "article" in seen else "main" if "main" in seen else "open"
    return kind, blocks[kind]


# ---------------------------------------------------------------- suffix array

def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of suffixes by their first ``depth`` tokens or more, by prefix doubling.

    Suffixes with equal ranks agree in their first ``depth`` tokens (rounded up to a power of two).
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    length = 1
    while True:
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-length] = rank[length:] + 1
        order = np.lexsort((after, rank))
        if length >= depth:
            return np.argsort(rank, kind="stable"), rank
        changed = np.r_[False, (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])]
        new = np.empty(len(rank), dtype=np.int64)
        new[order] = np.cumsum(changed)
        rank, length = new, 2 * length
        if length >= depth or rank.max(initial=0) == len(rank) - 1:
            return order, rank


class Blocks:
    """Words of the blocks of some pages, and the hashes of their runs."""

    def __init__(self, pages: list[list[str]]) -> None:
        flat = [b for blocks in pages for b in blocks]
        self.page_of_block = np.repeat(np.arange(len(pages)), [len(b) for b in pages])
        self.words = split_words(*text_buffer(pa.array(flat, pa.string())))
        self.hashes = self.words.hashes()
        at, run = self.words.windows(self.hashes, RUN)
        counts, first = self.words.counts, self.words.first[:-1]
        short = np.flatnonzero((counts > 0) & (counts < RUN))
        whole = counts[short].astype(np.uint64)
        for k in range(RUN - 1):
            more = counts[short] > k
            whole[more] = mix64(whole[more] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[first[short][more] + k])
        self.at, self.run = np.r_[at, first[short]], np.r_[run, whole]
        self.length = np.r_[np.full(len(at), RUN), counts[short]]
        self.page = self.page_of_block[self.words.row[self.at]] if len(self.at) else np.zeros(0, dtype=np.int64)

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """(token stream with RUN - 1 closing marks of its own behind every block, place of each word in it)."""
        place = np.arange(len(self.hashes)) + self.words.row * (RUN - 1)
        stream = np.zeros(len(self.hashes) + len(self.page_of_block) * (RUN - 1), dtype=np.int64)
        stream[place] = np.unique(self.hashes, return_inverse=True)[1] + 1
        return stream, place


def repeated_runs(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(run hash, number of pages that hold it) of every run, by a suffix array."""
    blocks = Blocks(pages)
    if not len(blocks.at):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    stream, place = blocks.stream()
    _, rank = suffix_array(stream, RUN)
    # Distinct pages among suffixes that share their first RUN tokens.
    mine = rank[place[blocks.at]]
    by = np.lexsort((blocks.page, mine))
    first = np.r_[True, (mine[by][1:] != mine[by][:-1]) | (blocks.page[by][1:] != blocks.page[by][:-1])]
    held = np.bincount(mine[by][first], minlength=int(mine.max()) + 1)
    runs, where = np.unique(mine, return_index=True)
    return blocks.run[where], held[runs]


def without_runs(pages: list[list[str]], runs: np.ndarray) -> list[str]:
    """The text of each page without the words that one of its ``runs`` (per word of all pages, sorted hashes) covers."""
    blocks = Blocks(pages)
    hit = np.isin(blocks.run, runs)
    gone = np.zeros(len(blocks.hashes) + 1, dtype=np.int64)
    np.add.at(gone, blocks.at[hit], 1)
    np.add.at(gone, blocks.at[hit] + blocks.length[hit], -1)
    covered, first = np.cumsum(gone)[:-1] > 0, blocks.words.first
    out, k = [], 0
    for page in pages:
        kept = []
        for block in page:
            marks = covered[first[k] : first[k + 1]]
            kept.append(" ".join(w for w, c in zip(block.split(" "), marks, strict=True) if not c) if marks.any() else block)
            k += 1
        out.append("\n".join(b for b in kept if b))
    return out


# ---------------------------------------------------------------- passes over the pages

_KIND = {"article": "marked", "main": "marked", "open": "open"}


def _content(blocks: list[str]) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.md5("\n".join(blocks).encode("utf-8", "surrogatepass")).digest())


def _attach(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pages with a table of hosts; a host may hold a third of all pages."""
    return attach(pages, hosts, ["host"], salt_by=["page_id"])


def _group_runs(table: pa.Table) -> pa.Table:
    """Runs of one group of a host on the kind's share of its contents, and the number of its contents.

    A run on one content only can be repeated in other groups, if there are any.
    """
    host, kind = table.column("host")[0].as_py(), table.column("kind")[0].as_py()
    runs, held = repeated_runs(table.column("blocks").to_pylist())
    least = 1 if table.column("groups")[0].as_py() > 1 else 2
    runs = runs[held >= max(least, SHARE[kind] * table.num_rows)]
    return pa.table({"host": [host] * (len(runs) + 1), "kind": [kind] * (len(runs) + 1), "run": pa.array([None, *runs.view(np.int64).tolist()], pa.int64()), "contents": pa.array([table.num_rows] + [0] * len(runs), pa.int64())})


def _contents(pages: DataFrame) -> DataFrame:
    """(host, kind, group, c1, c2, blocks) of every content, once per task; pages carry host and groups."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            for part in slices(batch, "html"):
                rows = []
                for host, groups, html in zip(*(part.column(c).to_pylist() for c in ("host", "groups", "html")), strict=True):
                    kind, blocks = parse_page(html or "")
                    c1, c2 = _content(blocks)
                    key = (host, _KIND[kind], c1, c2)
                    if blocks and key not in seen:
                        if len(seen) >= 100_000:
                            seen.clear()
                        seen.add(key)
                        rows.append((host, _KIND[kind], groups, c1 % groups, c1, c2, blocks))
                if rows:
                    types = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["host", "kind", "groups", "group", "c1", "c2", "blocks"])

    return pages.mapInArrow(run, "host string, kind string, groups long, group long, c1 long, c2 long, blocks array<string>")


def _held(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(host, kind, run, content) of the candidate runs that each page holds."""
    rows = []
    for host, html, runs in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "runs")), strict=True):
        kind, blocks = parse_page(html or "")
        mine = {r["run"] for r in runs if r["kind"] == _KIND[kind]}
        if mine:
            found = np.unique(Blocks([blocks]).run.view(np.int64))
            rows += [(host, _KIND[kind], run, *_content(blocks)) for run in found.tolist() if run in mine]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.string(), pa.string(), *[pa.int64()] * 3], strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["host", "kind", "run", "c1", "c2"])


def _texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, kinds = [], []
    for html, runs in zip(batch.column("html").to_pylist(), batch.column("runs").to_pylist(), strict=True):
        kind, blocks = parse_page(html or "")
        mine = [r["run"] for r in runs or () if r["kind"] == _KIND[kind]]
        texts.append(without_runs([blocks], np.array(mine, dtype=np.int64).view(np.uint64))[0] if mine else "\n".join(blocks))
        kinds.append(kind)
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(kinds)], names=["page_id", "url", "text", "kind"])


def _by_host(runs: DataFrame) -> DataFrame:
    return runs.groupBy("host").agg(F.collect_list(F.struct("kind", "run")).alias("runs"))


def extract(pages: DataFrame) -> DataFrame:
    """Per page (page_id, url, html): page_id, url, text, n_chars and the kind of its structure."""
    host = F.coalesce(F.concat(F.lit("="), F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#:]+)", 1))), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    groups = F.ceil(F.count(F.lit(1)) / GROUP_PAGES).cast("long").alias("groups")
    hosts = cut(pages.groupBy("host").agg(groups))
    contents = _contents(_attach(pages, hosts).select("host", "groups", "html"))
    # Copies from several tasks meet in one partition and are dropped there by a sort, before a group is gathered.
    distinct = contents.repartition("host", "kind", "group").dropDuplicates(["host", "kind", "group", "c1", "c2"])
    named = cut(distinct.drop("c1", "c2").groupBy("host", "kind", "group").applyInArrow(_group_runs, "host string, kind string, run long, contents long"))
    sizes = named.filter("run is null").groupBy("host", "kind").agg(F.sum("contents").alias("contents"))
    candidates = cut(named.filter("run is not null").select("host", "kind", "run").distinct())
    held = _attach(pages, cut(_by_host(candidates))).filter("runs is not null").select("host", "html", "runs")
    counted = map_slices(held, _held, "host string, kind string, run long, c1 long, c2 long", text="html").distinct()
    counted = counted.groupBy("host", "kind", "run").agg(F.count(F.lit(1)).alias("held")).join(sizes, ["host", "kind"])
    by_kind = lambda values: F.when(F.col("kind") == "open", values["open"]).otherwise(values["marked"])
    boilerplate = counted.filter((F.col("held") >= by_kind(PAGES)) & (F.col("held") >= by_kind(SHARE) * F.col("contents")))
    marked = _attach(pages, cut(_by_host(boilerplate.select("host", "kind", "run")))).select("page_id", "url", "html", "runs")
    texts = map_slices(marked, _texts, "page_id long, url string, text string, kind string", text="html")
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "kind")
