"""A page as a flat tree of elements, and the selectors that shops' rules are written in.

Elements stand in document order, each with the range of its descendants and of its text,
so a card's parts are a slice and its text a join.  Selectors: tag, ``.class``, ``#id``,
``[attr]``, ``[attr=x]`` with ``^= $= *=``, ``:not(...)`` of one compound, descendants,
``>``, and lists by commas.  Everything works on one page of one row.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_PART = re.compile(r"""\[([\w:-]+)(?:([\^$*]?=)"?([^"\]]*)"?)?\]|:not\(([^()]*)\)|([.#]?)([\w-]+|\*)""")

_S = r"[ \t\n\r\f]"
_ATTR = rf"""{_S}+[a-zA-Z_][\w:.-]*(?:=(?:"[^"<>]*"|'[^'<>]*'))?"""
#: Plain markup: quoted attributes, scripts without a tag in them, end tags and texts; the last group is anything else.
_TOKEN = re.compile(rf"([^<]+)|</([a-zA-Z][a-zA-Z0-9-]*){_S}*>|<script((?:{_ATTR})*){_S}*>([^<]*)</script{_S}*>|<([a-zA-Z][a-zA-Z0-9-]*)((?:{_ATTR})*){_S}*/?>|(<)", re.ASCII)
_ATTRS = re.compile(rf"""{_S}+([a-zA-Z_][\w:.-]*)(?:=(?:"([^"<>]*)"|'([^'<>]*)'))?""", re.ASCII)
_REFERENCE = re.compile(r"&(?!#?\w+;)")
#: Elements up to which a search goes through all, not by places.
_FEW = 64
#: Elements whose content is read by rules of its own.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp", "svg", "math"}
_STEP = re.compile(r"""(>)?\s*((?:\[[^\]]*\]|:not\([^()]*\)|[^\s>\[(])+)""")


@lru_cache(maxsize=8192)
def _attributes(text: str) -> tuple[dict[str, str], frozenset[str]] | None:
    """Attributes and classes of a plain tag; nothing where a reference in them does not end with a semicolon."""
    if _REFERENCE.search(text):
        return None
    attrs = {name.lower(): unescape(a or b) for name, a, b in reversed(_ATTRS.findall(text))}
    return attrs, frozenset(attrs.get("class", "").split())


class Element:
    __slots__ = ("tag", "attrs", "classes", "parent", "at", "last", "text_from", "text_to", "own")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, at: int, text: int, classes: frozenset[str] | None = None) -> None:
        self.tag, self.attrs, self.parent, self.at, self.last = tag, attrs, parent, at, at
        self.classes = frozenset(attrs.get("class", "").split()) if classes is None else classes
        self.text_from = self.text_to = text
        self.own: tuple[int, int] | None = None  # the texts up to the first child, if it begins with text


class Page(HTMLParser):
    """The elements of a page; end tags without a start are ignored, open elements end with their parent.

    Pages of plain markup are read by one pattern, which gives what the parser gives; all others by the parser.
    """

    def __init__(self, html: str) -> None:
        self._empty()
        if not self._read_plain(html):
            self._empty()
            super().__init__(convert_charrefs=True)
            self.feed(html)
            self.close()
        while self._open:
            self._end()

    def _empty(self) -> None:
        self.elements: list[Element] = []
        self.texts: list[str] = []
        self._open: list[Element] = []
        self._names: Counter[str] = Counter()
        self._places: dict[str, list[int]] | None = None
        self._fitting: dict[str, list] = {}

    def _read_plain(self, html: str) -> bool:
        """Whether the page is plain markup, which is read then."""
        for m in _TOKEN.finditer(html):
            kind = m.lastindex
            if kind == 1:
                text = m[1]
                self.texts.append(unescape(text) if "&" in text else text)
            elif kind == 2:
                self.handle_endtag(m[2].lower())
            elif kind == 6 and (tag := m[5].lower()) not in _RAW and (found := _attributes(m[6])) is not None:
                self._start(tag, *found)
            elif kind == 4 and (found := _attributes(m[3])) is not None:
                self._start("script", *found)
                if m[4]:
                    self.texts.append(m[4])
                self.handle_endtag("script")
            else:
                return False
        return True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._start(tag, {k: v or "" for k, v in reversed(attrs)})

    def _start(self, tag: str, attrs: dict[str, str], classes: frozenset[str] | None = None) -> None:
        parent = self._open[-1] if self._open else None
        element = Element(tag, attrs, parent, len(self.elements), len(self.texts), classes)
        if parent is not None and parent.own is None:
            parent.own = (parent.text_from, len(self.texts))
        self.elements.append(element)
        if tag not in _VOID:
            self._open.append(element)
            self._names[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self._names[tag]:
            while self._end() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.texts.append(data)

    def _end(self) -> str:
        element = self._open.pop()
        self._names[element.tag] -= 1
        element.last, element.text_to = len(self.elements) - 1, len(self.texts)
        return element.tag

    def text(self, element: Element) -> str:
        return "".join(self.texts[element.text_from : element.text_to])

    def first_text(self, element: Element) -> str:
        """The text before an element's first child element."""
        begin, end = element.own or (element.text_from, element.text_to)
        return "".join(self.texts[begin:end])

    def places(self) -> dict[str, list[int]]:
        """Where each tag, class (``.x``) and attribute (``[x``) stands."""
        if self._places is None:
            by_tag, by_class, by_attr = defaultdict(list), defaultdict(list), defaultdict(list)
            for k, e in enumerate(self.elements):
                by_tag[e.tag].append(k)
                for c in e.classes:
                    by_class[c].append(k)
                for a in e.attrs:
                    by_attr[a].append(k)
            self._places = {**by_tag, **{f".{c}": at for c, at in by_class.items()}, **{f"[{a}": at for a, at in by_attr.items()}}
        return self._places

    def find(self, selector: str, within: Element | None = None) -> Iterator[Element]:
        """Descendants that match, in document order."""
        fitting = self._fitting.get(selector)
        if fitting is None:
            places = self.places()
            fitting = [(last, test) for needs, last, test in compiled(selector) if all(n in places for n in needs)]
            self._fitting[selector] = fitting
        if not fitting:
            return iter(())
        begin, end = (0, len(self.elements)) if within is None else (within.at + 1, within.last + 1)
        tests = [test for _, test in fitting]
        fits = tests[0] if len(tests) == 1 else lambda e: any(t(e) for t in tests)
        if end - begin <= _FEW:
            return (e for e in self.elements[begin:end] if fits(e))
        at = set()
        for last, _ in fitting:
            stands = self.places()[last] if last else range(len(self.elements))
            at.update(stands[bisect_left(stands, begin) : bisect_left(stands, end)])
        return (e for k in sorted(at) if fits(e := self.elements[k]))


def _needed(compound: str) -> list[str]:
    """Marks without which no element fits, the rarest kind first."""
    parts = _PART.findall(compound)
    classes = [f".{name}" for *_, mark, name in parts if mark == "."]
    attrs = [f"[{attr}" for attr, *_ in parts if attr] + ["[id" for *_, mark, _ in parts if mark == "#"]
    return classes + attrs + [name for attr, _, _, negated, mark, name in parts if name and not mark and name != "*"]


def _compound(text: str) -> Callable[[Element], bool]:
    tests = []
    for attr, op, value, negated, mark, name in _PART.findall(text):
        if attr:
            tests.append(_attribute(attr, op, value))
        elif negated:
            tests.append(lambda e, inner=_compound(negated): not inner(e))
        elif mark == ".":
            tests.append(lambda e, name=name: name in e.classes)
        elif mark == "#":
            tests.append(lambda e, name=name: e.attrs.get("id") == name)
        elif name != "*":
            tests.append(lambda e, name=name: e.tag == name)
    return tests[0] if len(tests) == 1 else lambda e: all(test(e) for test in tests)


def _attribute(attr: str, op: str, value: str) -> Callable[[Element], bool]:
    compare = {"": lambda v: True, "=": lambda v: v == value, "^=": lambda v: v.startswith(value), "$=": lambda v: v.endswith(value), "*=": lambda v: value in v}[op]
    return lambda e: attr in e.attrs and compare(e.attrs[attr])


def _complex(text: str) -> Callable[[Element], bool]:
    parts = _STEP.findall(text.strip())
    steps = [(bool(child), _compound(part)) for child, part in parts]

    def fits(element: Element, k: int) -> bool:
        child, test = steps[k]
        if not test(element):
            return False
        if k == 0:
            return True
        above = element.parent
        if child:
            return above is not None and fits(above, k - 1)
        while above is not None:
            if fits(above, k - 1):
                return True
            above = above.parent
        return False

    return steps[0][1] if len(steps) == 1 else lambda e: fits(e, len(steps) - 1)


@lru_cache(maxsize=1024)
def compiled(selector: str) -> list[tuple[list[str], str | None, Callable[[Element], bool]]]:
    """Per selector of a list the marks that a page needs, one that the element itself has, and whether an element fits."""
    out = []
    for one in selector.split(","):
        needs = [_needed(part) for _, part in _STEP.findall(one.strip())]
        out.append((sum(needs, []), next(iter(needs[-1]), None) if needs else None, _complex(one)))
    return out


def pick(page: Page, within: Element | None, where: str) -> str:
    """One alternative of a rule, with white space collapsed.

    ``selector`` is the text of the first match, ``selector+`` the text of all, ``selector~``
    the first match's text before its first child, ``selector@attr`` an attribute of the
    first match, ``@attr`` one of the card itself, ``*`` the whole card's text.
    """
    if where == "*":
        found = page.text(within) if within is not None else "".join(page.texts)
    elif where.startswith("@"):
        found = within.attrs.get(where[1:], "") if within is not None else ""
    elif where.endswith("+"):
        found = "".join(page.text(e) for e in page.find(where[:-1], within))
    else:
        selector, _, attr = where.partition("@")
        first = next(page.find(selector.removesuffix("~"), within), None)
        if first is None:
            found = ""
        elif attr:
            found = first.attrs.get(attr, "")
        else:
            found = page.first_text(first) if selector.endswith("~") else page.text(first)
    return " ".join(found.split())


def first_of(page: Page, within: Element | None, alternatives: tuple[str, ...]) -> str:
    """The first alternative that gives a text."""
    return next((t for where in alternatives if (t := pick(page, within, where))), "")
