"""Pages and cards of one form, which a rule is worked out on once.

Shops write their cards from templates, so most differ in texts and in some attributes only.  A
piece of plain markup is cut into its words and what stands in their places; pieces with the same
words have the same elements, so where a rule finds its parts is told from the first of them and
read off the others.  A selector that tests the value of such an attribute is asked for each
piece.  What is not plain is read by ``markup.Page`` as before.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape

from .markup import _ATTRS, _PART, _REFERENCE, _STEP, _TOKEN, Element, Page

#: Texts, and values of attributes that differ from card to card: what stands in the places of a form.
_PLACES = re.compile(r""">([^<]+)| (href|src|alt|title|content|data-[a-z-]+)="([^"<>]*)""")
_WIDTH = 4  # words, text, attribute, value
#: Forms that a task holds at most; further ones are read without.
MOST = 4_096


def _tests(selectors: list[str]) -> list[tuple[str, Callable[[str], bool]]]:
    """Tests of attributes' values in selectors, in :not() too."""
    compare = {"=": lambda w: lambda v: v == w, "^=": lambda w: lambda v: v.startswith(w), "$=": lambda w: lambda v: v.endswith(w), "*=": lambda w: lambda v: w in v}
    out = {}
    for text in selectors:
        for attr, op, value, negated, *_ in _PART.findall(text):
            if op:
                out[attr, op, value] = (attr, compare[op](value))
            if negated:
                out |= {(negated, k): t for k, t in enumerate(_tests([negated]))}
    return list(out.values())


class _Form:
    """A piece of one form: which elements it has, and where their texts and values stand among its places."""

    def __init__(self, piece: str, context: tuple[str, ...], parts: list[str]) -> None:
        self.page, self.fits = Page(""), False
        self.page._empty()
        if not self.page._read_plain("".join(context)) or len(self.page._open) != len(context):
            return
        self.outer, self.before = len(self.page.elements), len(self.page.texts)
        if not self.page._read_plain(piece):
            return
        self.open = list(self.page._open)
        while self.page._open:
            self.page._end()
        # Texts and values are told by where they stand in the piece; all places must be one of these.
        places, at = {}, 0
        for k in range(0, len(parts) - 1, _WIDTH):
            kind = 1 if parts[k + 1] is not None else 3
            at += len(parts[k]) + (1 if kind == 1 else len(parts[k + 2]) + 3)
            places[at] = k + kind
            at += len(parts[k + kind])
        self.text_at: list[int | None] = []
        self.raw: list[bool] = []
        self.value_at: dict[tuple[int, str], int | None] = {}
        self.tags: list[str] = list(context)
        for m in _TOKEN.finditer(piece):
            if m.lastindex == 1:
                self.text_at.append(places.pop(m.start(), None))
                self.raw.append(False)
            elif m.lastindex in (4, 6):
                for a in _ATTRS.finditer(piece, *m.span(3 if m.lastindex == 4 else 6)):
                    place = places.pop(a.start(2), None) if a[2] is not None else None
                    self.value_at.setdefault((len(self.tags), a[1].lower()), place)
                self.tags.append(m[0])
                if m.lastindex == 4 and m[4]:
                    self.text_at.append(places.pop(m.start(4), None))
                    self.raw.append(True)
        texts = len(self.page.texts) - self.before
        self.fits = not places and None not in self.text_at and len(self.text_at) == texts and len(self.tags) == len(self.page.elements)

    def context_after(self) -> tuple[str, ...]:
        return tuple(self.tags[e.at] for e in self.open)

    def texts(self, begin: int, end: int) -> list[tuple[int, bool]]:
        return [(self.text_at[t - self.before], self.raw[t - self.before]) for t in range(max(begin, self.before), end)]

    def part(self, within: Element | None, where: str) -> str | list[tuple[int, bool]] | None:
        """``markup.pick`` as a text that stands, or the places it is taken from."""
        page = self.page
        if where == "*":
            return self.texts(within.text_from, within.text_to) if within is not None else self.texts(self.before, len(page.texts))
        if where.startswith("@"):
            return self._attribute(within, where[1:])
        if where.endswith("+"):
            return [t for e in page.find(where[:-1], within) for t in self.texts(e.text_from, e.text_to)]
        selector, _, attr = where.partition("@")
        first = next(page.find(selector.removesuffix("~"), within), None)
        if first is None:
            return ""
        if attr:
            return self._attribute(first, attr)
        return self.texts(*(first.own or (first.text_from, first.text_to))) if selector.endswith("~") else self.texts(first.text_from, first.text_to)

    def _attribute(self, element: Element | None, attr: str) -> str | list[tuple[int, bool]]:
        if element is None:
            return ""
        at = self.value_at.get((element.at, attr))
        return " ".join(element.attrs.get(attr, "").split()) if at is None else [(at, False)]


def _taken(parts: list[str], part: str | list[tuple[int, bool]]) -> str:
    if part.__class__ is str:
        return part
    text = "".join([parts[at] if raw or "&" not in parts[at] else unescape(parts[at]) for at, raw in part])
    return " ".join(text.split())


class Forms:
    """What a rule finds in pieces of markup, worked out once a form.

    ``fields``: per field its alternatives, of which the first that gives a text counts, and ``joined`` the fields whose
    alternatives all count; ``scripts`` are selectors whose elements' texts are wanted as they stand.
    """

    def __init__(self, fields: list[tuple[str, ...]], joined: list[tuple[str, ...]], scripts: str = "", card: str = "") -> None:
        self.fields, self.joined, self.scripts, self.card = fields, joined, scripts, card
        self.tests = _tests([card, scripts, *(w for own in (*fields, *joined) for w in own)])
        self.known: dict[tuple, tuple] = {}
        self.start = self._start() if card else None

    def _start(self) -> re.Pattern | None:
        """Start tags that have what a card's own tag must have, by its class or tag."""
        marks = []
        for one in self.card.split(","):
            compounds = _STEP.findall(one.strip())
            names = [(mark, name) for *_, mark, name in _PART.findall(compounds[-1][1]) if name and mark != "#" and name != "*"]
            own = next((n for m, n in names if m == "."), None)
            if own is None:
                return None
            marks.append(re.escape(own))
        return re.compile(rf"""<[a-zA-Z][^<>]*?\sclass="(?:[^"<>]*\s)?(?:{'|'.join(marks)})[\s"]""")

    def read(self, piece: str, context: tuple[str, ...] = ()) -> tuple | None:
        """(fields, joined, scripts, context after, elements, the card's last element), or nothing where the form is not known."""
        parts = _PLACES.split(piece)
        key = (context, *parts[::_WIDTH], *parts[2::_WIDTH])
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= MOST:
                return None
            known = self.known[key] = self._known(piece, context, parts)
        asked, values, by_answer = known
        if by_answer is None or ("&" in piece and any("&" in parts[k] and _REFERENCE.search(parts[k]) for k in values)):
            return None
        answer = tuple([test(unescape(parts[k]) if "&" in parts[k] else parts[k]) for k, test in asked]) if asked else ()
        form = by_answer.get(answer)
        if form is None:
            form = by_answer[answer] = self._told(piece, context, parts)
        if form is False:
            return None
        fields, joined, scripts, after, count, last = form
        found = []
        for alternatives in fields:
            text = ""
            for part in alternatives:
                if part.__class__ is int:
                    text = parts[part]
                    text = " ".join((unescape(text) if "&" in text else text).split())
                else:
                    text = _taken(parts, part)
                if text:
                    break
            found.append(text)
        return found, [" ".join([_taken(parts, p) for p in own]) for own in joined], ["".join([parts[k] for k, _ in s]) for s in scripts], after, count, last

    def _known(self, piece: str, context: tuple[str, ...], parts: list[str]) -> tuple:
        form = _Form(piece, context, parts)
        if not form.fits:
            return (), (), None
        asked = [(k, test) for (_, name), k in form.value_at.items() if k is not None for attr, test in self.tests if attr == name]
        return asked, [k + 3 for k in range(0, len(parts) - 1, _WIDTH) if parts[k + 1] is None], {}

    def _told(self, piece: str, context: tuple[str, ...], parts: list[str]) -> tuple | bool:
        form, within, last = _Form(piece, context, parts), None, 0
        if self.card:
            found = list(form.page.find(self.card))
            within = found[0] if found else None
            # One card, which begins with the piece and has ended when it does; nothing about it is around it.
            if within is None or within.at != form.outer or any(e.at > within.last for e in found) or within in form.open:
                return False
            last = within.last - form.outer
        alone = lambda p: p[0][0] if p.__class__ is list and len(p) == 1 and not p[0][1] else p
        fields = [[alone(p) for p in (form.part(within, w) for w in own) if p] for own in self.fields]
        joined = [[form.part(within, w) for w in own] for own in self.joined]
        scripts = [form.texts(e.text_from, e.text_to) for e in form.page.find(self.scripts)] if self.scripts else []
        return fields, joined, scripts, form.context_after(), len(form.page.elements) - form.outer, last

    def cards(self, html: str) -> list[tuple] | None:
        """(fields, joined, place) of a page's cards, or nothing where some of it must be read as a whole."""
        if self.start is None:
            return None
        cuts = [m.start() for m in self.start.finditer(html)]
        if not cuts:
            return None
        head = Page("")
        head._empty()
        if not head._read_plain(html[: cuts[0]]) or any(True for _ in head.find(self.card)):
            return None
        starts = [m[0] for m in _TOKEN.finditer(html[: cuts[0]]) if m.lastindex in (4, 6)]
        context, count, out = tuple(starts[e.at] for e in head._open), len(head.elements), []
        for begin, end in zip(cuts, [*cuts[1:], len(html)]):
            found = self.read(html[begin:end], context)
            if found is None:
                return None
            fields, joined, _, context, more, last = found
            out.append((fields, joined, count + last))
            count += more
        return out
