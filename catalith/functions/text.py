"""Text normalisation as Column expressions (no UDF in any of them)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def any_of(terms: Iterable[str], text: Column) -> Column:
    """Whether the text contains one of the terms."""
    out = F.lit(False)
    for term in terms:
        out = out | text.contains(term)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once and stands once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_accents(text: Column) -> Column:
    """Marks off the letters of ``ACCENTED``, and combining marks U+0300-036F away."""
    return F.regexp_replace(F.translate(text, C.ACCENTED, C.PLAIN), r"[\x{0300}-\x{036f}]", "")


def identity_text(text: Column) -> Column:
    """Lower case, no accents, only a-z, 0-9 and +, single spaces."""
    return collapse(F.regexp_replace(F.lower(strip_accents(text)), r"[^a-z0-9+\s]", " "))


def heuristic_text(text: Column) -> Column:
    return collapse(F.regexp_replace(F.upper(strip_accents(text)), r"[^A-Z0-9+ ]+", " "))


def group_name(text: Column) -> Column:
    """``identity_text`` with plus signs as spaces; the spaces stay as they fall."""
    return F.translate(identity_text(text), "+", " ")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def words(text: Column, longer_than: int = 1) -> Column:
    return F.filter(F.split(text, " "), lambda w: F.length(w) > longer_than)


def dedupe_tokens(name: Column) -> Column:
    """Words of over one letter without the stopwords; repetitions stay."""
    return F.filter(words(identity_text(name)), lambda w: ~w.isin(*C.DEDUPE_STOPWORDS))


def matched_words(name: Column, query_words: list[str]) -> Column:
    text, total = identity_text(name), F.lit(0)
    for w in query_words:
        total = total + text.contains(w).cast("int")
    return total


def query_words(query: str) -> list[str]:
    return [w for w in plain_identity(query).split(" ") if len(w) > 1]


def plain_identity(value: str) -> str:
    """``identity_text`` of a parameter, on the driver."""
    import re

    value = re.sub(r"[̀-ͯ]", "", value.translate(str.maketrans(C.ACCENTED, C.PLAIN)))
    return " ".join(re.sub(r"[^a-z0-9+\s]", " ", value.lower()).split())


def is_bundle(name: Column) -> Column:
    def test(text: Column) -> Column:
        return text.contains("+") | any_of([f" {t} " for t in C.BUNDLE_TERMS], F.concat(F.lit(" "), text, F.lit(" ")))

    return let(identity_text(name), test)


def keyword_case(rules: Iterable[tuple[str, Iterable[str]]], text: Column, default: str) -> Column:
    """The first rule with a keyword in the text."""
    out = None
    for name, terms in rules:
        hit = any_of(terms, text)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default))


def infer_category(name: Column) -> Column:
    return keyword_case(C.CATEGORY_KEYWORDS, F.lower(name), "perifericos")


def infer_detail_category(name: Column) -> Column:
    return keyword_case(C.DETAIL_KEYWORDS, F.lower(name), "perifericos")


def first_group(text: Column, alternatives: str) -> Column:
    """The first whole-word match without its spaces; null if there is none."""
    found = F.regexp_replace(F.regexp_extract(text, rf"\b({alternatives})\b", 1), r"\s+", "")
    return F.nullif(found, F.lit(""))


def xml_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def decode_entities(text: Column) -> Column:
    for entity, raw in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def repair_display_text(text: Column) -> Column:
    """Whitespace, at most two passes of Latin-1 read as UTF-8 undone, plain quotes and dashes.

    A pass is taken only if it leaves fewer of the signs of a wrong decoding and every
    character fits in one byte.
    """
    signs = r"[ÃÂâ\x{FFFD}]"

    def once(held: Column) -> Column:
        one_byte = ~held.rlike(r"[^\x{00}-\x{FF}]") & held.rlike(signs)
        decoded = F.when(one_byte, F.try_validate_utf8(F.encode(held, "ISO-8859-1").cast("string")))
        fewer = lambda d: F.regexp_count(d, F.lit(signs)) < F.regexp_count(held, F.lit(signs))
        return let(decoded, lambda d: F.when(F.coalesce(fewer(d), F.lit(False)), d).otherwise(held))

    current = let(let(collapse(F.coalesce(text, F.lit(""))), once), once)
    plain = F.translate(current, "‘’“”–— ", "''\"\"-- ")
    return collapse(F.translate(plain, "�", ""))
