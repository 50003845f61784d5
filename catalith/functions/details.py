"""Small rules of product pages and feeds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .price import digits_only, half_up, parse_price
from .text import collapse
from .urls import truncate


def known_brand(name: Column) -> Column:
    """The first listed brand in a name, as it is shown; null without one."""
    upper = F.upper(name)
    return F.coalesce(*(F.when(upper.contains(word), shown) for word, shown in C.NAME_BRANDS))


def availability(stock: Column) -> Column:
    return F.coalesce(*(F.when(stock == s, link) for s, link in C.AVAILABILITY.items()), F.lit(C.OTHER_AVAILABILITY))


def without_brand(model: Column, brand: Column) -> Column:
    """The model without the whole words that name its brand."""
    pattern = F.concat(F.lit(r"(?i)\b\Q"), brand, F.lit(r"\E\b"))
    cut = F.when(F.coalesce(brand, F.lit("")) != "", F.regexp_replace(model, pattern, F.lit(""))).otherwise(model)
    return F.trim(F.regexp_replace(cut, r"\s{2,}", " "))


def short_title(brand: Column, model: Column, name: Column) -> Column:
    compact = F.trim(F.concat_ws(" ", F.nullif(brand, F.lit("")), F.nullif(without_brand(model, brand), F.lit(""))))
    return truncate(F.coalesce(F.nullif(compact, F.lit("")), name), C.SHORT_TITLE)


def is_pc_build(name: Column) -> Column:
    low = F.lower(name)
    return F.exists(F.array(*map(F.lit, C.PC_BUILD_TERMS)), lambda t: F.contains(low, t))


def reclassified(category: Column, name: Column) -> Column:
    """Peripherals that were filed under components."""
    wrong = category.isin("tarjetas-graficas", "procesadores")
    wrong = wrong & name.rlike(f"(?i)({C.PERIPHERAL_NAMES})") & ~name.rlike(f"(?i)({C.COMPONENT_NAMES})")
    return F.when(wrong, "perifericos").otherwise(category)


def image_link(raw: Column, site: str, default: str) -> Column:
    text = F.trim(F.coalesce(raw, F.lit("")))
    return F.when(text.rlike("(?i)^https?://"), text).when(text.startswith("/"), F.concat(F.lit(site), text)).otherwise(default)


def meta_text(name: Column, stores: Column, price_text: Column) -> Column:
    """Description of a product page: with its best price where that fits."""
    core = truncate(F.concat(F.lit("Compara "), name, F.lit(" en "), stores.cast("string"), F.lit(" tiendas de Argentina.")), 120)
    full = F.concat(core, F.lit(" Mejor precio detectado: "), price_text, F.lit("."))
    return F.when(F.char_length(full) <= C.META_TEXT, full).otherwise(core)


def prefix_of(product_id: Column) -> Column:
    return F.get(_parts(product_id), F.lit(0))


def code_of(product_id: Column) -> Column:
    """The second part of an id, if it is a number."""
    second = F.get(_parts(product_id), F.lit(1))
    return F.when(second.rlike("^[0-9]+$"), second)


def detail_query(product_id: Column) -> Column:
    """Search words of an id: what follows its prefix and code."""
    parts = _parts(product_id)
    rest = F.when(code_of(product_id).isNotNull(), F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1)))).otherwise(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))))
    words = collapse(F.regexp_replace(F.array_join(rest, " "), r"(?i)[^a-z0-9+\s]", " "))
    return F.when(F.size(parts) <= 1, product_id).otherwise(words)


def _parts(product_id: Column) -> Column:
    return F.filter(F.split(product_id, "-"), lambda p: p != "")


def finite_or(text: Column, fallback: Column) -> Column:
    value = F.try_to_number(text, F.lit("S999999999999D999999"))
    return F.coalesce(value.cast("double"), fallback)


def price_of_number_or_text(number: Column, text: Column) -> Column:
    """A positive number rounded, else the text's price in local notation."""
    return F.when(number > 0, half_up(number)).otherwise(F.coalesce(parse_price(text), F.lit(0).cast("long")))


def plain_decimal_price(text: Column) -> Column:
    """A plain decimal rounded, else a price in local notation."""
    text = F.trim(text)
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), half_up(text.try_cast("double"))).otherwise(
        F.coalesce(parse_price(text), F.lit(0).cast("long"))
    )


def direct_or_digits_price(text: Column) -> Column:
    """A number with a point or comma rounded, else the digits alone."""
    number = F.regexp_replace(F.trim(text), ",", ".").try_cast("double")
    return F.when(number > 0, half_up(number)).otherwise(F.coalesce(digits_only(text), F.lit(0).cast("long")))


def scrape_status(results: Column, latency: Column) -> Column:
    return F.when(results == 0, "no-results").when(latency >= C.SLOW_MS, "slow").otherwise("ok")


def log_level(status: Column) -> Column:
    return F.when(status.isin("blocked", "error"), "error").when(status.isin("slow", "no-results"), "warning").otherwise("info")


def clean_map(column: Column) -> Column:
    """Map with collapsed keys and values; empty ones go, and the last of equal keys stays."""
    entries = F.transform(F.map_entries(column), lambda e: F.struct(collapse(e.key).alias("key"), collapse(e.value).alias("value")))
    entries = F.filter(entries, lambda e: (e.key != "") & (e.value != ""))
    last = F.aggregate(
        entries,
        F.slice(entries, 1, 0),
        lambda held, e: F.concat(F.filter(held, lambda h: h.key != e.key), F.array(e)),
    )
    return F.map_from_entries(last)


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
