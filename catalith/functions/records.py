"""Small records and parameters: validated values, safe paths, codes and specs, log lines, history points."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .text import any_of, identity_text


def csv(value: Column) -> Column:
    """The parts of a comma-separated text, trimmed, without empty ones; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def allowed(value: Column, values: Iterable[str]) -> Column:
    """The value if it is one of those allowed, else null."""
    return F.when(value.isin(*values), value)


def categories(value: Column) -> Column:
    """The known categories of a comma-separated text, each once, where it first stands."""
    return F.array_distinct(F.filter(csv(value), lambda c: c.isin(*C.CATEGORIES)))


def integer_between(value: Column, fallback: int, least: int, most: int) -> Column:
    """A number text as an integer within bounds; an empty one counts as zero, others that are no numbers as the fallback."""
    number = F.when(F.trim(value) == "", F.lit(0.0)).otherwise(F.trim(value).try_cast("double"))
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e15)
    return F.when(finite, F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.when(finite, number)))).cast("int")).otherwise(fallback)


def has_intent(query: Column, category: Column, lowest: Column, highest: Column, stores: Column) -> Column:
    """Whether a search asks for anything at all."""
    text = F.trim(F.coalesce(query, F.lit(""))) != ""
    return text | category.isNotNull() | lowest.isNotNull() | highest.isNotNull() | (F.size(F.coalesce(stores, F.array().cast("array<string>"))) > 0)


def safe_path(value: Column, fallback: str = "/") -> Column:
    """Where to go next: a path of this site, after at most three decodings; else the fallback."""
    for _ in range(3):
        value = F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)
    good = value.startswith("/") & ~value.startswith("//") & ~value.startswith("/auth/callback")
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(fallback)


def in_category(component: Column, model: Column, category: str) -> Column:
    """Whether a component's name or model has one of the category's terms."""
    text = identity_text(F.concat_ws(" ", F.coalesce(component, F.lit("")), F.coalesce(model, F.lit(""))))
    return any_of(C.COMPONENT_TERMS[category], text)


def product_code(codes: Column) -> Column:
    """The first code of a list that is left without its ``SKU:``."""
    bare = F.transform(codes, lambda c: F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^sku\s*:\s*", "")))
    return F.get(F.filter(bare, lambda c: c != ""), F.lit(0))


def _available(stock: Column) -> Column:
    return F.when(stock == "in-stock", "en stock").when(stock == "low-stock", "stock bajo").when(stock == "out-of-stock", "sin stock")


def spec_map(codes: Column, months: Column, count: Column, stock: Column) -> Column:
    """Specs of a feed's item: code, warranty, count and availability, those that it has."""
    pairs = [
        ("SKU", product_code(codes)), ("Garantia", F.when(months > 0, F.concat(months.cast("string"), F.lit(" meses")))),
        ("Stock", F.when(count >= 0, F.floor(count).cast("string"))), ("Disponibilidad", _available(stock)),
    ]
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def spec_line(name: Column, codes: Column, months: Column, stock: Column, shop: str) -> Column:
    """One line of description from the specs; the name where there are none."""
    parts = [F.concat(F.lit("SKU "), product_code(codes)), F.when(months > 0, F.concat(F.lit("Garantia "), months.cast("string"), F.lit(" meses"))), F.concat(F.lit("Disponibilidad "), _available(stock))]
    line = F.array_join(F.array_compact(F.array(*parts)), " | ")
    return F.when(line == "", F.trim(F.coalesce(name, F.lit("")))).otherwise(F.concat(F.lit(f"Ficha {shop}: "), line))


def history_points(prices: Column) -> Column:
    """Points (date, price, store_id) of recorded prices whose dates are texts; texts that are no date have none."""
    return F.transform(prices, lambda p: F.struct(F.try_to_timestamp(p["date"]).alias("date"), p["price"].alias("price"), p["store_id"].alias("store_id")))


def store_message(name: Column, status: Column, count: Column) -> Column:
    return F.concat(name, F.lit(" -> "), F.upper(status), F.lit(" ("), count.cast("string"), F.lit(" resultados)"))


def endpoint_message(endpoint: Column, code: Column, count: Column, note: Column) -> Column:
    said = F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit(" "), note)).otherwise("")
    return F.concat(endpoint, F.lit(" -> "), code.cast("string"), F.lit(" ("), count.cast("string"), F.lit(" items)"), said)


def touched(rows: DataFrame, now: Column, column: str = "updated_at") -> DataFrame:
    """Rows as an update leaves them: the time is now, whatever the update gave."""
    return rows.withColumn(column, now)
