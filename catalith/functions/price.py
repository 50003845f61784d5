"""Price arithmetic: parsing, comparable statistics, merges, instalments, changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import identity_text, is_bundle, let, plain_identity, query_words


def half_up(value: Column) -> Column:
    """Rounding of halves towards positive infinity, to a long."""
    return F.floor(value + 0.5).cast("long")


def parse_price(text: Column) -> Column:
    """The price in a text with amounts in local notation, 0 if there is none.

    Of several amounts: the last behind words of a former or present price, the smallest
    of at least ``INSTALMENT_CUTOFF`` beside words of instalments, else the greatest.
    A text that is one amount without decimals, as most are, is told by its digits.
    """
    text = F.coalesce(text, F.lit(""))
    alone = text.rlike(r"^[$ ]*(?:\d{1,3}(?:\.\d{3}){1,4}|\d{1,15})\z")
    kept = F.regexp_replace(text, r"[^\d.,$-]", " ")
    found = F.regexp_extract_all(kept, F.lit(r"(\d+(?:[.,]\d{3})*(?:[.,]\d{1,2})?)"), F.lit(1))

    def number(m: Column) -> Column:
        points, commas = r"^\d{1,3}(?:\.\d{3})+(?:,\d{1,2})?$", r"^\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?$"
        plain = (
            F.when(m.rlike(points), F.translate(F.translate(m, ".", ""), ",", "."))
            .when(m.rlike(commas), F.translate(m, ",", ""))
            .when(m.contains(",") & ~m.contains("."), F.when(m.rlike(r",\d{1,2}$"), F.translate(m, ",", ".")).otherwise(F.translate(m, ",", "")))
            .otherwise(m)
        )
        # A second separator ends a number, as in a parser that reads a prefix.
        return F.regexp_extract(plain, r"^\d+(?:\.\d+)?", 0).cast("double")

    amounts = F.filter(F.transform(found, number), lambda v: v > 0)

    def pick(v: Column) -> Column:
        low = F.lower(text)
        last = low.rlike(r"antes|before|precio\s*anterior|precio\s*lista|ahora|now|oferta|descuento|precio\s*final")
        large = F.filter(v, lambda x: x >= C.INSTALMENT_CUTOFF)
        value = (
            F.when(F.size(v) == 1, v[0])
            .when(last, F.element_at(v, -1))
            .when(low.rlike("cuota|pago|mes") & (F.size(large) > 0), F.array_min(large))
            .otherwise(F.array_max(v))
        )
        return F.when(F.size(v) > 0, half_up(value)).otherwise(F.lit(0).cast("long"))

    return F.when(alone, F.translate(text, "$. ", "").cast("long")).otherwise(let(amounts, pick))


def digits_only(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(text, r"\D", ""), F.lit("")).cast("long"), F.lit(0).cast("long"))


def strip_decimals(text: Column) -> Column:
    """Digits of a price text whose decimals, two digits behind a comma, are left out."""
    return digits_only(F.regexp_replace(text, r",\d{1,2}\s*$", ""))


def is_upper_outlier(price: Column, median: Column) -> Column:
    least = F.greatest(F.lit(C.MIN_DELTA), half_up(median * C.RELATIVE_DELTA))
    return (median > 0) & (price / median >= C.UPPER_RATIO) & (price - median >= least)


def is_lower_outlier(price: Column, median: Column) -> Column:
    least = F.greatest(F.lit(C.MIN_DELTA), half_up(median * C.RELATIVE_DELTA))
    return (median > 0) & (price / median <= C.LOWER_RATIO) & (median - price >= least)


def outlier(price: Column, n: Column, median: Column, lowest: Column) -> Column:
    """Whether a price is discarded, given its group's count, median and least price."""
    pair = (price > lowest) & (price / F.greatest(lowest, F.lit(1)) >= C.PAIR_RATIO) & (price - lowest >= C.PAIR_MIN_DELTA)
    return F.when(n <= 1, False).when(n == 2, pair).otherwise(is_upper_outlier(price, median) | is_lower_outlier(price, median))


def beats(best: Column, p: Column) -> Column:
    """Whether a later offer of a store takes the place of its best one."""
    return replaces(best, p) | ((p.price == best.price) & (p.updated > best.updated))


def replaces(held: Column, p: Column) -> Column:
    """Whether a later offer is merged over the held one: it is cheaper, or in stock where that is not."""
    return (p.price < held.price) | ((held.stock == "out-of-stock") & (p.stock != "out-of-stock"))


def replaces_or_newer(held: Column, p: Column) -> Column:
    return replaces(held, p) | (p.updated > held.updated)


def fold(offers: Column, better: Callable[[Column, Column], Column]) -> Column:
    """The offer left of an array in input order."""
    return F.aggregate(F.slice(offers, 2, F.size(offers)), offers[0], lambda held, p: F.when(better(held, p), p).otherwise(held))


def best_store_prices(prices: Column) -> Column:
    """Best offer per store of an array of offers in input order, cheapest first.

    The rule is a fold, not a total order: a cheaper offer wins; else one in stock replaces
    one out of stock; else a newer one of the same price.  Offers: struct with store_id,
    price, stock, updated and seq (the input order); stores compare in lower case.
    """
    usable = F.filter(prices, lambda p: (p.price > 0) & (F.coalesce(p.store_id, F.lit("")) != ""))
    ordered = F.array_sort(usable, lambda a, b: F.when(a.seq < b.seq, -1).when(a.seq > b.seq, 1).otherwise(0))

    def of_store(store: Column, all_prices: Column) -> Column:
        own = F.filter(all_prices, lambda p: F.lower(p.store_id) == store)
        return fold(own, beats)

    def pick(all_prices: Column) -> Column:
        stores = F.array_distinct(F.transform(all_prices, lambda p: F.lower(p.store_id)))
        best = F.transform(stores, lambda s: of_store(s, all_prices))
        return F.array_sort(best, lambda a, b: F.when(a.price < b.price, -1).when(a.price > b.price, 1).otherwise(0))

    return let(ordered, pick)


def array_median(values: Column) -> Column:
    def middle(v: Column) -> Column:
        half = F.floor(F.size(v) / 2).cast("int")
        return F.when(F.size(v) % 2 == 0, (v[half - 1] + v[half]) / 2).otherwise(v[half] * 1.0)

    return let(F.array_sort(values), middle)


def comparable_stats(prices: Column) -> Column:
    """Struct of comparable offers (cheapest first), lowest, highest and rounded average of an array of offers."""

    def split(valid: Column) -> Column:
        median, lowest = array_median(F.transform(valid, lambda p: p.price)), F.array_min(F.transform(valid, lambda p: p.price))
        kept = F.when(
            F.size(valid) > 1,
            let(F.struct(median.alias("m"), lowest.alias("l")), lambda s: F.filter(valid, lambda p: ~outlier(p.price, F.size(valid), s.m, s.l))),
        ).otherwise(valid)
        return let(F.when(F.size(kept) == 0, valid).otherwise(kept), summary)

    def summary(kept: Column) -> Column:
        values = F.transform(kept, lambda p: p.price)
        zero = F.lit(0).cast("long")
        total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        return F.struct(
            kept.alias("prices"),
            F.coalesce(F.array_min(values).cast("long"), zero).alias("lowest"),
            F.coalesce(F.array_max(values).cast("long"), zero).alias("highest"),
            F.when(F.size(kept) > 0, half_up(total / F.size(kept))).otherwise(zero).alias("average"),
        )

    valid = F.array_sort(F.filter(prices, lambda p: p.price > 0), lambda a, b: F.when(a.price < b.price, -1).when(a.price > b.price, 1).otherwise(0))
    return let(valid, split)


def merge_prices(prices: Column, newer_wins: bool) -> Column:
    """One offer per store of an array in input order; a later offer replaces the held one if it is
    cheaper, is in stock where the held one is not, or (``newer_wins``) is newer.  Stores keep their case."""

    def of_store(store: Column, all_prices: Column) -> Column:
        return fold(F.filter(all_prices, lambda p: p.store_id == store), replaces_or_newer if newer_wins else replaces)

    def pick(all_prices: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(all_prices, lambda p: p.store_id)), lambda s: of_store(s, all_prices))

    return let(F.array_sort(prices, lambda a, b: F.when(a.seq < b.seq, -1).when(a.seq > b.seq, 1).otherwise(0)), pick)


def instalment(total: Column, count: Column, rate: Column) -> Column:
    with_interest = total * (1 + rate)
    return F.struct(
        count.cast("long").alias("count"), half_up(with_interest / count).alias("amount"), half_up(with_interest).alias("total_amount"), (rate > 0).alias("interest")
    )


def discount_percent(original: Column, current: Column) -> Column:
    return F.when(original > 0, half_up((original - current) / original * 100)).otherwise(F.lit(0).cast("long"))


def price_change(current: Column, previous: Column) -> Column:
    amount = current - previous
    percent = F.when(previous > 0, half_up(amount / previous * 100)).otherwise(F.lit(0).cast("long"))
    direction = F.when(amount > 0, "up").when(amount < 0, "down").otherwise("same")
    return F.struct(amount.alias("amount"), percent.alias("percent"), direction.alias("direction"))


def discounted(price: Column, percent: Column) -> Column:
    return half_up(price * (1 - percent / 100))


def to_local_currency(usd: Column, rate: float = 1300) -> Column:
    return half_up(usd * rate)


def tercile(price: Column, lowest: Column, highest: Column) -> Column:
    share = (price - lowest) / F.nullif(highest - lowest, F.lit(0))
    return F.when(lowest == highest, "flat").when(share < 0.33, "low").when(share < 0.66, "middle").otherwise("high")


def format_price(amount: Column) -> Column:
    """``$ 1.234.567``: points between thousands, no decimals."""
    return F.concat(F.lit("$ "), F.translate(F.format_number(amount, 0), ",", "."))


def relevance(name: Column, category: Column, lowest: Column, query: str, wanted: str | None = None) -> Column:
    """Score of a product for a query."""
    words, phrase = query_words(query), plain_identity(query)

    def of(text: Column) -> Column:
        matched = sum((text.contains(w).cast("int") for w in words), F.lit(0))
        score = matched * C.SCORE_WORD
        if words:
            score = score + F.when(matched == len(words), C.SCORE_ALL).otherwise(0)
        if phrase:
            score = score + F.when(text.contains(phrase), C.SCORE_PHRASE).otherwise(0)
        return score

    score = let(identity_text(name), of)
    if wanted:
        score = score + F.when(category == wanted, C.SCORE_CATEGORY).otherwise(0)
    if not query_is_bundle(query):
        score = score + F.when(is_bundle(name), C.SCORE_BUNDLE).otherwise(0)
    cheap = F.when(lowest > 0, F.greatest(F.lit(0), C.SCORE_PRICE - F.floor(lowest / C.PRICE_STEP))).otherwise(0)
    return (score + cheap).cast("long")


def query_is_bundle(query: str) -> bool:
    text = plain_identity(query)
    return "+" in text or any(f" {t} " in f" {text} " for t in C.BUNDLE_TERMS)
