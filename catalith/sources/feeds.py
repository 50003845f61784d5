"""JSON catalogue feeds as offers: nested and doubly encoded payloads, dimension lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import infer_category

ITEM = "id string, name string, price string, list_price string, stock string, on_sale boolean, subcategory_id string, brand_id string, codes array<string>"


def positive(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(number > 0, F.floor(number).cast("long"))


def stock_label(value: Column) -> Column:
    """out-of-stock for nothing, low-stock up to two, else in-stock; a missing number is unknown."""
    n = value.try_cast("long")
    return F.when(n.isNull(), "unknown").when(n <= 0, "out-of-stock").when(n <= 2, "low-stock").otherwise("in-stock")


def map_items(items: DataFrame, subcategories: DataFrame, brands: DataFrame, store_id: str) -> DataFrame:
    """Offers of a feed: dimension names, category from the subcategory or the name, the special price first.

    Dimensions are joined, not looked up row by row; Catalyst broadcasts them by their size.
    """
    joined = items.join(subcategories.select("subcategory_id", "category"), "subcategory_id", "left")
    joined = joined.join(brands.select("brand_id", "brand"), "brand_id", "left")
    price = F.coalesce(positive(F.col("price")), positive(F.col("list_price")))
    return joined.filter(F.coalesce("on_sale", F.lit(False)) & price.isNotNull()).select(
        F.concat(F.lit(store_id + "-"), F.col("id")).alias("product_id"),
        F.lit(store_id).alias("store_id"),
        F.trim("name").alias("name"),
        F.coalesce("category", infer_category(F.col("name"))).alias("category"),
        F.coalesce("brand", F.lit("Generica")).alias("brand"),
        price.alias("price"),
        positive(F.col("list_price")).alias("original_price"),
        stock_label(F.col("stock")).alias("stock"),
        F.element_at("codes", 1).alias("sku"),
    )


def decode_rpc(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Items of an RPC answer whose ``d`` field is a JSON text that holds the items."""
    inner = F.from_json(F.get_json_object(column, "$.d"), "struct<data: struct<items: array<struct<item_id: string, item_desc: string, prli_price: string>>>>")
    return payloads.select(F.explode(inner["data"]["items"]).alias("i")).select(
        F.col("i.item_id").alias("id"), F.col("i.item_desc").alias("name"), positive(F.col("i.prli_price")).alias("price")
    )


def matches_feed_query(name: Column, item_id: Column, text: str) -> Column:
    """The phrase, all its words, or the item's number."""
    from ..functions.text import identity_text, plain_identity

    phrase, normal = plain_identity(text), identity_text(name)
    hit = normal.contains(phrase)
    every = F.lit(True)
    for w in phrase.split():
        every = every & normal.contains(w)
    return hit | every | (item_id == text.strip())
