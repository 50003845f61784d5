"""Texts for comparison and budget pages, and the public sitemap, for all pages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import price as P
from ..functions.text import slug


def thousands(amount: Column) -> Column:
    """Digits with points between thousands."""
    return F.translate(F.format_number(amount, 0), ",", ".")


def _lines(offers: DataFrame, most: int = 5) -> DataFrame:
    """product_id, n_stores and the lines of its cheapest offers (product_id, store_id, price)."""
    order = F.struct("price", "store_id")
    top = offers.groupBy("product_id").agg(F.count(F.lit(1)).alias("n_stores"), F.min("price").alias("lowest"))
    few = offers.withColumn("k", F.row_number().over(Window.partitionBy("product_id").orderBy("price", "store_id"))).filter(F.col("k") <= most)
    line = F.concat(F.lit("- "), F.col("store_id").cast("string"), F.lit(": $"), thousands(F.col("price")))
    listed = few.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("line")))).alias("l"))
    return top.join(listed.select("product_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines")), "product_id")


def _two(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        named = facts.select(*(F.col(c).alias(f"{c}_{side}") for c in facts.columns))
        pairs = pairs.join(named, f"product_id_{side}", "left")
    return pairs


def comparison_texts(pairs: DataFrame, products: DataFrame, offers: DataFrame) -> DataFrame:
    """slug and text of each comparison (slug, title, product_id_a, product_id_b); a product without offers leaves a note."""
    facts = products.select("product_id", "name").join(_lines(offers), "product_id")
    both = _two(pairs, facts)
    low = {s: F.col(f"lowest_{s}") for s in "ab"}
    most = F.greatest(low["a"], low["b"])
    saving = {s: P.half_up((1 - low[s] / most) * 100).cast("string") for s in "ab"}
    name = {s: F.col(f"name_{s}") for s in "ab"}
    gain = lambda s, o: F.when(low[s] < low[o], F.concat(F.lit("Querés ahorrar $"), thousands(low[o] - low[s]))).otherwise("Preferís esta marca")
    more = F.when(F.col("n_stores_b") > F.col("n_stores_a"), "más opciones de tiendas").otherwise("otras características")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), F.col("title")),
        F.concat(F.lit("| Característica | "), name["a"], F.lit(" | "), name["b"], F.lit(" |")),
        F.concat(F.lit("| **Mejor Precio** | $"), thousands(low["a"]), F.lit(" | $"), thousands(low["b"]), F.lit(" |")),
        F.concat(F.lit("| **Tiendas** | "), F.col("n_stores_a"), F.lit(" disponibles | "), F.col("n_stores_b"), F.lit(" disponibles |")),
        F.concat(F.lit("| **Ahorro** | Hasta "), saving["a"], F.lit("% | Hasta "), saving["b"], F.lit("% |")),
        F.concat(F.lit("**Elegí "), name["a"], F.lit(" si:** "), gain("a", "b")),
        F.concat(F.lit("**Elegí "), name["b"], F.lit(" si:** "), gain("b", "a"), F.lit("; buscás "), more),
        F.concat(F.lit("**"), name["a"], F.lit(":**")),
        F.col("lines_a"),
        F.concat(F.lit("**"), name["b"], F.lit(":**")),
        F.col("lines_b"),
    )
    missing = F.concat(F.lit("## "), F.col("title"), F.lit("\nEstamos actualizando los precios."))
    ready = low["a"].isNotNull() & low["b"].isNotNull()
    return both.select("slug", F.when(ready, text).otherwise(missing).alias("text"))


def budget_lines(products: DataFrame, offers: DataFrame, most: int = 6) -> DataFrame:
    """The newest products of a budget page as lines: name, least price, stores (product_id, name, updated)."""
    facts = offers.groupBy("product_id").agg(F.min("price").alias("lowest"), F.count(F.lit(1)).alias("n"))
    first = products.join(facts, "product_id").orderBy(F.desc("updated"), "product_id").limit(most)
    line = F.concat(F.lit("- **"), F.col("name"), F.lit("**: Desde $"), thousands(F.col("lowest")), F.lit(" ("), F.col("n").cast("string"), F.lit(" tiendas)"))
    return first.select("product_id", line.alias("line"))


def public_sitemap(site: str, comparisons: DataFrame, guides: DataFrame) -> DataFrame:
    """url, frequency and priority of the fixed pages, the categories, and every comparison and guide (name)."""
    spark = comparisons.sparkSession
    fixed = [*C.PUBLIC_PAGES, *((f"/search?category={c}", "hourly", 0.8) for c in C.CATEGORIES)]
    of = lambda table, path: table.select(F.concat(F.lit(path), slug(F.col("name"))).alias("path")).distinct().select("path", F.lit("daily").alias("frequency"), F.lit(0.85).alias("priority"))
    pages = spark.createDataFrame(fixed, "path string, frequency string, priority double").unionByName(of(comparisons, "/comparativa/")).unionByName(of(guides, "/guia/"))
    return pages.select(F.concat(F.lit(site), F.col("path")).alias("url"), "frequency", "priority")
