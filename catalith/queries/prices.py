"""Offers, best prices, outliers, statistics and joins of products with offers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import price as P
from ..operators import offers as O
from ..operators import runs
from ..registry import query
from ..sources.tables import view

_BEST = "best AS (SELECT product_id, store_id, min(price) AS price FROM offers WHERE price > 0 GROUP BY product_id, store_id)"
_FACTS = """facts AS (SELECT product_id, count(*) AS n, median(price) AS m, min(price) AS l FROM best GROUP BY product_id),
tested AS (SELECT product_id, store_id, price, n, m,
  CASE WHEN n <= 1 THEN FALSE WHEN n = 2 THEN price > l AND price / greatest(l, 1) >= 4 AND price - l >= 150000
  ELSE (m > 0 AND price / m >= 2.6 AND price - m >= greatest(50000, floor(m * 0.35 + 0.5))) OR (m > 0 AND price / m <= 0.38 AND m - price >= greatest(50000, floor(m * 0.35 + 0.5))) END AS o
  FROM best JOIN facts USING (product_id)),
marked AS (SELECT product_id, store_id, price, n, m AS median, o AND NOT bool_and(o) OVER (PARTITION BY product_id) AS discarded FROM tested)"""
_MARKED = f"{_BEST}, {_FACTS}"
_STATS = f"""{_MARKED}, stats AS (SELECT product_id, count(*) AS n_comparable, min(price) AS lowest, max(price) AS highest,
  CAST(floor(sum(price) / count(*) + 0.5) AS BIGINT) AS average FROM marked WHERE NOT discarded GROUP BY product_id)"""


def best(spark, d):
    return O.cheapest_per_store(view(spark, d, "offers"))


def stats(spark, d):
    return O.comparable_stats(best(spark, d))


@query("cheapest_per_store", f"WITH {_BEST} SELECT * FROM best")
def cheapest_per_store(spark, d):
    return best(spark, d)


@query("outlier_split", f"WITH {_MARKED} SELECT product_id, store_id, price, discarded FROM marked")
def outlier_split(spark, d):
    return O.mark_outliers(best(spark, d)).select("product_id", "store_id", "price", "discarded")


@query("comparable_stats", f"WITH {_STATS} SELECT * FROM stats")
def comparable_stats(spark, d):
    return stats(spark, d)


@query(
    "comparable_price_page",
    f"""WITH {_STATS} SELECT product_id, name, brand, n_comparable, lowest, highest, average FROM stats JOIN products USING (product_id)
ORDER BY lowest, product_id LIMIT 12""",
)
def comparable_price_page(spark, d):
    joined = view(spark, d, "products").select("product_id", "name", "brand").join(stats(spark, d), "product_id")
    return joined.orderBy("lowest", "product_id").limit(12)


@query("price_range_by_category", "SELECT hw_category, min(price) AS lowest, max(price) AS highest, CAST(floor(sum(price) / count(*) + 0.5) AS BIGINT) AS average FROM products JOIN offers USING (product_id) GROUP BY hw_category")
def price_range_by_category(spark, d):
    """Offers are summed per product before they meet the products."""
    per = view(spark, d, "offers").groupBy("product_id").agg(F.min("price").alias("lo"), F.max("price").alias("hi"), F.sum("price").alias("s"), F.count(F.lit(1)).alias("n"))
    joined = per.join(view(spark, d, "products").select("product_id", "hw_category"), "product_id").groupBy("hw_category")
    return joined.agg(F.min("lo").alias("lowest"), F.max("hi").alias("highest"), P.half_up(F.sum("s") / F.sum("n")).alias("average"))


@query("brand_least_price", "SELECT brand, coalesce(min(CASE WHEN retail <> 0 THEN retail END), 0) AS lowest FROM products GROUP BY brand")
def brand_least_price(spark, d):
    return view(spark, d, "products").groupBy("brand").agg(F.coalesce(F.min(F.nullif("retail", F.lit(0))), F.lit(0)).alias("lowest"))


@query(
    "offers_nested",
    "SELECT products.product_id, count(store_id) AS n_offers, coalesce(sum(price), 0)::BIGINT AS total FROM products LEFT JOIN offers USING (product_id) GROUP BY products.product_id",
)
def offers_nested(spark, d):
    offers = view(spark, d, "offers")
    nested = offers.groupBy("product_id").agg(F.collect_list(F.struct("store_id", "price", "stock")).alias("prices"))
    joined = view(spark, d, "products").select("product_id").join(nested, "product_id", "left")
    prices = F.coalesce("prices", F.array().cast("array<struct<store_id:bigint,price:bigint,stock:string>>"))
    total = F.aggregate(prices, F.lit(0).cast("long"), lambda a, p: a + p.price)
    return joined.select("product_id", F.size(prices).cast("long").alias("n_offers"), total.alias("total"))


@query(
    "store_name_lookup",
    """SELECT coalesce(store_name, CAST(offers.store_id AS VARCHAR)) AS store_name, count(*) AS n FROM offers
LEFT JOIN (SELECT * FROM stores WHERE is_active) s ON s.store_id = offers.store_id GROUP BY ALL""",
)
def store_name_lookup(spark, d):
    counted = view(spark, d, "offers").groupBy("store_id").agg(F.count(F.lit(1)).alias("n"))
    named = O.with_store_names(counted, view(spark, d, "stores").filter("is_active"))
    return named.groupBy("store_name").agg(F.sum("n").alias("n"))


@query("storeless_products", "SELECT product_id FROM products WHERE product_id NOT IN (SELECT product_id FROM offers JOIN stores USING (store_id) WHERE is_active AND stock <> 'out-of-stock')")
def storeless_products(spark, d):
    active = view(spark, d, "stores").filter("is_active").select("store_id")
    priced = view(spark, d, "offers").filter("stock <> 'out-of-stock'").join(active, "store_id").select("product_id")
    return view(spark, d, "products").select("product_id").join(priced, "product_id", "left_anti")


@query(
    "compare_two_products",
    f"""WITH {_BEST} SELECT coalesce(a.store_id, b.store_id) AS store_id, coalesce(a.price, 0) AS price_a, coalesce(b.price, 0) AS price_b
FROM (SELECT * FROM best WHERE product_id = 1) a FULL JOIN (SELECT * FROM best WHERE product_id = 2) b ON a.store_id = b.store_id""",
)
def compare_two_products(spark, d):
    offers = best(spark, d)
    return O.full_compare(offers.filter("product_id = 1"), offers.filter("product_id = 2"))


@query(
    "multi_store_products",
    "SELECT product_id, count(DISTINCT store_id) AS n_stores FROM offers WHERE price > 0 GROUP BY product_id HAVING count(DISTINCT store_id) >= 2",
)
def multi_store_products(spark, d):
    return view(spark, d, "offers").filter("price > 0").groupBy("product_id").agg(F.count_distinct("store_id").alias("n_stores")).filter("n_stores >= 2")


@query(
    "health_counts",
    f"""WITH {_STATS} SELECT count(*) AS total, count(*) FILTER (WHERE lowest IS NULL) AS without_prices, count(lowest) AS with_prices,
  greatest(0, count(*) - count(*) FILTER (WHERE lowest IS NULL)) AS healthy FROM products LEFT JOIN stats USING (product_id)""",
)
def health_counts(spark, d):
    joined = view(spark, d, "products").select("product_id").join(stats(spark, d).select("product_id", "lowest"), "product_id", "left")
    missing = F.count_if(F.col("lowest").isNull())
    return joined.agg(
        F.count(F.lit(1)).alias("total"), missing.alias("without_prices"), F.count("lowest").alias("with_prices"),
        F.greatest(F.lit(0).cast("long"), F.count(F.lit(1)) - missing).alias("healthy"),
    )


@query(
    "store_subset_stats",
    """WITH best AS (SELECT product_id, store_id, min(price) AS price FROM offers WHERE price > 0 AND store_id IN (SELECT store_id FROM stores WHERE is_active) GROUP BY product_id, store_id)
SELECT product_id, min(price) AS lowest, count(*) AS n FROM best GROUP BY product_id HAVING min(price) BETWEEN 100000 AND 3000000""",
)
def store_subset_stats(spark, d):
    active = view(spark, d, "stores").filter("is_active").select("store_id")
    own = O.cheapest_per_store(view(spark, d, "offers").join(active, "store_id", "left_semi"))
    grouped = own.groupBy("product_id").agg(F.min("price").alias("lowest"), F.count(F.lit(1)).alias("n"))
    return grouped.filter("lowest between 100000 and 3000000")


def nested(spark, d):
    return O.nested(view(spark, d, "offers"), ["updated", "order_id", "line", "store_id", "price", "original"])


_SEQ = "seq AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY updated, order_id, line, store_id, price, original) AS k FROM offers WHERE price > 0)"
_FOLD = """, step AS (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY k) AS i FROM seq),
fold AS (
  SELECT product_id, store_id, i, price, stock, updated FROM step WHERE i = 1
  UNION ALL
  SELECT s.product_id, s.store_id, s.i,
    CASE WHEN {0} THEN s.price ELSE f.price END, CASE WHEN {0} THEN s.stock ELSE f.stock END, CASE WHEN {0} THEN s.updated ELSE f.updated END
  FROM fold f JOIN step s ON s.product_id = f.product_id AND s.store_id = f.store_id AND s.i = f.i + 1
)"""
_LAST = "SELECT product_id, store_id, price::DOUBLE AS price, stock FROM fold QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY i DESC) = 1"
_CHEAPER = "s.price < f.price OR (f.stock = 'out-of-stock' AND s.stock <> 'out-of-stock')"


_ORDER = ["updated", "order_id", "line", "store_id", "price", "original"]


def _folded(spark, d, better):
    offers = view(spark, d, "offers").filter("price > 0").withColumn("price", F.col("price").cast("double"))
    return runs.fold_offers(offers, ["product_id", "store_id"], _ORDER, better).select("product_id", "store_id", "price", "stock")


@query("best_price_fold", f"WITH RECURSIVE {_SEQ}{_FOLD.format(_CHEAPER + ' OR (s.price = f.price AND s.updated > f.updated)')} {_LAST}")
def best_price_fold(spark, d):
    return _folded(spark, d, runs.beats)


@query("merge_prices_search", f"WITH RECURSIVE {_SEQ}{_FOLD.format(_CHEAPER)} {_LAST}")
def merge_prices_search(spark, d):
    return _folded(spark, d, runs.replaces)


@query("merge_prices_catalogue", f"WITH RECURSIVE {_SEQ}{_FOLD.format(_CHEAPER + ' OR s.updated > f.updated')} {_LAST}")
def merge_prices_catalogue(spark, d):
    return _folded(spark, d, runs.replaces_or_newer)


@query(
    "fold_stats",
    f"""WITH RECURSIVE {_SEQ}{_FOLD.format(_CHEAPER + " OR (s.price = f.price AND s.updated > f.updated)")}, best AS ({_LAST}), {_FACTS}
SELECT product_id, CAST(min(price) AS BIGINT) AS lowest, CAST(max(price) AS BIGINT) AS highest, CAST(floor(sum(price) / count(*) + 0.5) AS BIGINT) AS average
FROM marked WHERE NOT discarded GROUP BY product_id""",
)
def fold_stats(spark, d):
    found = O.comparable_stats(_folded(spark, d, runs.beats))
    return found.select("product_id", F.col("lowest").cast("long").alias("lowest"), F.col("highest").cast("long").alias("highest"), "average")


@query(
    "instalments",
    """SELECT product_id, CAST(6 AS BIGINT) AS n, CAST(floor(retail * 1.25 / 6 + 0.5) AS BIGINT) AS amount, CAST(floor(retail * 1.25 + 0.5) AS BIGINT) AS total, TRUE AS interest FROM products""",
)
def instalments(spark, d):
    found = view(spark, d, "products").select("product_id", P.instalment(F.col("retail"), F.lit(6), F.lit(0.25)).alias("i"))
    return found.select("product_id", F.col("i.count").alias("n"), F.col("i.amount"), F.col("i.total_amount").alias("total"), F.col("i.interest"))


@query(
    "price_changes",
    """SELECT product_id, store_id, order_id, line, price, original, CASE WHEN original > 0 THEN CAST(floor((original - price) / original * 100 + 0.5) AS BIGINT) ELSE 0 END AS discount,
  CASE WHEN price > original THEN 'up' WHEN price < original THEN 'down' ELSE 'same' END AS direction FROM offers""",
)
def price_changes(spark, d):
    change = P.price_change(F.col("price"), F.col("original"))
    offers = view(spark, d, "offers").withColumn("c", change)
    return offers.select("product_id", "store_id", "order_id", "line", "price", "original", P.discount_percent(F.col("original"), F.col("price")).alias("discount"), "c.direction")


@query(
    "price_terciles",
    f"""WITH {_STATS} SELECT product_id, store_id, CASE WHEN lowest = highest THEN 'flat' WHEN (price - lowest) / (highest - lowest) < 0.33 THEN 'low'
  WHEN (price - lowest) / (highest - lowest) < 0.66 THEN 'middle' ELSE 'high' END AS bucket FROM marked JOIN stats USING (product_id) WHERE NOT discarded""",
)
def price_terciles(spark, d):
    kept = O.mark_outliers(best(spark, d)).filter(~F.col("discarded")).select("product_id", "store_id", "price")
    group = Window.partitionBy("product_id")
    bucket = P.tercile(F.col("price"), F.min("price").over(group), F.max("price").over(group))
    return kept.select("product_id", "store_id", bucket.alias("bucket"))


@query(
    "price_positions",
    f"WITH {_BEST} SELECT product_id, store_id, row_number() OVER (PARTITION BY product_id ORDER BY price, store_id) AS place, price - min(price) OVER (PARTITION BY product_id) AS above FROM best",
)
def price_positions(spark, d):
    group = Window.partitionBy("product_id")
    place = F.row_number().over(group.orderBy("price", "store_id")).cast("long")
    return best(spark, d).select("product_id", "store_id", place.alias("place"), (F.col("price") - F.min("price").over(group)).alias("above"))


@query(
    "alert_triggers",
    """WITH latest AS (SELECT product_id, arg_max(price, (updated, order_id, line, store_id, price)) AS now, min(price) AS least FROM offers GROUP BY product_id)
SELECT user_id, favourites.product_id, CASE WHEN now <= least THEN 'new_low' WHEN now <= retail THEN 'target_price' ELSE 'none' END AS trigger
FROM favourites JOIN latest USING (product_id) JOIN products USING (product_id)""",
)
def alert_triggers(spark, d):
    """Alerts per favourite: the product's last price is its least so far, or at most its target."""
    offers = view(spark, d, "offers")
    last = F.max_by("price", F.struct("updated", "order_id", "line", "store_id", "price"))
    latest = offers.groupBy("product_id").agg(last.alias("now"), F.min("price").alias("least"))
    joined = latest.join(view(spark, d, "products").select("product_id", "retail"), "product_id")
    kind = F.when(F.col("now") <= F.col("least"), "new_low").when(F.col("now") <= F.col("retail"), "target_price").otherwise("none")
    return view(spark, d, "favourites").join(joined.select("product_id", kind.alias("trigger")), "product_id").select("user_id", "product_id", "trigger")
