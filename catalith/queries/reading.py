"""Scans, lookups, filters, sorts, pages and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import reading as R
from ..registry import query
from ..sources.tables import raw, view


@query("scan_project_filter", "SELECT product_id, name, category, brand FROM products WHERE category = 'ECONOMY ANODIZED' OR product_id <= 100")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "products").select("product_id", "name", "category", "brand").filter("category = 'ECONOMY ANODIZED' or product_id <= 100")


@query("filter_category_price", "SELECT product_id, retail FROM products WHERE hw_category = 'motherboards' AND retail >= 95000 AND retail <= 120000")
def filter_category_price(spark, d):
    table = view(spark, d, "products").withColumnRenamed("retail", "lowest").withColumnRenamed("category", "_c").withColumnRenamed("hw_category", "category")
    return R.by_category_and_price(table, "motherboards", 95000, 120000).select("product_id", F.col("lowest").alias("retail"))


@query("point_lookup", "SELECT product_id, name, brand FROM products WHERE product_id = 42")
def point_lookup(spark, d):
    return view(spark, d, "products").filter("product_id = 42").limit(1).select("product_id", "name", "brand")


@query(
    "representative_by_key",
    "SELECT product_id, retail FROM products QUALIFY row_number() OVER (PARTITION BY hw_category, title ORDER BY retail DESC, product_id) = 1",
)
def representative_by_key(spark, d):
    """The dearest product of each canonical key; these titles have a key each."""
    from ..operators import resolve

    named = view(spark, d, "products").withColumns({"brand": F.lit(""), "model": F.lit(""), "name": F.col("title")})
    keyed = resolve.with_keys(named).select("product_id", "retail", "canonical_key")
    return R.first_by(keyed, ["canonical_key"], [F.col("retail").desc(), F.col("product_id")]).select("product_id", "retail")


@query("catalogue_page", "SELECT product_id, retail FROM products ORDER BY retail DESC, product_id LIMIT 12 OFFSET 24")
def catalogue_page(spark, d):
    return R.page(view(spark, d, "products").select("product_id", "retail"), [F.col("retail").desc(), F.col("product_id")], 3)


@query("page_facts", "SELECT 12::BIGINT AS size, count(*) AS total, CAST(ceil(count(*) / 12.0) AS BIGINT) AS pages FROM products")
def page_facts(spark, d):
    return view(spark, d, "products").agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(12).cast("long").alias("size"), "total", F.ceil(F.col("total") / 12.0).alias("pages")
    )


@query("count_only", "SELECT count(*) AS total FROM products WHERE hw_category = 'perifericos'")
def count_only(spark, d):
    return view(spark, d, "products").filter("hw_category = 'perifericos'").agg(F.count(F.lit(1)).alias("total"))


@query(
    "popular_products",
    """WITH recent AS (SELECT product_id, retail FROM products WHERE retail > 0 ORDER BY retail DESC, product_id LIMIT 40)
SELECT product_id, count(DISTINCT store_id) AS n_stores FROM recent JOIN offers USING (product_id) GROUP BY product_id HAVING count(DISTINCT store_id) >= 2""",
)
def popular_products(spark, d):
    recent = view(spark, d, "products").filter("retail > 0").orderBy(F.col("retail").desc(), "product_id").limit(40)
    joined = view(spark, d, "offers").join(recent.select("product_id"), "product_id")
    return joined.groupBy("product_id").agg(F.count_distinct("store_id").alias("n_stores")).filter("n_stores >= 2")


@query(
    "stores_list",
    """WITH fixed AS (SELECT * FROM (VALUES (1, 'Store One'), (1000001, 'Online Only')) v(store_id, store_name))
SELECT store_id, store_name FROM stores WHERE is_active UNION ALL SELECT store_id, store_name FROM fixed WHERE store_id NOT IN (SELECT store_id FROM stores)""",
)
def stores_list(spark, d):
    stores = view(spark, d, "stores")
    fixed = spark.createDataFrame([(1, "Store One"), (1000001, "Online Only")], "store_id long, store_name string")
    missing = fixed.join(stores.select("store_id"), "store_id", "left_anti")
    return stores.filter("is_active").select("store_id", "store_name").unionByName(missing).orderBy("store_name", "store_id")


@query("store_selection", "SELECT store_id FROM stores WHERE lower(store_name) IN ('supplier#000000002', 'supplier#000000005')")
def store_selection(spark, d):
    wanted = [s.strip().lower() for s in (" Supplier#000000002", "SUPPLIER#000000005 ")]
    return view(spark, d, "stores").filter(F.lower("store_name").isin(wanted)).select("store_id")


@query("search_phrase", "SELECT product_id FROM products WHERE title ILIKE '%rtx 306%' OR name ILIKE '%rtx 306%' OR brand ILIKE '%rtx 306%'")
def search_phrase(spark, d):
    return R.phrase_filter(view(spark, d, "products"), "rtx  306,", ["title", "name", "brand"]).select("product_id")


_NORMAL = (
    "trim(regexp_replace(regexp_replace(lower(translate({0}, '" + C.ACCENTED + "', '" + C.PLAIN + "')), '[^a-z0-9+\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
)


def normal(column: str) -> str:
    return _NORMAL.format(column)


@query("text_filter_any_word", f"SELECT product_id FROM products WHERE {normal('title')} LIKE '%shadow%' OR {normal('title')} LIKE '%optico%'")
def text_filter_any_word(spark, d):
    return R.any_word_filter(view(spark, d, "products"), "Shadow ÓPTICO x", ["title"]).select("product_id")


_WORDS = " + ".join(f"({normal('title')} LIKE '%{w}%')::INT" for w in ("mouse", "logitech", "hero", "g303"))


@query("query_word_coverage", f"SELECT product_id FROM products WHERE {_WORDS} >= 3")
def query_word_coverage(spark, d):
    return view(spark, d, "products").filter(R.covers_query(F.col("title"), "mouse logitech hero G303")).select("product_id")


@query(
    "query_intent",
    rf"""SELECT product_id FROM products WHERE ({normal('title')} LIKE '%ryzen%') AND ({normal('title')} LIKE '%3000%')
  AND ({normal('title')} LIKE '%3000x%' OR regexp_matches({normal('title')}, '\b3000\s+x\b'))""",
)
def query_intent(spark, d):
    return view(spark, d, "products").filter(R.matches_intent(F.col("title"), "Ryzen 3000 x")).select("product_id")


@query("strict_variants", rf"SELECT product_id FROM products WHERE regexp_matches({normal('title')}, '\bshadow\b')")
def strict_variants(spark, d):
    return view(spark, d, "products").filter(R.has_strict_variants(F.col("title"), "placa shadow 8gb")).select("product_id")


_BUNDLE = " OR ".join(f"replace({normal('title')}, '+', ' ') LIKE '%{t}%'" for t in C.COMPONENT_BUNDLE_TERMS)


@query("standalone_components", f"SELECT product_id FROM products WHERE NOT (hw_category IN ('procesadores', 'tarjetas-graficas', 'memoria-ram') AND ({_BUNDLE}))")
def standalone_components(spark, d):
    return view(spark, d, "products").filter(R.is_standalone(F.col("title"), F.col("hw_category"))).select("product_id")


@query("in_stock_products", "SELECT DISTINCT product_id FROM offers WHERE stock IN ('in-stock', 'low-stock')")
def in_stock_products(spark, d):
    prices = view(spark, d, "offers").groupBy("product_id").agg(F.collect_set(F.struct("stock")).alias("prices"))
    return prices.filter(R.is_in_stock(F.col("prices"))).select("product_id")


@query(
    "stale_products",
    """SELECT product_id, max(updated) AS updated FROM offers GROUP BY product_id
HAVING max(updated) < (SELECT max(updated) FROM offers) - INTERVAL 30 DAY""",
)
def stale_products(spark, d):
    offers = view(spark, d, "offers")
    latest = offers.groupBy("product_id").agg(F.max("updated").alias("updated"))
    as_of = offers.agg(F.max("updated").alias("as_of"))
    return latest.join(F.broadcast(as_of)).filter(R.is_stale(F.col("updated"), F.col("as_of"), 30 * 24 * 60)).select("product_id", "updated")


@query(
    "weak_descriptions",
    r"""SELECT doc_id FROM documents WHERE length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) < 24""",
)
def weak_descriptions(spark, d):
    return raw(spark, d, "documents").filter(R.weak_description(F.col("text"), F.lit("no such name"))).select("doc_id")


@query("comparison_terms", f"SELECT product_id FROM products WHERE ({normal('title')} LIKE '%rtx%' AND {normal('title')} LIKE '%3060%') OR ({normal('title')} LIKE '%ryzen%' AND {normal('title')} LIKE '%5600%')")
def comparison_terms(spark, d):
    return view(spark, d, "products").filter(R.matches_terms(F.col("title"), ["RTX 3060", "Ryzen 5600"])).select("product_id")


@query("allowed_hosts", r"SELECT page_id FROM pages WHERE regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '(^|\.)example\.(com|org)$')")
def allowed_hosts(spark, d):
    return raw(spark, d, "pages").filter(R.host_allowed(F.col("url"), ["example.com", "example.org"])).select("page_id")


@query("owner_rows", "SELECT product_id FROM favourites WHERE user_id = 7")
def owner_rows(spark, d):
    return view(spark, d, "favourites").filter("user_id = 7").select("product_id")


@query("sponsored_links", "SELECT store_id, CASE WHEN store_id IN (2, 3, 5) THEN 'sponsored' ELSE 'plain' END AS link FROM stores")
def sponsored_links(spark, d):
    paid = spark.createDataFrame([(2,), (3,), (5,)], "store_id long").withColumn("paid", F.lit(True))
    joined = view(spark, d, "stores").join(F.broadcast(paid), "store_id", "left")
    return joined.select("store_id", F.when(F.col("paid"), "sponsored").otherwise("plain").alias("link"))


# ------------------------------------------------------------ sorts and tops


_SORTED = "SELECT product_id, CAST(row_number() OVER (ORDER BY {0}) AS BIGINT) AS place FROM products WHERE hw_category = 'motherboards' ORDER BY place LIMIT 60"


def _sorted(spark, d, *order):
    """The first 60 products in an order and their places: a top-k, then places among the few."""
    top = view(spark, d, "products").filter("hw_category = 'motherboards'").orderBy(*order).limit(60)
    return top.select("product_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("sort_price_asc", _SORTED.format("retail, product_id"))
def sort_price_asc(spark, d):
    return _sorted(spark, d, F.col("retail"), F.col("product_id"))


@query("sort_price_desc", _SORTED.format("retail DESC, product_id"))
def sort_price_desc(spark, d):
    return _sorted(spark, d, F.col("retail").desc(), F.col("product_id"))


@query("sort_name", _SORTED.format("title, product_id"))
def sort_name(spark, d):
    return _sorted(spark, d, F.collate("title", "es"), F.col("product_id"))


@query(
    "match_rank",
    f"""SELECT product_id, CAST({_WORDS} AS BIGINT) AS matched FROM products WHERE {_WORDS} > 0 ORDER BY matched DESC, retail, product_id LIMIT 20""",
)
def match_rank(spark, d):
    table = view(spark, d, "products").withColumn("matched", T.matched_words(F.col("title"), T.query_words("mouse logitech hero g303")).cast("long"))
    return table.filter("matched > 0").orderBy(F.col("matched").desc(), "retail", "product_id").limit(20).select("product_id", "matched")


@query(
    "priority_order",
    "SELECT store_id, store_name FROM stores ORDER BY CASE store_id WHEN 5 THEN 1 WHEN 3 THEN 2 ELSE 1000 END, store_id LIMIT 10",
)
def priority_order(spark, d):
    place = F.array_position(F.array(F.lit(5), F.lit(3)), F.col("store_id").cast("int"))
    return view(spark, d, "stores").orderBy(F.when(place == 0, 1000).otherwise(place), "store_id").limit(10).select("store_id", "store_name")


@query(
    "recently_viewed",
    """SELECT source, value AS item, place FROM (
  SELECT source, latency % 50 AS value, row_number() OVER (PARTITION BY source ORDER BY max(ts) DESC, latency % 50) AS place FROM requests GROUP BY source, latency % 50)
WHERE place <= 16""",
)
def recently_viewed(spark, d):
    seen = view(spark, d, "requests").groupBy("source", (F.col("latency") % 50).alias("item")).agg(F.max("ts").alias("ts"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.col("ts").desc(), "item"))
    return seen.select("source", "item", place.cast("long").alias("place")).filter("place <= 16")


@query("bounded_buffer", "SELECT event_id FROM requests ORDER BY ts DESC, event_id DESC LIMIT 1000")
def bounded_buffer(spark, d):
    return view(spark, d, "requests").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(1000).select("event_id")


# ------------------------------------------------------------ sets


@query("union_sources", "SELECT product_id FROM offers WHERE store_id = 1 UNION ALL SELECT product_id FROM offers WHERE store_id = 2")
def union_sources(spark, d):
    offers = view(spark, d, "offers")
    return offers.filter("store_id = 1").select("product_id").unionByName(offers.filter("store_id = 2").select("product_id"))


@query("union_distinct_ids", "SELECT product_id FROM favourites WHERE user_id <= 3 UNION SELECT product_id FROM offers WHERE store_id = 1")
def union_distinct_ids(spark, d):
    return view(spark, d, "favourites").filter("user_id <= 3").select("product_id").union(view(spark, d, "offers").filter("store_id = 1").select("product_id")).distinct()


@query("except_selected", "SELECT product_id FROM products WHERE hw_category = 'motherboards' AND product_id NOT IN (SELECT product_id FROM products ORDER BY retail, product_id LIMIT 50)")
def except_selected(spark, d):
    products = view(spark, d, "products")
    chosen = products.orderBy("retail", "product_id").limit(50).select("product_id")
    return products.filter("hw_category = 'motherboards'").select("product_id").join(chosen, "product_id", "left_anti")


@query("first_of_each", "SELECT name, min(product_id) AS product_id FROM products GROUP BY name")
def first_of_each(spark, d):
    return view(spark, d, "products").groupBy("name").agg(F.min("product_id").alias("product_id"))


@query("tracked_products", "SELECT DISTINCT product_id FROM products WHERE product_id IN (SELECT product_id FROM favourites JOIN users USING (user_id) WHERE segment = 'BUILDING')")
def tracked_products(spark, d):
    chosen = view(spark, d, "users").filter("segment = 'BUILDING'").select("user_id")
    tracked = view(spark, d, "favourites").join(chosen, "user_id").select("product_id")
    return view(spark, d, "products").select("product_id").join(tracked, "product_id", "left_semi")


@query("region_hierarchy", "SELECT r_name AS parent, n_name AS child, CAST(2 AS BIGINT) AS depth FROM region JOIN nation ON n_regionkey = r_regionkey")
def region_hierarchy(spark, d):
    joined = raw(spark, d, "nation").join(raw(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.lit(2).cast("long").alias("depth"))


@query(
    "facet_counts",
    """SELECT hw_category, brand, count(*) AS n FROM products GROUP BY GROUPING SETS ((hw_category), (brand), ())""",
)
def facet_counts(spark, d):
    return view(spark, d, "products").groupingSets([["hw_category"], ["brand"], []], "hw_category", "brand").agg(F.count(F.lit(1)).alias("n"))
