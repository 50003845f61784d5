"""Sanitised rows, product pages, lookups by id, corrections of stored rows, small rules of feeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import details as D
from ..functions import price as P
from ..functions import text as T
from ..functions import urls as U
from ..operators import offers as O
from ..operators import reading as R
from ..operators import resolve
from ..registry import query
from ..sources.tables import raw, view
from .prices import _STATS, best, stats
from .reading import normal

_UNIT = "l_extendedprice / l_quantity"


@query(
    "sanitised_offers",
    f"""SELECT l_orderkey AS order_id, l_linenumber AS line, CAST(floor({_UNIT} + 0.5) AS BIGINT) AS price, coalesce(nullif(trim(s_name), ''), CAST(l_suppkey AS VARCHAR)) AS store_name
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s_suppkey = l_suppkey WHERE l_suppkey IS NOT NULL AND {_UNIT} > 0""",
)
def sanitised_offers(spark, d):
    """Offers without a store or price go; prices are rounded, stores without a name show their id."""
    names = raw(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.trim("s_name").alias("name"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    valid = raw(spark, d, "lineitem").filter(F.col("l_suppkey").isNotNull() & (unit > 0)).join(names, "l_suppkey", "left")
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("l_suppkey").cast("string"))
    return valid.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), P.half_up(unit).alias("price"), name.alias("store_name"))


@query("sanitised_specs", "SELECT p_partkey AS product_id, 2::BIGINT AS n, CAST(p_size AS VARCHAR) AS size, p_type AS container FROM part")
def sanitised_specs(spark, d):
    """Maps of specifications with collapsed texts; empty entries go, the last of equal keys stays."""
    size, box = F.col("p_size").cast("string"), F.col("p_type")
    entries = [" Size ", F.lit("old"), "Size", F.concat(F.lit("  "), size, F.lit(" ")), "Container", box, " ", box, "Empty", F.lit("   ")]
    specs = F.create_map(*(F.lit(e) if isinstance(e, str) else e for e in entries))
    clean = raw(spark, d, "part").select(F.col("p_partkey").alias("product_id"), D.clean_map(specs).alias("m"))
    return clean.select("product_id", F.size("m").cast("long").alias("n"), F.col("m")["Size"].alias("size"), F.col("m")["Container"].alias("container"))


_PRODUCT_NAME = r"trim(regexp_replace(title, '\s+', ' ', 'g'))"


@query(
    "sanitised_products",
    f"""WITH {_STATS} SELECT product_id, {_PRODUCT_NAME} AS name, coalesce(nullif(trim(CASE WHEN hw_category = 'perifericos' THEN ' ' ELSE brand END), ''), 'Generica') AS brand, {_PRODUCT_NAME} AS model,
  coalesce(lowest, retail) AS lowest, coalesce(highest, retail) AS highest, coalesce(average, retail) AS average FROM products LEFT JOIN stats USING (product_id)""",
)
def sanitised_products(spark, d):
    """Texts with their defaults and recomputed statistics; stored ones stay only where no offer is left."""
    joined = view(spark, d, "products").join(stats(spark, d), "product_id", "left")
    name, brand = T.collapse(F.col("title")), F.when(F.col("hw_category") == "perifericos", F.lit(" ")).otherwise(F.col("brand"))
    numbers = [F.coalesce(c, "retail").alias(c) for c in ("lowest", "highest", "average")]
    return joined.select("product_id", name.alias("name"), F.coalesce(F.nullif(T.collapse(brand), F.lit("")), F.lit(C.DEFAULT_BRAND)).alias("brand"), name.alias("model"), *numbers)


@query("hydrated_rows", "SELECT event_id, ts FROM requests")
def hydrated_rows(spark, d):
    """Rows from JSON with their times parsed."""
    micros = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    text = view(spark, d, "requests").select(F.to_json(F.struct("event_id", "ts"), micros).alias("j"))
    return text.select(F.from_json("j", "event_id long, ts timestamp", micros).alias("r")).select("r.*")


@query(
    "card_drops",
    f"""WITH {_STATS}, o AS (SELECT product_id, max(original) AS original FROM offers GROUP BY product_id),
b AS (SELECT product_id, lowest, greatest(highest, original) AS baseline FROM stats JOIN o USING (product_id)),
c AS (SELECT product_id, baseline, baseline - lowest AS amount, CAST(floor((baseline - lowest) / baseline * 100 + 0.5) AS BIGINT) AS percent FROM b WHERE baseline > lowest)
SELECT product_id, baseline, amount, percent FROM c WHERE amount >= 10000 OR percent >= 5""",
)
def card_drops(spark, d):
    """The second drop rule: against the greatest comparable or original price, on a rounded percentage."""
    original = view(spark, d, "offers").groupBy("product_id").agg(F.max("original").alias("original"))
    joined = stats(spark, d).join(original, "product_id").withColumn("baseline", F.greatest("highest", "original")).filter("baseline > lowest")
    amount = F.col("baseline") - F.col("lowest")
    found = joined.select("product_id", "baseline", amount.alias("amount"), P.half_up(amount / F.col("baseline") * 100).alias("percent"))
    return found.filter((F.col("amount") >= C.DROP_AMOUNT) | (F.col("percent") >= C.CARD_DROP_PERCENT))


# ------------------------------------------------------------ lookups by id

_IDS = r"SELECT product_id, trim(regexp_replace(lower(concat(replace(brand, '#', ''), '-', CAST(product_id AS VARCHAR), '-', title)), '[\s_/]+', '-', 'g'), '-') AS id FROM products"


def _ids(spark, d):
    whole = F.concat_ws("-", F.replace("brand", F.lit("#"), F.lit("")), F.col("product_id").cast("string"), "title")
    return view(spark, d, "products").select("product_id", U.normal_id(whole).alias("id"))


@query(
    "detail_match",
    f"""WITH i AS ({_IDS}), p AS (SELECT product_id, id, split_part(id, '-', 1) AS prefix, split_part(id, '-', 2) AS code FROM i),
w AS (SELECT id AS wanted FROM i WHERE product_id <= 50 UNION ALL SELECT concat(split_part(id, '-', 1), '-', split_part(id, '-', 2), '-otro') FROM i WHERE product_id <= 50
  UNION ALL SELECT * FROM (VALUES ('brand32-gigabyte'), ('brand13'), ('nadie-3')) v(x)),
q AS (SELECT DISTINCT wanted, split_part(wanted, '-', 1) AS prefix, CASE WHEN regexp_matches(split_part(wanted, '-', 2), '^[0-9]+$') THEN split_part(wanted, '-', 2) END AS code FROM w),
r AS (SELECT wanted, product_id, CASE WHEN p.id = wanted THEN 0 WHEN p.code = q.code THEN 1 WHEN contains(p.id, wanted) THEN 2 END AS place FROM q JOIN p USING (prefix))
SELECT wanted, arg_min(product_id, (place, product_id)) AS product_id FROM r WHERE place IS NOT NULL GROUP BY wanted""",
)
def detail_match(spark, d):
    """Requested id to product: the exact id, else its prefix and code, else its prefix and a part of the id."""
    ids = _ids(spark, d)
    products = ids.select("product_id", "id", D.prefix_of(F.col("id")).alias("prefix"), D.code_of(F.col("id")).alias("code"))
    few = products.filter("product_id <= 50")
    other = spark.createDataFrame([("brand32-gigabyte",), ("brand13",), ("nadie-3",)], "wanted string")
    wanted = few.select(F.col("id").alias("wanted")).union(few.select(F.concat_ws("-", "prefix", "code", F.lit("otro")))).union(other).distinct()
    wanted = wanted.select("wanted", D.prefix_of(F.col("wanted")).alias("prefix"), D.code_of(F.col("wanted")).alias("w_code"))
    place = F.when(F.col("id") == F.col("wanted"), 0).when(F.col("code") == F.col("w_code"), 1).when(F.contains("id", "wanted"), 2)
    found = wanted.join(products, "prefix").withColumn("place", place).filter("place is not null")
    return found.groupBy("wanted").agg(F.min_by("product_id", F.struct("place", "product_id")).alias("product_id"))


@query(
    "detail_queries",
    rf"""SELECT product_id, trim(regexp_replace(regexp_replace(array_to_string(list_filter(string_split(id, '-'), lambda x: x <> '')[3:], ' '), '[^a-zA-Z0-9+\s]', ' ', 'g'), '\s+', ' ', 'g')) AS words FROM ({_IDS})""",
)
def detail_queries(spark, d):
    return _ids(spark, d).select("product_id", D.detail_query(F.col("id")).alias("words"))


@query(
    "comparison_slots",
    """WITH g AS (SELECT * FROM (VALUES (1, 'rtx 3060'), (2, 'ryzen 5'), (3, 'no such thing')) v(slot, term))
SELECT slot::BIGINT AS slot, arg_min(product_id, (CASE WHEN name LIKE 'g%' THEN 0 ELSE 1 END, product_id)) AS product_id FROM g JOIN products ON contains(lower(title), term) GROUP BY slot""",
)
def comparison_slots(spark, d):
    """First product of each slot's term, grouped products before others; one scan, the few terms as a fixed list."""
    terms = [(1, "rtx 3060"), (2, "ryzen 5"), (3, "no such thing")]
    hits = F.array_compact(F.array(*(F.when(F.contains(F.lower("title"), F.lit(t)), F.lit(slot).cast("long")) for slot, t in terms)))
    found = view(spark, d, "products").select("product_id", F.col("name").startswith("g").alias("grouped"), F.explode(hits).alias("slot"))
    return found.groupBy("slot").agg(F.min_by("product_id", F.struct(~F.col("grouped"), "product_id")).alias("product_id"))


# ------------------------------------------------------------ product pages


@query(
    "best_instalments",
    """WITH i AS (SELECT product_id, line AS count, price, stock = 'unknown' AS interest, order_id FROM offers)
SELECT product_id, count::BIGINT AS count, CAST(floor(price / count + 0.5) AS BIGINT) AS amount, interest FROM i
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY interest, count, price, order_id) = 1""",
)
def best_instalments(spark, d):
    """Without interest first, then the fewest payments: one aggregate per product."""
    row = F.struct((F.col("stock") == "unknown").alias("interest"), F.col("line").cast("long").alias("count"), "price", "order_id")
    least = view(spark, d, "offers").groupBy("product_id").agg(F.min(row).alias("r")).select("product_id", "r.*")
    return least.select("product_id", "count", P.half_up(F.col("price") / F.col("count")).alias("amount"), "interest")


_LINKS = "SELECT product_id, price, concat(CASE WHEN is_active THEN 'https' ELSE 'ftp' END, '://shop.example/', CAST(store_id AS VARCHAR)) AS url FROM offers JOIN stores USING (store_id)"


@query(
    "description_links",
    f"""WITH l AS ({_LINKS}), u AS (SELECT product_id, url, min(price) AS price FROM l WHERE url LIKE 'http%' GROUP BY product_id, url)
SELECT product_id, url, row_number() OVER (PARTITION BY product_id ORDER BY price, url) AS place FROM u QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price, url) <= 2""",
)
def description_links(spark, d):
    """The two cheapest distinct web addresses of each product."""
    joined = view(spark, d, "offers").join(view(spark, d, "stores"), "store_id")
    url = F.concat(F.when(F.col("is_active"), "https").otherwise("ftp"), F.lit("://shop.example/"), F.col("store_id").cast("string"))
    links = joined.withColumn("url", url).filter(F.col("url").rlike("(?i)^https?://")).groupBy("product_id", "url").agg(F.min("price").alias("price"))
    place = F.row_number().over(Window.partitionBy("product_id").orderBy("price", "url")).cast("long")
    return links.select("product_id", "url", place.alias("place")).filter("place <= 2")


_BRAND = "CASE " + " ".join(f"WHEN contains(upper(title), '{w}') THEN '{s}'" for w, s in C.NAME_BRANDS) + " END"


@query("known_brands", f"SELECT product_id, {_BRAND} AS brand, coalesce({_BRAND}, 'Generica') AS shown FROM products")
def known_brands(spark, d):
    brand = D.known_brand(F.col("title"))
    return view(spark, d, "products").select("product_id", brand.alias("brand"), F.coalesce(brand, F.lit(C.DEFAULT_BRAND)).alias("shown"))


@query(
    "short_titles",
    rf"""WITH b AS (SELECT product_id, coalesce({_BRAND}, '') AS brand, title FROM products),
m AS (SELECT product_id, brand, CASE WHEN brand = '' THEN title ELSE regexp_replace(title, concat('(?i)\b', brand, '\b'), '', 'g') END AS model FROM b),
s AS (SELECT product_id, trim(regexp_replace(concat(brand, ' ', model), '\s+', ' ', 'g')) AS t FROM m)
SELECT product_id, CASE WHEN length(t) <= 46 THEN t ELSE concat(regexp_replace(substr(t, 1, 46), '\s+\S*$', ''), '…') END AS title FROM s""",
)
def short_titles(spark, d):
    brand = F.coalesce(D.known_brand(F.col("title")), F.lit(""))
    return view(spark, d, "products").select("product_id", D.short_title(brand, F.col("title"), F.col("title")).alias("title"))


@query(
    "product_json",
    f"""WITH {_STATS}, s AS (SELECT product_id, max(CASE stock WHEN 'in-stock' THEN 3 WHEN 'low-stock' THEN 2 WHEN 'out-of-stock' THEN 0 ELSE 1 END) AS k FROM offers GROUP BY product_id)
SELECT product_id, to_json({{'@type': 'Product', 'name': title, 'offers': {{'@type': 'AggregateOffer', 'lowPrice': lowest, 'highPrice': highest, 'offerCount': n_comparable,
  'availability': CASE WHEN k >= 2 THEN 'https://schema.org/InStock' WHEN k = 0 THEN 'https://schema.org/OutOfStock' ELSE 'https://schema.org/LimitedAvailability' END}}}})::VARCHAR AS json
FROM products JOIN stats USING (product_id) JOIN s USING (product_id) WHERE lowest > 0""",
)
def product_json(spark, d):
    """Structured data of a product and its offers, of the best stock of any offer."""
    names = F.array(*map(F.lit, ("out-of-stock", "unknown", "low-stock", "in-stock")))
    place = F.greatest(F.array_position(names, F.col("stock")), F.lit(1))
    stock = view(spark, d, "offers").groupBy("product_id").agg(F.element_at(names, F.max(place).cast("int")).alias("stock"))
    joined = view(spark, d, "products").select("product_id", "title").join(stats(spark, d), "product_id").join(stock, "product_id").filter("lowest > 0")
    offer = F.struct(
        F.lit("AggregateOffer").alias("@type"), F.col("lowest").alias("lowPrice"), F.col("highest").alias("highPrice"), F.col("n_comparable").alias("offerCount"),
        D.availability(F.col("stock")).alias("availability"),
    )
    return joined.select("product_id", F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("title").alias("name"), offer.alias("offers"))).alias("json"))


@query(
    "meta_descriptions",
    f"""WITH {_STATS}, t AS (SELECT product_id, concat('Compara ', title, ' en ', CAST(n_comparable AS VARCHAR), ' tiendas de Argentina.') AS c,
  concat('$ ', replace(format('{{:,}}', lowest), ',', '.')) AS p FROM products JOIN stats USING (product_id)),
k AS (SELECT product_id, p, CASE WHEN length(c) <= 120 THEN c ELSE concat(regexp_replace(substr(c, 1, 120), '\\s+\\S*$', ''), '…') END AS c FROM t)
SELECT product_id, CASE WHEN length(concat(c, ' Mejor precio detectado: ', p, '.')) <= 160 THEN concat(c, ' Mejor precio detectado: ', p, '.') ELSE c END AS text FROM k""",
)
def meta_descriptions(spark, d):
    joined = view(spark, d, "products").select("product_id", "title").join(stats(spark, d), "product_id")
    return joined.select("product_id", D.meta_text(F.col("title"), F.col("n_comparable"), P.format_price(F.col("lowest"))).alias("text"))


@query(
    "image_links",
    """WITH r AS (SELECT page_id, trim(CASE WHEN page_id IS NULL THEN '' ELSE regexp_extract(html, '<a href="([^"]*)"', 1) END) AS raw FROM pages)
SELECT page_id, CASE WHEN regexp_matches(raw, '^(?i)https?://') THEN raw WHEN raw LIKE '/%' THEN concat('https://shop.example', raw) ELSE 'https://shop.example/og.png' END AS image FROM r""",
)
def image_links(spark, d):
    found = F.regexp_extract("html", '<a href="([^"]*)"', 1)
    return raw(spark, d, "pages").select("page_id", D.image_link(found, "https://shop.example", "https://shop.example/og.png").alias("image"))


@query("pc_builds", "SELECT product_id FROM products WHERE " + " OR ".join(f"contains(lower(title), '{t}')" for t in C.PC_BUILD_TERMS))
def pc_builds(spark, d):
    return view(spark, d, "products").filter(D.is_pc_build(F.col("title"))).select("product_id")


@query("latest_sync", "SELECT product_id, max(updated) AS updated FROM offers WHERE price > 0 GROUP BY product_id")
def latest_sync(spark, d):
    return view(spark, d, "offers").filter("price > 0").groupBy("product_id").agg(F.max("updated").alias("updated"))


# ------------------------------------------------------------ lists


@query(
    "categories_list",
    """WITH c AS (SELECT DISTINCT hw_category AS id FROM products), f AS (SELECT unnest(['procesadores', 'gabinetes']) AS id)
SELECT id FROM c UNION ALL SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM c)""",
)
def categories_list(spark, d):
    """Categories by name; a fixed list only where the table has none, decided inside the plan."""
    known = view(spark, d, "products").select(F.col("hw_category").alias("id")).distinct()
    fixed = spark.createDataFrame([("procesadores",), ("gabinetes",)], "id string")
    any_known = known.limit(1).select(F.lit(True).alias("any"))
    return known.unionByName(fixed.join(F.broadcast(any_known), how="left_anti")).orderBy("id")


@query(
    "category_list",
    f"""WITH {_STATS} SELECT product_id, title, lowest FROM products JOIN stats USING (product_id) WHERE hw_category = 'motherboards' AND title ILIKE '%aorus%' ORDER BY lowest, product_id LIMIT 240""",
)
def category_list(spark, d):
    """A category's products that hold a phrase, cheapest first."""
    chosen = R.phrase_filter(view(spark, d, "products").filter("hw_category = 'motherboards'"), "aorus", ["title"])
    return chosen.join(stats(spark, d), "product_id").orderBy("lowest", "product_id").limit(C.READ_LIMIT).select("product_id", "title", "lowest")


@query(
    "unhealthy_products",
    """WITH o AS (SELECT product_id, count(*) AS n, min(price) AS p FROM offers GROUP BY product_id), z AS (SELECT product_id FROM products WHERE hw_category = 'motherboards' AND product_id NOT IN (SELECT product_id FROM o)
  UNION SELECT product_id FROM o WHERE n < 3) SELECT product_id FROM z""",
)
def unhealthy_products(spark, d):
    """Two flagged lists as one, distinct by id."""
    counted = view(spark, d, "offers").groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    none = view(spark, d, "products").filter("hw_category = 'motherboards'").select("product_id").join(counted, "product_id", "left_anti")
    return none.union(counted.filter("n < 3").select("product_id")).distinct()


@query(
    "indexable_products",
    """WITH n AS (SELECT product_id, count(DISTINCT store_id) AS stores FROM offers WHERE price > 0 GROUP BY product_id),
w AS (SELECT product_id FROM products JOIN n USING (product_id) QUALIFY row_number() OVER (PARTITION BY hw_category, title ORDER BY stores DESC, product_id) = 1)
SELECT product_id, stores >= 2 AND product_id IN (SELECT product_id FROM w) AS is_indexable FROM n""",
)
def indexable_products(spark, d):
    """A product is indexed if it stands for its canonical key and two stores or more offer it."""
    stores = view(spark, d, "offers").filter("price > 0").groupBy("product_id").agg(F.count_distinct("store_id").alias("stores"))
    named = view(spark, d, "products").select("product_id", "title", "hw_category", F.lit("").alias("brand"), F.lit("").alias("model"), F.col("title").alias("name"))
    grouped = resolve.with_keys(named).select("product_id", "canonical_key").join(stores, "product_id")
    winners = grouped.groupBy("canonical_key").agg(F.max_by("product_id", F.struct("stores", -F.col("product_id"))).alias("product_id"))
    flagged = stores.join(winners.select("product_id", F.lit(True).alias("first")), "product_id", "left")
    return flagged.select("product_id", ((F.col("stores") >= 2) & F.coalesce("first", F.lit(False))).alias("is_indexable"))


_ALL = "concat_ws(' ', title, brand, hw_category)"
_COVERED = " + ".join(f"({normal(_ALL)} LIKE '%{w}%')::INT" for w in ("mouse", "logitech", "perifericos"))


@query("token_coverage", f"SELECT product_id FROM products WHERE {_COVERED} >= 3")
def token_coverage(spark, d):
    """Words of a query over several fields together."""
    return view(spark, d, "products").filter(R.covers_query(F.concat_ws(" ", "title", "brand", "hw_category"), "mouse logitech perifericos")).select("product_id")


# ------------------------------------------------------------ corrections of stored rows


@query(
    "signature_times",
    """WITH o AS (SELECT product_id, store_id, min(price) AS price, max(updated) AS updated FROM offers WHERE updated < TIMESTAMP '1999-01-01' GROUP BY ALL),
n AS (SELECT product_id, store_id, min(price) AS price, max(updated) AS updated FROM offers WHERE updated >= TIMESTAMP '1997-01-01' GROUP BY ALL)
SELECT n.product_id, n.store_id, CASE WHEN o.price IS NOT DISTINCT FROM n.price THEN o.updated ELSE n.updated END AS updated FROM n LEFT JOIN o ON o.product_id = n.product_id AND o.store_id = n.store_id""",
)
def signature_times(spark, d):
    """A write keeps the stored time where the signature did not change."""
    offers = view(spark, d, "offers")
    one = lambda condition: offers.filter(condition).groupBy("product_id", "store_id").agg(F.min("price").alias("price"), F.max("updated").alias("updated"))
    old = one("updated < timestamp '1999-01-01'").withColumnsRenamed({"price": "o_price", "updated": "o_updated"})
    joined = one("updated >= timestamp '1997-01-01'").join(old, ["product_id", "store_id"], "left")
    kept = F.when(F.col("o_price").eqNullSafe(F.col("price")), F.col("o_updated")).otherwise(F.col("updated"))
    return joined.select("product_id", "store_id", kept.alias("updated"))


@query(
    "conflict_ignore",
    """WITH known AS (SELECT user_id, 'kept' AS origin FROM users WHERE segment = 'BUILDING'), new AS (SELECT DISTINCT user_id, 'new' AS origin FROM favourites)
SELECT * FROM known UNION ALL SELECT * FROM new WHERE user_id NOT IN (SELECT user_id FROM known)""",
)
def conflict_ignore(spark, d):
    """Insert from a select; rows whose key is there already are left as they are."""
    known = view(spark, d, "users").filter("segment = 'BUILDING'").select("user_id", F.lit("kept").alias("origin"))
    new = view(spark, d, "favourites").select("user_id").distinct().withColumn("origin", F.lit("new"))
    return known.unionByName(new.join(known, "user_id", "left_anti"))


_PERIPHERAL = rf"regexp_matches(t, '(?i)({C.PERIPHERAL_NAMES})') AND NOT regexp_matches(t, '(?i)({C.COMPONENT_NAMES})')"


@query(
    "reclassified_products",
    f"""WITH p AS (SELECT product_id, CASE WHEN hw_category = 'perifericos' THEN 'procesadores' ELSE hw_category END AS c, title AS t FROM products)
SELECT product_id, CASE WHEN c IN ('tarjetas-graficas', 'procesadores') AND {_PERIPHERAL} THEN 'perifericos' ELSE c END AS category FROM p""",
)
def reclassified_products(spark, d):
    filed = F.when(F.col("hw_category") == "perifericos", "procesadores").otherwise(F.col("hw_category"))
    return view(spark, d, "products").select("product_id", D.reclassified(filed, F.col("title")).alias("category"))


@query("backfilled_products", "SELECT product_id, coalesce(CASE WHEN retail > 100000 THEN title END, name) AS normalized_title, coalesce(CASE WHEN hw_category <> 'perifericos' THEN brand END, 'Generica') AS brand FROM products")
def backfilled_products(spark, d):
    title, brand = F.when(F.col("retail") > 100_000, F.col("title")), F.when(F.col("hw_category") != "perifericos", F.col("brand"))
    return view(spark, d, "products").select("product_id", F.coalesce(title, "name").alias("normalized_title"), F.coalesce(brand, F.lit(C.DEFAULT_BRAND)).alias("brand"))


# ------------------------------------------------------------ small rules of feeds


@query(
    "feed_prices",
    """SELECT product_id, retail + 1 AS plain, retail AS local, retail + 1 AS direct, retail AS digits, retail AS number FROM products""",
)
def feed_prices(spark, d):
    """Price texts of several feeds read by their parsers: plain decimals, local notation, direct numbers, digits."""
    text, local = F.col("retail").cast("string"), P.format_price(F.col("retail"))
    return view(spark, d, "products").select(
        "product_id",
        D.plain_decimal_price(F.concat(F.lit(" "), text, F.lit(".5 "))).alias("plain"),
        D.plain_decimal_price(local).alias("local"),
        D.direct_or_digits_price(F.concat(text, F.lit(",5"))).alias("direct"),
        D.direct_or_digits_price(local).alias("digits"),
        D.price_of_number_or_text(F.when(F.col("retail") % 2 == 0, F.col("retail").cast("double")), local).alias("number"),
    )


@query(
    "scrape_states",
    """SELECT event_id, CASE WHEN status = 'no-results' THEN 'no-results' WHEN latency >= 8000 THEN 'slow' ELSE 'ok' END AS state,
  CASE WHEN status IN ('blocked', 'error') THEN 'error' WHEN status IN ('slow', 'no-results') THEN 'warning' ELSE 'info' END AS level, status IN ('ok', 'slow', 'no-results') AS success FROM requests""",
)
def scrape_states(spark, d):
    results = F.when(F.col("status") == "no-results", 0).otherwise(1)
    success = F.col("status").isin("ok", "slow", "no-results")
    return view(spark, d, "requests").select("event_id", D.scrape_status(results, F.col("latency")).alias("state"), D.log_level(F.col("status")).alias("level"), success.alias("success"))


@query("refresh_totals", "SELECT endpoint, count(*) FILTER (WHERE status IN ('ok', 'slow')) AS ok, count(*) FILTER (WHERE status NOT IN ('ok', 'slow')) AS failed FROM requests GROUP BY endpoint")
def refresh_totals(spark, d):
    good = F.col("status").isin("ok", "slow")
    return view(spark, d, "requests").groupBy("endpoint").agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"))


@query("fallback_rates", f"SELECT hw_category, floor(100.0 * count(*) FILTER (WHERE {_BRAND} IS NULL) / greatest(count(*), 1) * 10 + 0.5) / 10 AS rate FROM products GROUP BY hw_category")
def fallback_rates(spark, d):
    """Share of products whose brand had to fall back, in percent with one decimal."""
    share = 100.0 * F.count_if(D.known_brand(F.col("title")).isNull()) / F.greatest(F.count(F.lit(1)), F.lit(1))
    return view(spark, d, "products").groupBy("hw_category").agg((F.floor(share * 10 + 0.5) / 10).alias("rate"))


@query("valid_events", "SELECT event_id, endpoint FROM requests WHERE status <> 'error' AND endpoint IN ('click', 'view', 'purchase')")
def valid_events(spark, d):
    """Events as JSON; those that lack a time, or name no monitored endpoint, are dropped."""
    finished = F.when(F.col("status") != "error", F.unix_millis("ts"))
    text = view(spark, d, "requests").select(F.to_json(F.struct("event_id", "endpoint", finished.alias("finished"))).alias("j"))
    read = text.select(F.from_json("j", "event_id long, endpoint string, finished long").alias("e")).select("e.*")
    return read.filter(F.col("finished").isNotNull() & F.col("endpoint").isin("click", "view", "purchase")).select("event_id", "endpoint")


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM requests")
def iso_times(spark, d):
    return view(spark, d, "requests").select("event_id", D.iso_time(F.timestamp_millis(F.unix_millis("ts"))).alias("iso"))


@query("parsed_times", "SELECT event_id, CASE WHEN status = 'error' THEN (SELECT max(ts) FROM requests) ELSE date_trunc('second', ts) END AS ts FROM requests")
def parsed_times(spark, d):
    """Times from texts; what is no time reads as the present."""
    events = view(spark, d, "requests")
    as_of = F.broadcast(events.agg(F.max("ts").alias("as_of")))
    text = F.when(F.col("status") == "error", F.lit("no time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return events.join(as_of).select("event_id", F.coalesce(F.try_to_timestamp(text), "as_of").alias("ts"))


@query("history_days", "SELECT order_id, line, date_diff('day', updated, (SELECT max(updated) FROM offers)) AS days FROM offers")
def history_days(spark, d):
    offers = view(spark, d, "offers")
    as_of = F.broadcast(offers.agg(F.max("updated").alias("as_of")))
    return offers.join(as_of).select("order_id", "line", F.expr("extract(day from (as_of - updated))").cast("long").alias("days"))


@query("plain_texts", r"SELECT product_id, trim(regexp_replace(lower(translate(title, '" + C.ACCENTED + "', '" + C.PLAIN + r"')), '\s+', ' ', 'g')) AS text FROM products")
def plain_texts(spark, d):
    """Lower case without accents; punctuation stays."""
    return view(spark, d, "products").select("product_id", T.collapse(F.lower(T.strip_accents(F.col("title")))).alias("text"))


@query("shown_counts", "SELECT concat(upper(left(hw_category, 1)), substr(hw_category, 2)) AS category, concat(CAST(count(*) AS VARCHAR), CASE WHEN count(*) = 1 THEN ' producto' ELSE ' productos' END) AS shown FROM products GROUP BY hw_category")
def shown_counts(spark, d):
    name = F.concat(F.upper(F.left("hw_category", F.lit(1))), F.substring("hw_category", 2, 1 << 20))
    counted = view(spark, d, "products").groupBy("hw_category").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(name.alias("category"), F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " producto").otherwise(" productos")).alias("shown"))
