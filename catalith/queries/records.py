"""Validated inputs, codes and specs, log lines, page texts, keys of titles, edges of the catalogue read."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import records as R
from ..operators import offers as O
from ..plans import content, search, snapshot
from ..operators.resolve import per_distinct
from ..registry import query
from ..sources.tables import raw, view
from .products import _groups, _keyed
from .reading import normal

_MODES = ("machinery", "building", "furniture")


@query(
    "validated_inputs",
    f"""SELECT c_custkey AS id, CASE WHEN lower(c_mktsegment) IN {_MODES} THEN lower(c_mktsegment) END AS mode,
  CASE c_nationkey % 3 WHEN 0 THEN 'procesadores,gabinetes' WHEN 1 THEN '' ELSE 'motherboards' END AS categories,
  CASE WHEN c_nationkey % 5 = 0 THEN 40 WHEN c_nationkey % 5 = 1 THEN 1 ELSE CAST(least(200, greatest(1, floor(c_acctbal))) AS INT) END AS number,
  c_nationkey % 3 <> 1 OR c_acctbal > 0 AS intent FROM customer""",
)
def validated_inputs(spark, d):
    """Modes, categories and numbers of requests as they are taken, and whether a request asks for anything."""
    rows, nation = raw(spark, d, "customer"), F.col("c_nationkey")
    listed = F.when(nation % 3 == 0, " procesadores ,nada,,gabinetes,procesadores").when(nation % 3 == 1, F.lit(None).cast("string")).otherwise("motherboards,")
    number = F.when(nation % 5 == 0, "many").when(nation % 5 == 1, " ").otherwise(F.col("c_acctbal").cast("string"))
    none = F.lit(None).cast("long")
    return rows.select(
        F.col("c_custkey").alias("id"), R.allowed(F.lower("c_mktsegment"), _MODES).alias("mode"), F.array_join(R.categories(listed), ",").alias("categories"),
        R.integer_between(number, 40, 1, 200).alias("number"),
        R.has_intent(F.lit("  "), F.get(R.categories(listed), F.lit(0)), F.when(F.col("c_acctbal") > 0, F.lit(1)), none, F.lit(None).cast("array<string>")).alias("intent"),
    )


@query(
    "safe_paths",
    """SELECT page_id, CASE page_id % 5 WHEN 1 THEN concat('/', split_part(url, '/', 4)) WHEN 4 THEN concat('/home/', CAST(page_id AS VARCHAR), '?a=1+2') ELSE '/' END AS path FROM pages""",
)
def safe_paths(spark, d):
    """Where each address would lead: other sites and the sign-in's own path lead home."""
    n, part = F.col("page_id") % 5, F.split_part("url", F.lit("/"), F.lit(4))
    given = F.when(n == 0, F.col("url")).when(n == 1, F.concat(F.lit("/"), part)).when(n == 2, F.lit("//other.example/x")).when(n == 3, F.lit("%2Fauth%2Fcallback%3Fnext=1"))
    given = given.otherwise(F.concat(F.lit("%252Fhome%252F"), F.col("page_id").cast("string"), F.lit("?a=1+2")))
    return raw(spark, d, "pages").select("page_id", R.safe_path(given).alias("path"))


_LABEL = "CASE WHEN p_size <= 20 THEN 'sin stock' WHEN p_size <= 30 THEN 'stock bajo' WHEN p_size <= 40 THEN 'en stock' END"


@query(
    "spec_maps",
    f"""WITH s AS (SELECT p_partkey AS id, p_name, CASE WHEN p_size % 3 > 0 THEN CAST(p_partkey AS VARCHAR) END AS sku, CASE WHEN p_size % 4 > 0 THEN p_size % 4 * 6 END AS months, p_size - 10 AS n, {_LABEL} AS label FROM part)
SELECT id, concat_ws('|', 'SKU=' || sku, 'Garantia=' || CAST(months AS VARCHAR) || ' meses', CASE WHEN n >= 0 THEN 'Stock=' || CAST(n AS VARCHAR) END, 'Disponibilidad=' || label) AS specs,
  CASE WHEN sku IS NULL AND months IS NULL AND label IS NULL THEN p_name ELSE 'Ficha Tienda: ' || concat_ws(' | ', 'SKU ' || sku, 'Garantia ' || CAST(months AS VARCHAR) || ' meses', 'Disponibilidad ' || label) END AS line FROM s""",
)
def spec_maps(spark, d):
    """Specs and description line of a feed's items: codes with and without their mark, warranties, counts, stock."""
    part, size = raw(spark, d, "part"), F.col("p_size")
    codes = F.when(size % 3 > 0, F.array(F.lit(" SKU : "), F.lit(None).cast("string"), F.concat(F.lit("sku:"), F.col("p_partkey").cast("string")))).otherwise(F.array(F.lit("  ")))
    months, count = size % 4 * 6, size - 10
    stock = F.when(size <= 20, "out-of-stock").when(size <= 30, "low-stock").when(size <= 40, "in-stock").otherwise("unknown")
    specs = R.spec_map(codes, months, count, stock)
    return part.select(
        F.col("p_partkey").alias("id"), F.array_join(F.transform(F.map_entries(specs), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("specs"),
        R.spec_line(F.col("p_name"), codes, months, stock, "Tienda").alias("line"),
    )


@query(
    "history_points",
    "SELECT o_custkey AS customer, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS TIMESTAMP) END AS date, o_totalprice AS price, o_orderpriority AS store_id FROM orders",
)
def history_points(spark, d):
    """Recorded prices per customer as points; dates that cannot be read are none."""
    date = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("string")).otherwise("someday")
    rows = raw(spark, d, "orders").select("o_custkey", F.array(F.struct(date.alias("date"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("store_id"))).alias("p"))
    return rows.select(F.col("o_custkey").alias("customer"), F.explode(R.history_points(F.col("p"))).alias("x")).select("customer", "x.*")


@query(
    "log_messages",
    """SELECT event_id, concat('Tienda ', CAST(source AS VARCHAR), ' -> ', upper(status), ' (', CAST(latency AS VARCHAR), ' resultados)') AS store_message,
  concat(endpoint, ' -> ', CASE WHEN status = 'error' THEN '500' ELSE '200' END, ' (', CAST(latency AS VARCHAR), ' items)', CASE WHEN status = 'slow' THEN ' slow' ELSE '' END) AS endpoint_message FROM requests""",
)
def log_messages(spark, d):
    code, note = F.when(F.col("status") == "error", 500).otherwise(200), F.when(F.col("status") == "slow", "slow")
    return view(spark, d, "requests").select(
        "event_id", R.store_message(F.concat(F.lit("Tienda "), F.col("source").cast("string")), F.col("status"), F.col("latency")).alias("store_message"),
        R.endpoint_message(F.col("endpoint"), code, F.col("latency"), note).alias("endpoint_message"),
    )


_IN = " UNION ALL ".join(
    f"SELECT product_id, '{c}' AS category FROM products WHERE " + " OR ".join(f"{normal('title')} LIKE '%{t}%'" for t in terms) for c, terms in C.COMPONENT_TERMS.items()
)


@query("category_terms", _IN)
def category_terms(spark, d):
    """The categories whose terms a product's title has."""
    products = view(spark, d, "products").select("product_id", "title")
    hits = F.array(*(F.when(R.in_category(F.col("title"), F.lit(None).cast("string"), c), F.lit(c)) for c in C.COMPONENT_TERMS))
    told = per_distinct(products, ["title"], lambda titles: titles.withColumn("hits", F.array_compact(hits)))
    return told.select("product_id", F.explode("hits").alias("category"))


@query("touched_rows", "SELECT store_id, store_name, TIMESTAMP '2026-01-01 00:00:00' AS updated_at FROM stores WHERE is_active")
def touched_rows(spark, d):
    active = view(spark, d, "stores").filter("is_active").select("store_id", "store_name", F.lit("1999-01-01").cast("timestamp").alias("updated_at"))
    return R.touched(active, F.lit("2026-01-01").cast("timestamp"))


_SLUGS = f"trim(regexp_replace({normal('{0}')}, '[^a-z0-9]+', '-', 'g'), '-')"
_FIXED = ", ".join(f"('{p}', '{f}', {r})" for p, f, r in [*C.PUBLIC_PAGES, *((f"/search?category={c}", "hourly", 0.8) for c in C.CATEGORIES)])


@query(
    "public_sitemap",
    f"""WITH p AS (SELECT * FROM (VALUES {_FIXED}) v(path, frequency, priority)
  UNION ALL SELECT DISTINCT concat('/comparativa/', {_SLUGS.format("title")}), 'daily', 0.85 FROM products UNION ALL SELECT DISTINCT concat('/guia/', {_SLUGS.format("brand")}), 'daily', 0.85 FROM products)
SELECT concat('https://shop.example', path) AS url, frequency, CAST(priority AS DOUBLE) AS priority FROM p""",
)
def public_sitemap(spark, d):
    products = view(spark, d, "products")
    return content.public_sitemap("https://shop.example", products.select(F.col("title").alias("name")), products.select(F.col("brand").alias("name")))


_DOTS = "replace(format('{{:,}}', CAST({0} AS BIGINT)), ',', '.')"
_LINES = f"""b AS (SELECT product_id, store_id, min(price) AS price FROM offers WHERE price > 0 AND stock <> 'out-of-stock' GROUP BY ALL),
f AS (SELECT product_id, count(*) AS n, min(price) AS low, array_to_string(list_slice(list(concat('- ', CAST(store_id AS VARCHAR), ': $', {_DOTS.format("price")}) ORDER BY price, store_id), 1, 5), chr(10)) AS lines FROM b GROUP BY product_id)"""


@query(
    "comparison_texts",
    f"""WITH {_LINES}, t AS (SELECT x.product_id AS slug, x.title AS a, y.title AS b, g.low AS la, h.low AS lb, g.n AS na, h.n AS nb, g.lines AS xa, h.lines AS xb, greatest(g.low, h.low) AS m
  FROM products x JOIN products y ON y.product_id = x.product_id + 6 LEFT JOIN f g ON g.product_id = x.product_id LEFT JOIN f h ON h.product_id = y.product_id)
SELECT slug, CASE WHEN la IS NULL OR lb IS NULL THEN concat('## ', a, ' vs ', b, chr(10), 'Estamos actualizando los precios.') ELSE concat_ws(chr(10), concat('## ', a, ' vs ', b), concat('| Característica | ', a, ' | ', b, ' |'),
  concat('| **Mejor Precio** | $', {_DOTS.format("la")}, ' | $', {_DOTS.format("lb")}, ' |'), concat('| **Tiendas** | ', CAST(na AS VARCHAR), ' disponibles | ', CAST(nb AS VARCHAR), ' disponibles |'),
  concat('| **Ahorro** | Hasta ', CAST(CAST(floor((1 - la / m) * 100 + 0.5) AS BIGINT) AS VARCHAR), '% | Hasta ', CAST(CAST(floor((1 - lb / m) * 100 + 0.5) AS BIGINT) AS VARCHAR), '% |'),
  concat('**Elegí ', a, ' si:** ', CASE WHEN la < lb THEN concat('Querés ahorrar $', {_DOTS.format("lb - la")}) ELSE 'Preferís esta marca' END),
  concat('**Elegí ', b, ' si:** ', CASE WHEN lb < la THEN concat('Querés ahorrar $', {_DOTS.format("la - lb")}) ELSE 'Preferís esta marca' END, '; buscás ', CASE WHEN nb > na THEN 'más opciones de tiendas' ELSE 'otras características' END),
  concat('**', a, ':**'), xa, concat('**', b, ':**'), xb) END AS text FROM t""",
)
def comparison_texts(spark, d):
    """Every product compared with the next one of its kind."""
    products = view(spark, d, "products").select("product_id", F.col("title").alias("name"))
    offers = view(spark, d, "offers").filter("price > 0 AND stock <> 'out-of-stock'").groupBy("product_id", "store_id").agg(F.min("price").alias("price"))
    other = products.select((F.col("product_id") - 6).alias("product_id"), F.col("product_id").alias("product_id_b"), F.col("name").alias("other"))
    pairs = products.join(other, "product_id").select(F.col("product_id").alias("slug"), F.concat_ws(" vs ", "name", "other").alias("title"), F.col("product_id").alias("product_id_a"), "product_id_b")
    return content.comparison_texts(pairs, products, offers)


@query(
    "budget_lines",
    f"""WITH {_LINES}, u AS (SELECT product_id, max(updated) AS updated FROM offers GROUP BY product_id)
SELECT product_id, concat('- **', title, '**: Desde $', {_DOTS.format("low")}, ' (', CAST(n AS VARCHAR), ' tiendas)') AS line FROM products JOIN f USING (product_id) JOIN u USING (product_id) ORDER BY updated DESC, product_id LIMIT 6""",
)
def budget_lines(spark, d):
    offers = view(spark, d, "offers")
    updated = offers.groupBy("product_id").agg(F.max("updated").alias("updated"))
    own = offers.filter("price > 0 AND stock <> 'out-of-stock'").groupBy("product_id", "store_id").agg(F.min("price").alias("price"))
    return content.budget_lines(view(spark, d, "products").select("product_id", F.col("title").alias("name")).join(updated, "product_id"), own)


_T = normal("title")
_KEY = f"""CASE WHEN title LIKE 'Combo%' THEN concat('bundle:', {_SLUGS.format("bundle")})
  WHEN title LIKE 'Micro%' THEN concat('cpu:ryzen', replace(regexp_extract({_T}, 'ryzen ([0-9] [0-9]+x?)', 1), ' ', ''))
  WHEN title LIKE 'Placa%' THEN concat_ws(':', 'gpu', replace(regexp_extract({_T}, 'rtx [0-9]+( ti)?'), ' ', ''), '8gb', regexp_extract({_T}, 'msi|asus|zotac'), regexp_extract({_T}, 'shadow|dual'))
  WHEN title LIKE 'Motherboard%' THEN concat_ws(':', 'mb:gigabyte', regexp_extract({_T}, 'b[0-9]+m'), 'am5', regexp_extract({_T}, 'aorus|ds3h'), CASE WHEN {_T} LIKE '%wifi%' THEN 'wifi' ELSE 'nowifi' END)
  WHEN title LIKE 'Mouse%' THEN concat('generic:logitech:mouse:', regexp_extract({_T}, 'g[0-9]+'), CASE WHEN {_T} LIKE '%hero%' THEN concat('-', regexp_extract({_T}, 'g[0-9]+'), '-hero') ELSE '' END)
  ELSE concat('generic:na:other:', regexp_extract({_T}, '[0-9]+gb'), '-ddr4') END"""
_FAMILY = f"""CASE WHEN title LIKE 'Combo%' THEN NULL WHEN title LIKE 'Micro%' THEN concat('cpu-family:ryzen', replace(regexp_extract({_T}, 'ryzen ([0-9] [0-9]+)', 1), ' ', '-'))
  WHEN title LIKE 'Placa%' THEN concat('gpu-family:', replace(regexp_extract({_T}, 'rtx [0-9]+( ti)?'), ' ', '')) WHEN title LIKE 'Motherboard%' THEN concat_ws(':', 'mb-family:gigabyte', regexp_extract({_T}, 'b[0-9]+m'), 'am5')
  WHEN title LIKE 'Mouse%' THEN concat('generic-family:logitech:mouse:', regexp_extract({_T}, 'g[0-9]+')) ELSE concat('generic-family:na:other:', regexp_extract({_T}, '[0-9]+gb'), '-ddr4') END"""


@query(
    "catalogue_metadata",
    f"""WITH l AS (SELECT product_id, max(updated) AS scraped, count(*) AS n, bool_or(stock IN ('in-stock', 'low-stock')) AS a FROM offers GROUP BY product_id),
t AS (SELECT DISTINCT product_id FROM favourites JOIN users USING (user_id) WHERE segment = 'MACHINERY'), b AS (SELECT *, title AS bundle FROM products)
SELECT b.product_id, concat(hw_category, '::', {_KEY}) AS canonical_key, {_FAMILY} AS family_key, l.scraped AS last_scraped,
  CASE WHEN t.product_id IS NOT NULL THEN 'tracked' WHEN NOT coalesce(a, FALSE) THEN 'cold' WHEN n >= 3 THEN 'hot' ELSE 'normal' END AS refresh_priority
FROM b LEFT JOIN l USING (product_id) LEFT JOIN t ON t.product_id = b.product_id WHERE title NOT LIKE 'Combo%'""",
)
def catalogue_metadata(spark, d):
    """What is stored beside every product that is no bundle: keys, refresh priority, when it was last seen."""
    products, _ = _keyed(spark, d)
    offers = view(spark, d, "offers")
    chosen = view(spark, d, "users").filter("segment = 'MACHINERY'").select("user_id")
    tracked = view(spark, d, "favourites").join(chosen, "user_id").select("product_id").distinct()
    every = view(spark, d, "products").select("product_id", "title")
    seen = offers.groupBy("product_id").agg(F.max("updated").alias("last_scraped"))
    priority = snapshot.refresh_priority(every, offers, tracked).withColumnRenamed("priority", "refresh_priority")
    keys = products.select("product_id", "canonical_key", "family_key")
    return priority.join(keys, "product_id").join(seen, "product_id", "left").join(every.filter("title NOT LIKE 'Combo%'"), "product_id", "left_semi").select("product_id", "canonical_key", "family_key", "last_scraped", "refresh_priority")


_READ = "seq IN (SELECT seq FROM c WHERE name ILIKE '%rtx 30%' ORDER BY updated DESC, product_id LIMIT 40)"


@query("catalogue_read", f"{_groups(_READ)} SELECT product_id, name, lowest, n_offers FROM groups WHERE name NOT LIKE 'Combo%' AND lowest > 0 ORDER BY lowest, seq LIMIT 40")
def catalogue_read(spark, d):
    """The newest 40 rows with the phrase, then groups, filters and sort: older rows take no part in groups."""
    found = search.catalogue_read(*_keyed(spark, d), search.SearchParams(query="RTX 30", sort="price-asc", limit=40))
    return found.select("product_id", "name", "lowest", "n_offers")


_PAGE = "seq IN (SELECT seq FROM c ORDER BY updated DESC, product_id LIMIT 48 OFFSET 48)"


@query("catalogue_page_groups", f"{_groups(_PAGE)} SELECT product_id, name, lowest, n_offers, (SELECT count(*) FROM c) AS total, CAST(ceil((SELECT count(*) FROM c) / 48.0) AS BIGINT) AS total_pages, CAST(2 AS BIGINT) AS page FROM groups")
def catalogue_page_groups(spark, d):
    """The second page of 48 rows: its groups are fewer, its total counts rows."""
    return search.catalogue_page(*_keyed(spark, d), 2, 48)


_STABLE = "seq IN (SELECT seq FROM c WHERE hw_category = 'procesadores' ORDER BY updated DESC, product_id LIMIT 250)"
_FIXTURES = "SELECT product_id, title AS name, hw_category, retail AS lowest FROM products QUALIFY row_number() OVER (PARTITION BY title ORDER BY product_id) = 1"


def _stable(spark, d, params):
    products, offers = _keyed(spark, d)
    spare = view(spark, d, "products").groupBy("title").agg(F.min_by(F.struct("product_id", "hw_category", "retail"), "product_id").alias("p"))
    fixtures = spare.select("p.product_id", F.col("title").alias("name"), "p.hw_category", F.col("p.retail").alias("lowest"))
    return search.stable_search(products, offers, fixtures, params)


@query("stable_search", f"{_groups(_STABLE)} SELECT product_id, name, lowest, FALSE AS fallback FROM groups WHERE name LIKE '%Ryzen%' AND name LIKE '%AM4%' AND name NOT LIKE 'Combo%' AND lowest >= 60000")
def stable_search(spark, d):
    """Stored products of the inferred category that have all words."""
    return _stable(spark, d, search.SearchParams(query="am4 ryzen", category="procesadores", lowest=60_000))


@query(
    "stable_fallback",
    f"""{_groups("hw_category = 'perifericos'").replace("AS average FROM k JOIN z USING (key) GROUP BY key)", "AS average FROM k JOIN z USING (key) GROUP BY key), x AS (" + _FIXTURES + ")")}
SELECT product_id, name, lowest, TRUE AS fallback FROM x WHERE hw_category = 'perifericos' AND name LIKE '%Logitech%' AND lowest <= 3 * (SELECT avg(retail) FROM products) AND NOT EXISTS (SELECT 1 FROM groups WHERE lowest > 900000000)""",
)
def stable_fallback(spark, d):
    """Where no stored product has the words within the price, fixtures that have them."""
    most = int(3 * view(spark, d, "products").agg(F.avg("retail")).first()[0])
    products, offers = _keyed(spark, d)
    dear = offers.withColumn("price", F.lit(2_000_000_000).cast("long"))
    spare = view(spark, d, "products").groupBy("title").agg(F.min_by(F.struct("product_id", "hw_category", "retail"), "product_id").alias("p"))
    fixtures = spare.select("p.product_id", F.col("title").alias("name"), "p.hw_category", F.col("p.retail").alias("lowest"))
    return search.stable_search(products, dear, fixtures, search.SearchParams(query="logitech", category="perifericos", highest=most))
