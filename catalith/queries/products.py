"""Entity resolution and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import offers as O
from ..operators import resolve
from ..plans import live, search
from ..registry import query
from ..sources import feeds
from ..sources.tables import raw, view
from ..storage import materialise
from .reading import normal

#: The latest offer of each product and store, as one price per store is stored.
_PRICES = """SELECT product_id, store_id, price, stock, updated FROM offers WHERE price > 0
  QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY updated DESC, order_id DESC, line DESC, price DESC, stock DESC) = 1"""
_CATALOGUE = f"""o AS MATERIALIZED ({_PRICES}),
c AS MATERIALIZED (SELECT product_id AS seq, product_id, title AS name, hw_category, CASE WHEN product_id % 2 = 0 THEN '{C.DEFAULT_IMAGE}' ELSE concat('/', CAST(product_id AS VARCHAR), '.png') END AS image,
  (SELECT min(updated) FROM o WHERE o.product_id = products.product_id) AS created, (SELECT max(updated) FROM o WHERE o.product_id = products.product_id) AS updated FROM products WHERE product_id IN (SELECT product_id FROM o))"""
#: A product's offers as a list, cheapest first.
_LIST = "SELECT product_id AS seq, list({'s': store_id, 'p': price, 'k': stock, 'u': updated} ORDER BY price, store_id) AS own FROM o GROUP BY product_id"


def _comparable(x: str) -> str:
    """SQL: the offers of a list that compare, by the outlier rule."""
    v = f"list_sort(list_transform({x}, lambda e: e.p))"
    return f"""(SELECT CASE WHEN len(w.x) < 2 THEN w.x
  WHEN len(w.x) = 2 THEN CASE WHEN w.v[2] / greatest(w.v[1], 1) >= {C.PAIR_RATIO} AND w.v[2] - w.v[1] >= {C.PAIR_MIN_DELTA} THEN list_filter(w.x, lambda e: e.p = w.v[1]) ELSE w.x END
  ELSE CASE WHEN len(w.y) = 0 THEN w.x ELSE w.y END END
  FROM (SELECT q.x, q.v, list_filter(q.x, lambda e: NOT ((e.p / q.m >= {C.UPPER_RATIO} AND e.p - q.m >= q.l) OR (e.p / q.m <= {C.LOWER_RATIO} AND q.m - e.p >= q.l))) AS y
    FROM (SELECT r.*, greatest({C.MIN_DELTA}, floor(r.m * {C.RELATIVE_DELTA} + 0.5)) AS l FROM (SELECT {x} AS x, {v} AS v, list_aggregate({x}.list_transform(lambda e: CAST(e.p AS DOUBLE)), 'median') AS m) r) q) w)"""


def _merged(a: str, b: str, newer: bool) -> str:
    """SQL: one list of offers merged over another, store by store."""
    better = "nw.p < ol.p OR (ol.k = 'out-of-stock' AND nw.k <> 'out-of-stock')" + (" OR nw.u > ol.u" if newer else "")
    takes = f"list_filter({b}, lambda nw: nw.s = ol.s AND ({better}))"
    return f"list_concat(list_transform({a}, lambda ol: coalesce({takes}[1], ol)), list_filter({b}, lambda nw: NOT list_contains(list_transform({a}, lambda ol: ol.s), nw.s)))"


def catalogue(spark, d):
    """(products, offers) as the resolver takes them."""
    offers = view(spark, d, "offers").filter("price > 0")
    best = F.max(F.struct("updated", "order_id", "line", "price", "stock")).alias("b")
    offers = materialise(offers.groupBy("product_id", "store_id").agg(best).select(F.col("product_id").alias("seq"), F.col("store_id").alias("place"), "store_id", "b.price", "b.stock", "b.updated"))
    times = offers.groupBy(F.col("seq").alias("product_id")).agg(F.min("updated").alias("created"), F.max("updated").alias("updated"))
    products = view(spark, d, "products").join(times, "product_id")
    image = F.when(F.col("product_id") % 2 == 0, C.DEFAULT_IMAGE).otherwise(F.concat(F.lit("/"), F.col("product_id").cast("string"), F.lit(".png")))
    none = F.lit("")
    return products.select("product_id", F.col("product_id").alias("seq"), F.col("title").alias("name"), "title", "hw_category", none.alias("brand"), none.alias("model"), image.alias("image"), "created", "updated"), offers


def _keyed(spark, d):
    products, offers = catalogue(spark, d)
    return materialise(resolve.with_keys(products)), offers


def _groups(where: str) -> str:
    """SQL: groups of products that have one title, which these titles' keys tell apart exactly."""
    return f"""WITH RECURSIVE {_CATALOGUE}, l AS MATERIALIZED ({_LIST}),
k AS MATERIALIZED (SELECT c.*, l.own, concat(hw_category, '|', name) AS key, row_number() OVER (PARTITION BY hw_category, name ORDER BY c.seq) AS n FROM c JOIN l USING (seq) WHERE {where}),
f AS (SELECT key, n, own AS held FROM k WHERE n = 1
  UNION ALL SELECT g.key, g.n, {_comparable("g.m")} FROM (SELECT k.key, k.n, {_merged("f.held", "k.own", True)} AS m FROM f JOIN k ON k.key = f.key AND k.n = f.n + 1) g),
z AS (SELECT key, CASE WHEN n = 1 THEN {_comparable("held")} ELSE held END AS kept FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1),
groups AS (SELECT min(seq) AS seq, arg_min(product_id, seq) AS product_id, arg_min(name, seq) AS name, coalesce(arg_min(image, seq) FILTER (image <> '{C.DEFAULT_IMAGE}'), arg_min(image, seq)) AS image, min(created) AS created, max(updated) AS updated,
  any_value(len(kept)) AS n_offers, any_value(list_min(list_transform(kept, lambda e: e.p))) AS lowest, any_value(list_max(list_transform(kept, lambda e: e.p))) AS highest,
  CAST(floor(any_value(list_sum(list_transform(kept, lambda e: e.p))) / any_value(len(kept)) + 0.5) AS BIGINT) AS average FROM k JOIN z USING (key) GROUP BY key)"""


@query("entity_groups", f"{_groups('TRUE')} SELECT * EXCLUDE (seq) FROM groups")
def entity_groups(spark, d):
    """Products grouped by canonical key with folded offers."""
    grouped, _ = resolve.group_exact(*_keyed(spark, d), newer_wins=True)
    return grouped.select("product_id", "name", "image", "created", "updated", "n_offers", "lowest", "highest", "average")


@query(
    "search_results",
    f"""{_groups("name LIKE '%RTX%' OR name LIKE '%3060%'")}
SELECT product_id, name, lowest, highest, average FROM groups WHERE name NOT LIKE 'Combo%' AND lowest >= 50000 ORDER BY lowest, seq LIMIT 48""",
)
def search_results(spark, d):
    """The catalogue search: text filter, grouping, component and price filters, sort, page."""
    found = search.catalogue_search(*_keyed(spark, d), search.SearchParams(query="rtx 3060", lowest=50_000, sort="price-asc", limit=48))
    return found.select("product_id", "name", "lowest", "highest", "average")


#: Names that differ a little, and prices in steps, so that products of a chip share offers.
_STEP = 50_000
_NEAR_NAME = """CASE WHEN hw_category <> 'tarjetas-graficas' THEN title WHEN brand LIKE '%1' THEN regexp_replace(title, '(MSI|ASUS|Zotac) ', '') WHEN brand LIKE '%2' THEN concat(title, ' OC') ELSE title END"""
_HIT = """(z.m = me.m OR (z.h = me.h AND coalesce(z.b = me.b, TRUE) AND coalesce(z.g = me.g, TRUE) AND (list_has_all(z.t, me.t) OR list_has_all(me.t, z.t))
  AND list_has_any(list_transform(z.o, lambda e: {'s': e.s, 'p': e.p}), list_transform(me.o, lambda e: {'s': e.s, 'p': e.p}))))"""
_NEAR = f"""WITH RECURSIVE o AS MATERIALIZED (SELECT product_id, store_id, (price // {_STEP} + 1) * {_STEP} AS price, stock, updated FROM ({_PRICES})), l AS MATERIALIZED ({_LIST}),
c AS MATERIALIZED (SELECT product_id AS seq, {_NEAR_NAME} AS name, hw_category AS cat FROM products),
t AS MATERIALIZED (SELECT c.*, own, replace(lower(name), 'ó', 'o') AS text FROM c JOIN l USING (seq)),
f AS MATERIALIZED (SELECT cat, seq, name, {{'i': seq, 'm': CASE WHEN name NOT LIKE '%+%' THEN
    CASE WHEN cat = 'tarjetas-graficas' THEN concat(regexp_extract(text, 'rtx [0-9]+( ti)?'), regexp_extract(text, 'msi|asus|zotac'), CASE WHEN text LIKE '%shadow%' THEN 'shadow' ELSE 'dual' END) ELSE text END END,
  'b': nullif(regexp_extract(text, '(asus|gigabyte|msi|zotac|amd)'), ''), 'h': nullif(replace(regexp_extract(text, 'rtx [0-9]+( ti)?|ryzen [0-9] [0-9]+x?'), ' ', ''), ''), 'g': nullif(regexp_extract(text, '[0-9]+gb'), ''),
  't': list_filter(string_split(text, ' '), lambda x: len(x) > 1 AND x NOT IN ('de', 'placa', 'video', 'micro', 'gamer')), 'o': own}} AS me, row_number() OVER (PARTITION BY cat ORDER BY seq) AS n FROM t),
g(cat, n, cl, asg) USING KEY (cat) AS (SELECT cat, n, [me], [{{'seq': seq, 'cluster': seq}}] FROM f WHERE n = 1
  UNION SELECT y.cat, y.n, CASE WHEN y.hit IS NULL THEN list_append(y.cl, y.me) ELSE list_transform(y.cl, lambda z: CASE WHEN z.i <> y.hit.i THEN z WHEN len(y.me.t) > len(z.t)
      THEN {{'i': z.i, 'm': y.me.m, 'b': y.me.b, 'h': y.me.h, 'g': y.me.g, 't': y.me.t, 'o': y.mo}} ELSE {{'i': z.i, 'm': z.m, 'b': z.b, 'h': z.h, 'g': z.g, 't': z.t, 'o': y.mo}} END) END,
    list_append(y.asg, {{'seq': y.me.i, 'cluster': coalesce(y.hit.i, y.me.i)}})
  FROM (SELECT x.*, CASE WHEN x.hit IS NOT NULL THEN {_comparable("x.raw")} END AS mo FROM (SELECT w.*, {_merged("w.hit.o", "w.me.o", False)} AS raw
    FROM (SELECT g.cat, f.n, g.cl, g.asg, f.me AS me, list_filter(g.cl, lambda z: {_HIT.replace("me.", "f.me.")})[1] AS hit FROM g JOIN f ON f.cat = g.cat AND f.n = g.n + 1) w) x) y),
a AS MATERIALIZED (SELECT u.seq, u.cluster FROM (SELECT unnest(asg) AS u FROM g))"""


def _near(spark, d):
    products, offers = catalogue(spark, d)
    brands = view(spark, d, "products").select("product_id", F.col("brand").alias("b"))
    gpu, name = F.col("hw_category") == "tarjetas-graficas", F.col("name")
    varied = F.when(gpu & F.endswith("b", F.lit("1")), F.regexp_replace(name, "(MSI|ASUS|Zotac) ", "")).when(gpu & F.endswith("b", F.lit("2")), F.concat(name, F.lit(" OC"))).otherwise(name)
    stepped = offers.withColumn("price", (F.expr(f"price div {_STEP}") + 1) * _STEP)
    return materialise(products.join(brands, "product_id").withColumn("name", varied).drop("b")), materialise(stepped)


@query("near_duplicates_merged", f"{_NEAR} SELECT seq, cluster FROM a")
def near_duplicates_merged(spark, d):
    return resolve.cluster_near_duplicates(*_near(spark, d))


@query(
    "merged_products",
    f"""{_NEAR}, last AS (SELECT z.i AS cluster, z.o AS kept FROM (SELECT unnest(cl) AS z FROM g)),
named AS (SELECT a.cluster, arg_min(name, seq) FILTER (k = 1) AS name, count(*) AS n_products FROM (SELECT a.*, f.name, rank() OVER (PARTITION BY a.cluster ORDER BY len(f.me.t) DESC) AS k FROM a JOIN f USING (seq)) a GROUP BY a.cluster)
SELECT cluster, name, n_products, len(kept) AS n_offers, list_min(list_transform(kept, lambda e: e.p)) AS lowest, list_max(list_transform(kept, lambda e: e.p)) AS highest,
  CAST(floor(list_sum(list_transform(kept, lambda e: e.p)) / len(kept) + 0.5) AS BIGINT) AS average FROM named JOIN last USING (cluster)""",
)
def merged_products(spark, d):
    """The product that each cluster of near duplicates becomes."""
    merged, _ = resolve.merge_near_duplicates(*_near(spark, d))
    return merged.select("cluster", "name", "n_products", "n_offers", "lowest", "highest", "average")


_SORTS = ("price-asc", "price-desc", "newest", "relevance")
_QUERY = "'^(Placa de Video|Micro|Motherboard|Mouse|Memoria RAM) '"
_S = "s.words, lambda w: contains(p.text, w)"
_LIVE = f"""WITH RECURSIVE {_CATALOGUE}, l AS MATERIALIZED ({_LIST}),
q AS (SELECT regexp_replace(title, {_QUERY}, '') AS query, min(product_id) AS search_id, min(hw_category) AS kind FROM products WHERE product_id IN (SELECT seq FROM c) GROUP BY 1),
s AS MATERIALIZED (SELECT search_id, CASE WHEN length(query) % 2 = 0 THEN kind END AS category, CASE WHEN length(query) % 3 = 0 THEN 100000 ELSE 0 END AS lowest, CASE WHEN length(query) % 5 = 0 THEN 250000 ELSE 1000000000 END AS highest,
  ['price-asc', 'price-desc', 'newest', 'relevance'][CAST(length(query) % 4 AS INT) + 1] AS sort, {normal("query")} AS text, list_filter(string_split({normal("query")}, ' '), lambda x: len(x) > 1) AS words FROM q),
p AS MATERIALIZED (SELECT x.*, list_min(list_transform(x.cmp, lambda e: e.p)) AS least FROM (SELECT c.*, l.own, {_comparable("l.own")} AS cmp, {normal("c.name")} AS text FROM c JOIN l USING (seq)) x),
k AS MATERIALIZED (SELECT s.search_id, p.seq, p.product_id, p.name, p.updated, p.cmp AS first, p.own, concat(p.hw_category, '|', p.name) AS key,
    len(list_filter({_S})) * {C.SCORE_WORD} + CASE WHEN len(list_filter({_S})) = len(s.words) THEN {C.SCORE_ALL} ELSE 0 END + CASE WHEN contains(p.text, s.text) THEN {C.SCORE_PHRASE} ELSE 0 END
      + CASE WHEN s.category = p.hw_category THEN {C.SCORE_CATEGORY} ELSE 0 END + CASE WHEN p.name LIKE 'Combo%' AND s.text NOT LIKE '%combo%' THEN {C.SCORE_BUNDLE} ELSE 0 END AS score,
    row_number() OVER (PARTITION BY s.search_id, p.hw_category, p.name ORDER BY p.seq) AS n
  FROM s JOIN p ON coalesce(s.category = p.hw_category, TRUE) AND p.least BETWEEN s.lowest AND s.highest
    AND len(list_filter({_S})) >= CASE WHEN len(s.words) <= 2 THEN len(s.words) ELSE CAST(ceil(len(s.words) * 0.7) AS INT) END
    AND len(list_filter(s.words, lambda w: w IN ('dual', 'shadow', 'aorus', 'ds3h', 'hero') AND NOT list_contains(string_split(p.text, ' '), w))) = 0),
f AS (SELECT search_id, key, n, first AS held FROM k WHERE n = 1
  UNION ALL SELECT g.search_id, g.key, g.n, {_comparable("g.m")} FROM (SELECT k.search_id, k.key, k.n, {_merged("f.held", "k.own", False)} AS m FROM f JOIN k ON k.search_id = f.search_id AND k.key = f.key AND k.n = f.n + 1) g),
z AS (SELECT search_id, key, list_transform(held, lambda e: e.p) AS v FROM f QUALIFY row_number() OVER (PARTITION BY search_id, key ORDER BY n DESC) = 1),
r AS (SELECT search_id, key, min(seq) AS seq, arg_min(product_id, seq) AS product_id, any_value(name) AS name, max(updated) AS updated, any_value(score) AS score FROM k GROUP BY ALL),
e AS (SELECT r.*, s.sort, len(v) AS n_offers, list_min(v) AS lowest, list_max(v) AS highest, CAST(floor(list_sum(v) / len(v) + 0.5) AS BIGINT) AS average FROM r JOIN z USING (search_id, key) JOIN s USING (search_id))
SELECT search_id, CAST(row_number() OVER (PARTITION BY search_id ORDER BY CASE sort WHEN 'price-asc' THEN lowest WHEN 'price-desc' THEN -lowest WHEN 'newest' THEN -epoch_us(updated) ELSE CAST(name LIKE 'Combo%' AS BIGINT) END,
    CASE WHEN sort = 'relevance' THEN -(score + greatest(0, {C.SCORE_PRICE} - floor(lowest / {C.PRICE_STEP}))) END, CASE WHEN sort = 'relevance' THEN lowest END, seq) AS INTEGER) AS rank,
  count(*) OVER (PARTITION BY search_id) AS total, product_id, name, lowest, highest, average, n_offers FROM e"""


@query("live_search", _LIVE)
def live_search(spark, d):
    """A search for every title that products have, with filters and sorts of their own, all in one job."""
    products, offers = _keyed(spark, d)
    own = O.mark_outliers(offers.select(F.col("seq").alias("product_id"), "store_id", "price")).filter("NOT discarded")
    products = products.join(own.groupBy("product_id").agg(F.min("price").alias("lowest")), "product_id")
    text = F.regexp_replace("name", _QUERY.strip("'"), "")
    asked = products.groupBy(text.alias("query")).agg(F.min("product_id").alias("search_id"), F.min("hw_category").alias("kind"))
    n = F.length("query")
    sort = F.element_at(F.array(*map(F.lit, _SORTS)), (n % 4 + 1).cast("int"))
    searches = asked.select(
        "search_id", "query", F.when(n % 2 == 0, F.col("kind")).alias("category"), F.when(n % 3 == 0, 100_000).cast("long").alias("lowest"),
        F.when(n % 5 == 0, 250_000).cast("long").alias("highest"), sort.alias("sort"),
    )
    return live.live_search(searches, products, offers)


@query("feed_offers", """SELECT concat('feed-', CAST(p_partkey AS STRING)) AS product_id, CAST(floor(p_retailprice) AS BIGINT) AS price,
  CASE WHEN p_size <= 0 THEN 'out-of-stock' WHEN p_size <= 2 THEN 'low-stock' ELSE 'in-stock' END AS stock, coalesce(p_brand, 'Generica') AS brand FROM part WHERE p_size <> 13 AND p_retailprice >= 1""")
def feed_offers(spark, d):
    """Parts as a JSON feed, parsed and mapped with its dimensions."""
    part = raw(spark, d, "part")
    item = F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("stock"),
        (F.col("p_size") != 13).alias("on_sale"), F.col("p_type").alias("subcategory_id"), F.col("p_brand").alias("brand_id"),
    )
    items = part.select(F.from_json(F.to_json(item), feeds.ITEM).alias("i")).select("i.*")
    brands = part.select(F.col("p_brand").alias("brand_id"), F.col("p_brand").alias("brand")).distinct()
    kinds = part.select(F.col("p_type").alias("subcategory_id"), F.lower("p_type").alias("category")).distinct()
    return feeds.map_items(items, kinds, brands, "feed").select("product_id", "price", "stock", "brand")
