"""Price history: retention, drops, change capture, featured products, sitemaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as C
from .. import storage
from ..functions import price as P
from ..operators import offers as O
from ..operators import ordered, resolve
from ..plans import home, refresh, retention, sitemap, snapshot, stored
from ..registry import query
from ..sources.tables import raw, view

_RETAINED = """WITH a AS (SELECT max(ts) AS as_of FROM requests),
r AS (SELECT event_id, source, ts, as_of,
  row_number() OVER (PARTITION BY source, endpoint, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS h,
  row_number() OVER (PARTITION BY source, endpoint, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) AS d FROM requests, a),
k AS (SELECT event_id, CASE WHEN ts >= as_of - INTERVAL 5 DAY THEN 'raw' WHEN ts >= as_of - INTERVAL 15 DAY THEN CASE WHEN h = 1 THEN 'hourly' ELSE 'thinned' END
  WHEN ts >= as_of - INTERVAL 25 DAY THEN CASE WHEN d = 1 THEN 'daily' ELSE 'thinned' END ELSE 'purged' END AS kind FROM r)"""


def _classified(spark, d):
    rows = view(spark, d, "requests").withColumnsRenamed({"ts": "recorded", "event_id": "id"})
    as_of = rows.agg(F.max("recorded").alias("as_of"))
    return retention.classify(rows, ["source", "endpoint"], as_of, raw_days=5, hourly_days=15, daily_days=25)


@query("history_retention", f"{_RETAINED} SELECT event_id FROM k WHERE kind IN ('raw', 'hourly', 'daily')")
def history_retention(spark, d):
    return retention.keep(_classified(spark, d)).select(F.col("id").alias("event_id"))


@query("retention_counts", f"{_RETAINED} SELECT kind, count(*) AS n FROM k GROUP BY kind")
def retention_counts(spark, d):
    return _classified(spark, d).groupBy(F.col("retention").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_CURRENT = """cur AS (SELECT product_id, store_id, price, updated FROM offers
  QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY price, updated DESC, order_id, line, original) = 1)"""
_BASE = f"""{_CURRENT}, pairs AS (SELECT cur.product_id, cur.store_id, cur.price, o.price AS base, o.updated AS recorded,
  CASE WHEN o.updated < cur.updated - INTERVAL 1 SECOND THEN 1 ELSE 0 END AS older FROM cur JOIN offers o ON o.product_id = cur.product_id AND o.store_id = cur.store_id AND o.price > cur.price),
based AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY older DESC, recorded DESC, base DESC) = 1),
dropped AS (SELECT product_id, store_id, price, base, base - price AS amount, (base - price) / base AS percent FROM based WHERE base - price >= 10000 OR (base - price) / base >= 0.05
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY (base - price) / base DESC, base - price DESC, store_id) = 1)"""


def _current(spark, d):
    """The cheapest offer per product and store, of equal ones the newest; aggregated before the shuffle."""
    offers = view(spark, d, "offers")
    order = F.struct("price", -F.unix_micros("updated"), "order_id", "line", "original")
    best = offers.groupBy("product_id", "store_id").agg(F.min_by(F.struct("price", "updated"), order).alias("b"))
    return best.select("product_id", "store_id", "b.price", "b.updated")


def _based(spark, d):
    return O.baseline(_current(spark, d), view(spark, d, "offers").withColumnRenamed("updated", "recorded"))


@query("current_prices", f"WITH {_CURRENT} SELECT product_id, store_id, price, updated FROM cur")
def current_prices(spark, d):
    return _current(spark, d)


@query("price_drop_baseline", f"WITH {_BASE} SELECT product_id, store_id, price, base, recorded FROM based")
def price_drop_baseline(spark, d):
    return _based(spark, d).select("product_id", "store_id", "price", "base", "recorded")


@query("best_drops", f"WITH {_BASE} SELECT product_id, store_id, amount FROM dropped")
def best_drops(spark, d):
    return O.drops(_based(spark, d)).select("product_id", "store_id", "amount")


@query("drop_ranking", f"WITH {_BASE} SELECT product_id, amount FROM dropped ORDER BY percent DESC, amount DESC, product_id LIMIT 8")
def drop_ranking(spark, d):
    found = O.drops(_based(spark, d))
    return found.orderBy(F.col("percent").desc(), F.col("amount").desc(), "product_id").limit(C.DROP_LIMIT).select("product_id", "amount")


@query("recent_history", "SELECT order_id, line, price FROM offers WHERE updated >= (SELECT max(updated) FROM offers) - INTERVAL 30 DAY ORDER BY updated DESC, order_id, line, price LIMIT 5000")
def recent_history(spark, d):
    offers = view(spark, d, "offers")
    as_of = offers.agg(F.max("updated").alias("as_of"))
    recent = offers.join(F.broadcast(as_of)).filter(F.col("updated") >= F.col("as_of") - F.expr("INTERVAL 30 DAY"))
    return recent.orderBy(F.col("updated").desc(), "order_id", "line", "price").limit(5000).select("order_id", "line", "price")


_LATEST = "l AS (SELECT product_id, min(price) AS lowest, max(updated) AS updated, count(DISTINCT store_id) AS stores, bool_or(stock IN ('in-stock', 'low-stock')) AS available FROM offers GROUP BY product_id)"
_JOINED = f"{_LATEST}, p AS (SELECT product_id, hw_category, lowest, updated, stores, available FROM products JOIN l USING (product_id))"
_FEATURED = f"""{_JOINED}, e AS (SELECT * FROM p WHERE available),
w AS (SELECT product_id, updated, 0 AS grp FROM e QUALIFY row_number() OVER (PARTITION BY hw_category ORDER BY lowest, updated DESC, product_id) = 1),
f AS (SELECT product_id, updated, 1 AS grp FROM e WHERE product_id NOT IN (SELECT product_id FROM w))"""


def _facts(spark, d):
    offers = view(spark, d, "offers").groupBy("product_id").agg(
        F.min("price").alias("lowest"), F.max("updated").alias("updated"), F.count_distinct("store_id").alias("stores"),
        F.bool_or(F.col("stock").isin("in-stock", "low-stock")).alias("available"),
    )
    return view(spark, d, "products").select("product_id", "hw_category").join(offers, "product_id")


@query("featured_products", f"WITH {_FEATURED} SELECT product_id FROM (SELECT * FROM w UNION ALL SELECT * FROM f) ORDER BY grp, updated DESC, product_id LIMIT 8")
def featured_products(spark, d):
    return home.featured(_facts(spark, d)).select("product_id")


@query("fallback_products", f"WITH {_JOINED} SELECT product_id FROM p WHERE available OR NOT (SELECT bool_or(available) FROM p) ORDER BY updated DESC, stores DESC, lowest, product_id LIMIT 8")
def fallback_products(spark, d):
    return home.fallback(_facts(spark, d)).select("product_id")


_SEEN = "products JOIN (SELECT product_id, max(updated) AS updated FROM offers GROUP BY product_id HAVING count(DISTINCT store_id) >= 2) USING (product_id)"


@query("sitemap_winners", f"SELECT product_id FROM {_SEEN} QUALIFY row_number() OVER (PARTITION BY hw_category, title ORDER BY updated DESC, product_id) = 1")
def sitemap_winners(spark, d):
    """One product per canonical key, the newest; these titles have a key each."""
    seen = view(spark, d, "offers").groupBy("product_id").agg(F.max("updated").alias("updated"), F.count_distinct("store_id").alias("n")).filter("n >= 2")
    named = view(spark, d, "products").select("product_id", "title", "hw_category", F.lit("").alias("brand"), F.lit("").alias("model"), F.col("title").alias("name"))
    keyed = resolve.with_keys(named).select("product_id", "canonical_key").join(seen, "product_id")
    return resolve.winners(keyed.select("product_id", "canonical_key", "updated")).select("product_id")


@query("sitemap_pages", "SELECT product_id, CAST(floor((row_number() OVER (ORDER BY product_id) - 1) / 500) AS BIGINT) AS page FROM products")
def sitemap_pages(spark, d):
    return sitemap.paged(view(spark, d, "products").select("product_id"), "product_id", 500)


@query("sitemap_entries", """SELECT product_id, concat('<url><loc>https://shop.example/p/', replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '</loc></url>') AS xml FROM products""")
def sitemap_entries(spark, d):
    return view(spark, d, "products").select("product_id", sitemap.entry(F.concat(F.lit("https://shop.example/p/"), F.col("title"))).alias("xml"))


# ------------------------------------------------------------ change capture

_STATES = """WITH o AS (SELECT product_id, store_id, min(price) AS price FROM offers WHERE updated < TIMESTAMP '1999-01-01' GROUP BY ALL), n AS (SELECT product_id, store_id, min(price) AS price FROM offers WHERE updated >= TIMESTAMP '1997-01-01' GROUP BY ALL),
j AS (SELECT n.product_id, n.store_id, n.price, CASE WHEN o.product_id IS NULL THEN 'new' WHEN o.price IS NOT DISTINCT FROM n.price THEN 'same' ELSE 'changed' END AS change FROM n LEFT JOIN o ON n.product_id = o.product_id AND n.store_id = o.store_id)"""


def _snapshots(spark, d):
    offers = view(spark, d, "offers")
    one = lambda condition: offers.filter(condition).groupBy("product_id", "store_id").agg(F.min("price").alias("price"))
    return one("updated < timestamp '1999-01-01'"), one("updated >= timestamp '1997-01-01'")


@query("cdc_change_flags", f"{_STATES} SELECT product_id, store_id, price, change FROM j")
def cdc_change_flags(spark, d):
    old, new = _snapshots(spark, d)
    return O.stored_state(new, old, ["product_id", "store_id"], "price").select("product_id", "store_id", "price", "change")


@query("cdc_history_rows", f"{_STATES} SELECT product_id, store_id, price FROM j WHERE change <> 'same'")
def cdc_history_rows(spark, d):
    old, new = _snapshots(spark, d)
    return snapshot.history_rows(O.stored_state(new, old, ["product_id", "store_id"], "price")).select("product_id", "store_id", "price")


@query(
    "cdc_upsert",
    f"{_STATES} SELECT product_id, store_id, price FROM n UNION ALL SELECT product_id, store_id, price FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.product_id = o.product_id AND n.store_id = o.store_id)",
)
def cdc_upsert(spark, d):
    old, new = _snapshots(spark, d)
    return snapshot.upsert(old, new, ["product_id", "store_id"])


@query(
    "refresh_priority",
    """WITH t AS (SELECT DISTINCT product_id FROM favourites JOIN users USING (user_id) WHERE segment = 'MACHINERY'), f AS (SELECT product_id, count(*) AS n, bool_or(stock IN ('in-stock', 'low-stock')) AS a FROM offers GROUP BY product_id)
SELECT products.product_id, CASE WHEN t.product_id IS NOT NULL THEN 'tracked' WHEN NOT coalesce(a, FALSE) THEN 'cold' WHEN n >= 3 THEN 'hot' ELSE 'normal' END AS priority
FROM products LEFT JOIN f USING (product_id) LEFT JOIN t ON t.product_id = products.product_id""",
)
def refresh_priority(spark, d):
    chosen = view(spark, d, "users").filter("segment = 'MACHINERY'").select("user_id")
    tracked = view(spark, d, "favourites").join(chosen, "user_id").select("product_id").distinct()
    return snapshot.refresh_priority(view(spark, d, "products").select("product_id"), view(spark, d, "offers"), tracked)


@query(
    "hot_targets",
    """WITH l AS (SELECT product_id, max(updated) AS updated FROM offers GROUP BY product_id)
SELECT product_id, updated FROM l WHERE updated < (SELECT max(updated) FROM l) - INTERVAL 180 MINUTE ORDER BY updated, product_id LIMIT 50""",
)
def hot_targets(spark, d):
    latest = view(spark, d, "offers").groupBy("product_id").agg(F.max("updated").alias("updated"))
    as_of = view(spark, d, "offers").agg(F.max("updated").alias("as_of"))
    return snapshot.hot_targets(latest, as_of, minutes=180, limit=50)


@query("normalisation_lookup", "SELECT p_partkey AS product_id, coalesce(upper(o.n), p_name) AS title FROM part LEFT JOIN (SELECT DISTINCT p_name AS raw, reverse(p_name) AS n FROM part WHERE p_size <= 25) o ON o.raw = p_name")
def normalisation_lookup(spark, d):
    part = raw(spark, d, "part")
    known = part.filter("p_size <= 25").select(F.col("p_name").alias("raw"), F.reverse("p_name").alias("n")).distinct()
    joined = part.join(known, F.col("p_name") == F.col("raw"), "left")
    return joined.select(F.col("p_partkey").alias("product_id"), F.coalesce(F.upper("n"), "p_name").alias("title"))


@query(
    "profile_upsert",
    """SELECT user_id, coalesce(nullif(trim(CASE WHEN segment = 'FURNITURE' THEN '  ' ELSE user_name END), ''), split_part(concat(lower(segment), '@mail.example'), '@', 1)) AS display_name FROM users""",
)
def profile_upsert(spark, d):
    given = F.when(F.col("segment") == "FURNITURE", F.lit("  ")).otherwise(F.col("user_name"))
    email = F.concat(F.lower("segment"), F.lit("@mail.example"))
    name = F.coalesce(F.nullif(F.trim(given), F.lit("")), F.split_part(email, F.lit("@"), F.lit(1)))
    return view(spark, d, "users").select("user_id", name.alias("display_name"))


@query(
    "guide_components",
    """WITH g AS (SELECT * FROM (VALUES (1, 'cpu', 'ryzen', 250000), (2, 'gpu', 'rtx 3060', 400000), (3, 'board', 'b550', 150000), (4, 'case', 'gabinete', 90000)) v(slot, part, term, estimate)),
m AS (SELECT slot, part, estimate, product_id, retail FROM g LEFT JOIN products ON lower(title) LIKE concat('%', term, '%') QUALIFY row_number() OVER (PARTITION BY slot ORDER BY product_id) = 1)
SELECT slot::BIGINT AS slot, part, coalesce(nullif(retail, 0), estimate)::BIGINT AS price FROM m""",
)
def guide_components(spark, d):
    rows = [(1, "cpu", "ryzen", 250000), (2, "gpu", "rtx 3060", 400000), (3, "board", "b550", 150000), (4, "case", "gabinete", 90000)]
    guide = spark.createDataFrame(rows, "slot long, part string, term string, estimate long")
    return home.guide_prices(view(spark, d, "products"), guide).select("slot", "part", "price")


@query(
    "related_products",
    """WITH k AS (SELECT product_id, brand, hw_category, retail FROM products),
r AS (SELECT product_id, brand, hw_category, lead(product_id) OVER w AS related FROM k WINDOW w AS (PARTITION BY brand, hw_category ORDER BY retail, product_id))
SELECT product_id, related FROM r WHERE related IS NOT NULL""",
)
def related_products(spark, d):
    """The next dearer product of the same brand and category."""
    products = view(spark, d, "products").select("brand", "hw_category", "retail", "product_id")
    following = ordered.with_next(products, ["brand", "hw_category"], ["retail", "product_id"], "product_id", "related")
    return following.select("product_id", "related").filter("related IS NOT NULL")


@query("estimate_total", "SELECT hw_category, CAST(sum(coalesce(nullif(retail, 0), 1000)) AS BIGINT) AS total, CAST(floor(sum(retail) / count(*) + 0.5) AS BIGINT) AS mean FROM products GROUP BY hw_category")
def estimate_total(spark, d):
    priced = F.coalesce(F.nullif("retail", F.lit(0)), F.lit(1000))
    return view(spark, d, "products").groupBy("hw_category").agg(F.sum(priced).alias("total"), P.half_up(F.sum("retail") / F.count(F.lit(1))).alias("mean"))


_REFRESH = f"""WITH u AS (SELECT product_id, max(updated) AS updated, count(*) AS n, bool_or(stock IN ('in-stock', 'low-stock')) AS a FROM offers GROUP BY product_id),
t AS (SELECT DISTINCT product_id FROM favourites JOIN users USING (user_id) WHERE segment = 'MACHINERY'),
p AS (SELECT product_id, title AS name, hw_category AS category, updated, t.product_id IS NOT NULL AS tracked, t.product_id IS NOT NULL OR (coalesce(a, FALSE) AND n >= 3) AS hot
  FROM products LEFT JOIN u USING (product_id) LEFT JOIN t USING (product_id)),
top AS (SELECT 'tracked' AS mode, name, category, NULL AS updated, row_number() OVER (ORDER BY product_id) AS rank FROM p WHERE tracked
  UNION ALL SELECT 'hot', name, category, updated, row_number() OVER (ORDER BY updated, product_id) FROM p WHERE hot),
r AS (SELECT c_custkey AS request_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'full' WHEN 'BUILDING' THEN 'custom' WHEN 'FURNITURE' THEN 'tracked' WHEN 'HOUSEHOLD' THEN 'hot' ELSE 'cleanup-history' END AS mode,
  CASE WHEN c_nationkey < 12 THEN c_name ELSE '  ' END AS query, CASE c_nationkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['procesadores', 'gabinetes', 'procesadores'] ELSE ['nada', 'motherboards'] END AS cats,
  1 + c_nationkey AS budget, (SELECT max(updated) FROM offers) - to_minutes(CAST(180 + 1440 * 400 * (c_nationkey % 4) AS INT)) AS cutoff, CASE WHEN c_acctbal < 0 THEN 'service_client_unavailable' END AS reason FROM customer),
l AS (SELECT request_id, budget, rank, name, category, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS k FROM r JOIN top USING (mode)
  WHERE reason IS NULL AND rank <= greatest(2 * budget, {C.LEAST_LOOKED_AT}) AND (mode <> 'hot' OR updated < cutoff)),
d AS (SELECT request_id, CAST(min(k) - 1 AS INT) AS place, 'query' AS kind, arg_min(name, k) AS value, arg_min(category, k) AS category FROM l WHERE k <= budget GROUP BY request_id, category, lower(name)),
c AS (SELECT request_id, unnest(CASE WHEN len(own) > 0 THEN own ELSE {list(C.CATEGORIES)} END) AS value, unnest(range(CASE WHEN len(own) > 0 THEN len(own) ELSE {len(C.CATEGORIES)} END)) AS place
  FROM (SELECT *, list_filter([cats[1], cats[2]], lambda x: list_contains({list(C.CATEGORIES)}, x)) AS own FROM r) WHERE mode = 'full' OR (mode = 'custom' AND trim(query) = '') OR (mode IN ('tracked', 'hot') AND reason IS NOT NULL))"""


def _refresh(spark, d):
    offers = view(spark, d, "offers")
    chosen = view(spark, d, "users").filter("segment = 'MACHINERY'").select("user_id")
    tracked = view(spark, d, "favourites").join(chosen, "user_id").select("product_id").distinct()
    products = view(spark, d, "products").select("product_id", F.col("title").alias("name"), F.col("hw_category").alias("category"))
    kinds = snapshot.refresh_priority(products.select("product_id"), offers, tracked).filter("priority IN ('hot', 'tracked')").select("product_id")
    updated = offers.groupBy("product_id").agg(F.max("updated").alias("updated"))
    hot = products.join(kinds, "product_id").join(updated, "product_id", "left")
    as_of = offers.agg(F.max("updated")).first()[0]
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    mode = F.when(segment == "AUTOMOBILE", "full").when(segment == "BUILDING", "custom").when(segment == "FURNITURE", "tracked").when(segment == "HOUSEHOLD", "hot").otherwise("cleanup-history")
    some = F.when(nation % 3 == 0, F.array().cast("array<string>")).when(nation % 3 == 1, F.array(F.lit("procesadores"), F.lit("gabinetes"), F.lit("procesadores"))).otherwise(F.array(F.lit("nada"), F.lit("motherboards")))
    requests = raw(spark, d, "customer").select(
        F.col("c_custkey").alias("request_id"), mode.alias("mode"), F.when(nation < 12, F.col("c_name")).otherwise("  ").alias("query"), some.alias("categories"), (nation + 1).alias("max_queries"),
        (180 + 1440 * 400 * (nation % 4)).alias("stale_minutes"), F.when(F.col("c_acctbal") < 0, "service_client_unavailable").alias("reason"),
    )
    return refresh.refresh_plan(requests, products.join(tracked, "product_id"), hot, F.lit(as_of))


@query(
    "refresh_plans",
    f"""{_REFRESH}, n AS (SELECT request_id, count(*) AS n FROM (SELECT request_id FROM d UNION ALL SELECT request_id FROM c) GROUP BY request_id)
SELECT request_id, CASE WHEN mode = 'cleanup-history' THEN mode WHEN mode = 'full' THEN 'full-categories' WHEN mode = 'custom' THEN CASE WHEN trim(query) <> '' THEN 'custom-query' ELSE 'custom-categories' END
    WHEN reason IS NOT NULL THEN concat(mode, '-fallback-categories') WHEN n.n IS NULL THEN concat(mode, '-idle') ELSE concat(mode, '-db') END AS source,
  mode IN ('tracked', 'hot') AND reason IS NOT NULL AS fallback_applied, CASE WHEN mode IN ('tracked', 'hot') THEN reason END AS fallback_reason,
  CASE WHEN mode = 'custom' AND trim(query) <> '' THEN 1 ELSE coalesce(n.n, 0) END AS n_targets FROM r LEFT JOIN n USING (request_id)""",
)
def refresh_plans(spark, d):
    """A refresh request per customer: modes by segment, budgets and staleness by nation, some without a source."""
    return _refresh(spark, d)[0]


@query(
    "refresh_targets",
    f"""{_REFRESH} SELECT request_id, place, kind, value, category FROM d UNION ALL SELECT request_id, CAST(place AS INT), 'category', value, value FROM c
UNION ALL SELECT request_id, 0, 'query', query, cats[1] FROM r WHERE mode = 'custom' AND trim(query) <> ''""",
)
def refresh_targets(spark, d):
    return _refresh(spark, d)[1]


@query(
    "stored_upsert",
    f"{_STATES} SELECT product_id, store_id, price, 0 AS again FROM n UNION ALL SELECT product_id, store_id, price, 0 FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.product_id = o.product_id AND n.store_id = o.store_id)",
)
def stored_upsert(spark, d):
    """A stored table after an upsert, and how many rows the same upsert changes a second time."""
    old, new = _snapshots(spark, d)
    path = storage.folder(spark, "stored")
    stored.create(old, path, ["product_id", "store_id"])
    stored.upsert(spark, path, new, ["product_id", "store_id"])
    again = stored.upsert(spark, path, new, ["product_id", "store_id"])
    return stored.read(spark, path).withColumn("again", F.lit(again))


@query(
    "stored_profiles",
    """SELECT user_id, CASE WHEN segment = 'FURNITURE' THEN 'old name' WHEN segment = 'MACHINERY' THEN user_name ELSE coalesce(nullif(user_name, ''), 'old name') END AS display_name FROM users
UNION ALL SELECT s_suppkey + 1000000000, 'old name' FROM supplier""",
)
def stored_profiles(spark, d):
    """Profiles kept in place: a blank name leaves the stored one, unknown users are added, others stay."""
    users = view(spark, d, "users")
    path, name = storage.folder(spark, "profiles"), F.lit("old name").alias("display_name")
    known = users.filter("segment <> 'MACHINERY'").select("user_id", name).unionByName(raw(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("user_id"), name))
    stored.create(known, path, ["user_id"])
    given = users.select("user_id", F.when(F.col("segment") == "FURNITURE", "  ").otherwise(F.col("user_name")).alias("display_name"))
    stored.upsert(spark, path, given, ["user_id"], combine={"display_name": lambda new, old: F.coalesce(F.nullif(F.trim(new), F.lit("")), old)})
    return stored.read(spark, path)
