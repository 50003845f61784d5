"""Adapter views: the catalogue's domain tables over the star-schema Parquet files.

The expressions are plain SQL that Spark and other engines read alike; every view is a
projection, so filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Titles of hardware made from a part's key: brand, model, variant and size.
TITLE = """CASE CAST(p_partkey % 6 AS INT)
  WHEN 0 THEN concat('Micro AMD Ryzen ', CAST(3 + 2 * (p_partkey % 4) AS STRING), ' ', CAST(3000 + 100 * (p_partkey % 27) AS STRING), CASE WHEN p_partkey % 4 = 0 THEN 'X' ELSE '' END, ' AM4')
  WHEN 1 THEN concat('Placa de Video ', CASE WHEN p_partkey % 5 = 0 THEN 'MSI' WHEN p_partkey % 5 < 3 THEN 'ASUS' ELSE 'Zotac' END, ' RTX ', CAST(3050 + 10 * (p_partkey % 9) AS STRING), CASE WHEN p_partkey % 4 = 1 THEN ' Ti' ELSE '' END, CASE WHEN p_partkey % 7 = 0 THEN ' Shadow' ELSE ' Dual' END, ' 8GB')
  WHEN 2 THEN concat('Motherboard Gigabyte B', CAST(450 + 100 * (p_partkey % 3) AS STRING), 'M ', CASE WHEN p_partkey % 4 < 2 THEN 'Aorus' ELSE 'DS3H' END, ' AM5', CASE WHEN p_partkey % 5 = 0 THEN ' WiFi' ELSE '' END)
  WHEN 3 THEN concat('Mouse Logitech G', CAST(300 + p_partkey % 40 AS STRING), CASE WHEN p_partkey % 4 = 3 THEN ' Hero' ELSE '' END, ' Óptico RGB')
  WHEN 4 THEN concat('Memoria RAM Kingston DDR4 ', CAST(8 * (1 + p_partkey % 4) AS STRING), 'GB')
  ELSE concat('Combo PC Gamer Ryzen + RTX ', CAST(3060 + 10 * (p_partkey % 3) AS STRING)) END"""
CATEGORY = """CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'procesadores' WHEN 1 THEN 'tarjetas-graficas' WHEN 2 THEN 'motherboards'
  WHEN 4 THEN 'memoria-ram' WHEN 5 THEN 'procesadores' ELSE 'perifericos' END"""

VIEWS = {
    "products": (
        "part",
        f"""SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_brand AS brand, {TITLE} AS title, {CATEGORY} AS hw_category,
  CAST(floor(p_retailprice * 100 + 0.5) AS BIGINT) AS retail FROM part""",
    ),
    "offers": (
        "lineitem",
        """SELECT l_partkey AS product_id, l_suppkey AS store_id, CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS price,
  CASE WHEN l_returnflag = 'R' THEN 'out-of-stock' WHEN l_returnflag = 'A' THEN 'low-stock' WHEN l_linestatus = 'F' THEN 'unknown' ELSE 'in-stock' END AS stock,
  CAST(l_shipdate AS TIMESTAMP) AS updated, l_orderkey AS order_id, l_linenumber AS line,
  CAST(floor(l_extendedprice / l_quantity / (1 - l_discount) * 100 + 0.5) AS BIGINT) AS original FROM lineitem""",
    ),
    "stores": ("supplier", "SELECT s_suppkey AS store_id, s_name AS store_name, s_acctbal > 0 AS is_active, s_nationkey AS nation_id FROM supplier"),
    "requests": (
        "events",
        """SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS source, event_type AS endpoint,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'slow' WHEN 'signup' THEN 'blocked' ELSE 'no-results' END AS status,
  CAST(floor(value * 100 + 0.5) AS BIGINT) AS latency FROM events""",
    ),
    "users": ("customer", "SELECT c_custkey AS user_id, c_name AS user_name, c_mktsegment AS segment FROM customer"),
    "favourites": ("orders lineitem", "SELECT DISTINCT o_custkey AS user_id, l_partkey AS product_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame."""
    tables, sql = VIEWS[name]
    named = {t: raw(spark, sf_dir, t) for t in tables.split()}
    text = sql
    for t in named:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **named)


def with_views(sql: str) -> str:
    """SQL over the domain tables as SQL over the raw ones."""
    used = [f"{name} AS ({text})" for name, (_, text) in VIEWS.items() if f"{name}" in sql]
    sql = sql.strip()
    if not used:
        return sql
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(used)}, {sql[len('WITH RECURSIVE'):]}"
    if sql.upper().startswith("WITH"):
        return f"WITH {', '.join(used)}, {sql[len('WITH'):]}"
    return f"WITH {', '.join(used)} {sql}"
