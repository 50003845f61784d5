"""Refresh plans of many requests at once: what each refreshes, and within what budget.

A request's mode says where its targets come from.  Tracked and stale products are ranked
once; a request takes a prefix of that list, cut where its budget of valid queries is used
up, which a running sum tells.  Lists are as long as the largest budget needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T


def safe_query(name: Column) -> Column:
    """White space collapsed, at most 120 characters."""
    return F.substring(T.collapse(F.coalesce(name, F.lit(""))), 1, 120)


def query_targets(products: DataFrame) -> DataFrame:
    """value and category of products' names as queries; unknown categories are none, empty names have no value."""
    known = F.when(F.col("category").isin(*C.CATEGORIES), F.col("category"))
    return products.withColumns({"value": F.nullif(safe_query(F.col("name")), F.lit("")), "category": known})


def _category_targets(requests: DataFrame) -> DataFrame:
    every = F.array(*map(F.lit, C.CATEGORIES))
    named = F.array_distinct(F.filter("categories", lambda c: c.isin(*C.CATEGORIES)))
    chosen = F.when(F.size(named) > 0, named).otherwise(every)
    return requests.select("request_id", "source", F.posexplode(chosen).alias("place", "value")).select("request_id", "source", "place", F.lit("category").alias("kind"), "value", F.col("value").alias("category"))


def _listed(requests: DataFrame, ranked: DataFrame) -> DataFrame:
    """Targets of requests from a ranked list (rank, value, category, updated): as far as the request looks, as many as it may."""
    within = (F.col("rank") <= F.greatest(F.col("max_queries") * 2, F.lit(C.LEAST_LOOKED_AT))) & (F.col("cutoff").isNull() | (F.col("updated") < F.col("cutoff")))
    # The list is as long as the largest budget needs, so it is broadcast.
    seen = requests.drop("category").join(F.broadcast(ranked), "mode").filter(within & F.col("value").isNotNull())
    upto = F.count(F.lit(1)).over(Window.partitionBy("request_id").orderBy("rank"))
    taken = seen.withColumn("place", upto - 1).filter("place < max_queries")
    key = F.concat_ws(":", F.coalesce("category", F.lit("")), F.lower("value"))
    first = taken.groupBy("request_id", "source", key.alias("_key")).agg(F.min(F.struct("place", "value", "category")).alias("t"))
    return first.select("request_id", "source", F.col("t.place").cast("int").alias("place"), F.lit("query").alias("kind"), "t.value", "t.category")


def refresh_plan(requests: DataFrame, tracked: DataFrame, hot: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(plans, targets) of requests.

    ``requests``: request_id, mode, query, categories, max_queries, stale_minutes, reason (why tracked and hot products
    cannot be read, or null); ``tracked``: product_id, name, category; ``hot``: the same and updated, of products whose
    priority is hot or tracked; ``as_of``: the time.  ``plans``: request_id, source,
    fallback_applied, fallback_reason, n_targets; ``targets``: request_id, place, kind, value, category.
    """
    looked_at = requests.agg(F.greatest(F.max("max_queries") * 2, F.lit(C.LEAST_LOOKED_AT))).first()[0] or C.LEAST_LOOKED_AT
    rank = F.row_number()

    def ranked(kind: str, products: DataFrame, *order: str) -> DataFrame:
        top = query_targets(products.orderBy(*order).limit(int(looked_at))).withColumn("rank", rank.over(Window.orderBy(*order)))
        return top.select(F.lit(kind).alias("mode"), "rank", "value", "category", "updated")

    mode, read = F.col("mode"), F.col("mode").isin("tracked", "hot")
    cutoff = F.when(mode == "hot", as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.col("stale_minutes")))
    asked = requests.withColumns({
        "cutoff": cutoff, "fallback": read & F.col("reason").isNotNull(), "query": F.nullif(T.collapse(F.coalesce("query", F.lit(""))), F.lit("")),
    })
    base = F.when(mode == "cleanup-history", "cleanup-history").when(mode == "full", "full-categories")
    base = base.when((mode == "custom") & F.col("query").isNotNull(), "custom-query").when(mode == "custom", "custom-categories")
    asked = asked.withColumn("source", base.when(F.col("fallback"), F.concat(mode, F.lit("-fallback-categories"))).otherwise(F.concat(mode, F.lit("-db"))))
    by_category = _category_targets(asked.filter("source LIKE '%categories'"))
    custom = asked.filter("source = 'custom-query'").select("request_id", "source", F.lit(0).alias("place"), F.lit("query").alias("kind"), F.col("query").alias("value"), F.get("categories", F.lit(0)).alias("category"))
    own = _listed(asked.filter("source = 'tracked-db'"), ranked("tracked", tracked.withColumn("updated", F.lit(None).cast("timestamp")), "product_id"))
    stale = _listed(asked.filter("source = 'hot-db'"), ranked("hot", hot, "updated", "product_id"))
    targets = by_category.unionByName(custom).unionByName(own).unionByName(stale)
    counts = targets.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_targets"))
    plans = asked.join(counts, "request_id", "left").na.fill(0, ["n_targets"])
    idle = F.col("source").endswith("-db") & (F.col("n_targets") == 0)
    source = F.when(idle, F.replace("source", F.lit("-db"), F.lit("-idle"))).otherwise(F.col("source"))
    plans = plans.select("request_id", source.alias("source"), F.col("fallback").alias("fallback_applied"), F.when(F.col("fallback"), F.col("reason")).alias("fallback_reason"), "n_targets")
    return plans, targets.select("request_id", "place", "kind", "value", "category")
