"""Chains of listing pages: from each start the next page, until a chain ends.

A chain ends with its budget, at an address it has been to, at a page that is not there,
or at a page that shows nothing new.  All chains advance together: a round is an equi-join
of their frontier with the table of pages and two anti-joins with what each chain has
seen, and costs what the frontier does; the number of rounds is the budget at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from .shops import PAGE_PARAMETERS


def numbered_url(url: Column, number: Column) -> Column:
    """The address with its page parameter set to a number; without parameters of pages for the first."""
    others = "|".join(PAGE_PARAMETERS)
    base = F.split_part(url, F.lit("?"), F.lit(1))
    asked = F.filter(F.split(F.regexp_replace(url, r"^[^?]*\??", ""), "&"), lambda p: p != "")
    without = F.filter(asked, lambda p: ~p.rlike(rf"^(?:{others})(?:=|$)"))
    # A parameter keeps its place; a new one is added behind.
    has = F.exists(asked, lambda p: p.rlike(r"^page(?:=|$)"))
    page = F.concat(F.lit("page="), number.cast("string"))
    placed = F.transform(asked, lambda p: F.when(p.rlike(r"^page(?:=|$)"), page).otherwise(p))
    query = F.when(number <= 1, without).when(has, placed).otherwise(F.concat(asked, F.array(page)))
    return F.when(F.size(query) > 0, F.concat(base, F.lit("?"), F.array_join(query, "&"))).otherwise(base)


def follow(starts: DataFrame, pages: DataFrame, items: DataFrame, numbering: bool = True) -> tuple[DataFrame, DataFrame]:
    """(visits, found) of all chains.

    ``starts``: chain, url, budget; ``pages``: url, next_url; ``items``: url, item, place.
    ``visits``: chain, number, url, n_new; ``found``: chain, item, number, place, an item where a chain first met it.
    With ``numbering`` addresses from the second on get their number, and a page without a next link is followed
    by the start's next number, as shops do that number their pages.
    """
    return _follow(starts, lambda frontier: (pages, items), numbering)


def follow_reading(starts: DataFrame, stored: DataFrame, read: Callable[[DataFrame], tuple[DataFrame, DataFrame]], numbering: bool = True) -> tuple[DataFrame, DataFrame]:
    """``follow`` over pages that are read when chains come to them: ``read`` gives the pages and items of rows of ``stored`` (with url)."""

    def reached(frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
        return read(materialise(stored.join(frontier.select("url").distinct(), "url", "left_semi").select(*stored.columns)))

    return _follow(starts, reached, numbering)


def _follow(starts: DataFrame, reached: Callable[[DataFrame], tuple[DataFrame, DataFrame]], numbering: bool) -> tuple[DataFrame, DataFrame]:
    start = starts.select("chain", "budget", F.col("url").alias("start"))
    frontier = materialise(start.withColumns({"number": F.lit(1), "url": F.col("start")}).filter("budget >= 1"))
    visits, found = None, None
    while frontier.limit(1).count():
        pages, items = reached(frontier)
        shown = frontier.join(items, "url").groupBy("chain", "number", "url", "item").agg(F.min("place").alias("place"))
        if found is not None:
            shown = shown.join(found.select("chain", "item"), ["chain", "item"], "left_anti")
        new = materialise(shown.select("chain", "item", "number", "place", "url"))
        counts = new.groupBy("chain").agg(F.count(F.lit(1)).alias("n_new"))
        at = materialise(frontier.join(counts, "chain", "left").na.fill(0, ["n_new"]))
        visit = at.select("chain", "number", "url", "n_new")
        visits = visit if visits is None else visits.unionByName(visit)
        found = new.drop("url") if found is None else found.unionByName(new.drop("url"))
        going = at.filter("n_new > 0 AND number < budget").join(pages.select("url", "next_url").dropDuplicates(["url"]), "url")
        going = going.withColumn("after", F.col("number") + 1)
        following = numbered_url(F.coalesce("next_url", "start"), F.col("after")) if numbering else F.col("next_url")
        moved = going.withColumn("url", following).filter("url IS NOT NULL").select("chain", "budget", "start", F.col("after").alias("number"), "url")
        frontier = materialise(moved.join(visits.select("chain", "url"), ["chain", "url"], "left_anti"))
    none = start.limit(0)
    if visits is None:
        visits = none.select("chain", F.lit(1).alias("number"), F.col("start").alias("url"), F.lit(0).cast("long").alias("n_new"))
        found = none.select("chain", F.col("start").alias("item"), F.lit(1).alias("number"), F.lit(0).cast("long").alias("place"))
    return visits, found
