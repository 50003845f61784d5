"""Entity resolution: exact groups by canonical key, then greedy near-duplicate merging."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from heapq import heappop, heappush
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import identity as I
from ..functions import price as P
from ..functions import text as T
from ..storage import materialise
from . import runs
from .components import components


def per_distinct(rows: DataFrame, inputs: list[str], add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with the columns that ``add`` gives the distinct values of ``inputs``, as many products and shops share a title.

    The distinct values are dealt over all tasks, whatever few files or bytes they come in.
    """
    distinct = rows.select(*inputs).distinct()
    added = add(distinct.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *inputs)).withColumnsRenamed({k: f"_k_{k}" for k in inputs})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in inputs))
    return rows.join(materialise(added), same).drop(*(f"_k_{k}" for k in inputs))


def with_keys(products: DataFrame, title: str = "title") -> DataFrame:
    """Adds normalized_title, canonical_key, family_key and variant_key (hw_category, brand, model, name)."""

    def keyed(distinct: DataFrame) -> DataFrame:
        normal = I.model_spacing(I.heuristic_title(F.col(title)))
        source = I.identity_source(normal, I.identity_fallback(F.col("brand"), F.col("model"), F.col("name")))
        distinct = distinct.withColumn("normalized_title", normal).withColumn("_source", source)
        c, s = F.col("hw_category"), F.col("_source")
        return distinct.withColumns({"canonical_key": I.canonical_key(c, s), "family_key": I.family_key(c, s), "variant_key": I.variant_key(c, s)}).drop("_source")

    return per_distinct(products, list(dict.fromkeys([title, "hw_category", "brand", "model", "name"])), keyed)


def group_exact(products: DataFrame, offers: DataFrame, newer_wins: bool) -> tuple[DataFrame, DataFrame]:
    """(groups, offers): one row per canonical key, and the comparable offers of each.

    ``products``: canonical_key, seq, product_id, name, hw_category, image, created, updated; ``offers``: seq, place,
    store_id, price, stock, updated.  A group has its first product's name and id, the first real image and the widest
    times; offers are merged product by product in order (see ``runs``).
    """
    first = lambda c: F.min_by(c, "seq").alias(c)
    grouped = products.groupBy("canonical_key").agg(
        first("product_id"), first("name"), first("hw_category"), first_image().alias("image"),
        F.min("created").alias("created"), F.max("updated").alias("updated"), F.min("seq").alias("seq"),
    )
    keyed = offers.join(products.select("seq", "canonical_key"), "seq")
    kept = materialise(runs.fold_products(keyed, ["canonical_key"], newer_wins, compare_first=not newer_wins))
    return with_stats(grouped, kept, ["canonical_key"]), kept


def first_image() -> Column:
    """The first real image by seq, or the first one."""
    return F.coalesce(F.min_by("image", F.when(F.col("image") != C.DEFAULT_IMAGE, F.col("seq"))), F.min_by("image", "seq"))


def with_stats(rows: DataFrame, offers: DataFrame, keys: list[str]) -> DataFrame:
    """Adds n_offers, lowest, highest and rounded average of each key's offers; zeros where there are none."""
    stats = offers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_offers"), F.min("price").cast("long").alias("lowest"), F.max("price").cast("long").alias("highest"),
        P.half_up(F.sum("price") / F.count(F.lit(1))).alias("average"),
    )
    return rows.join(stats, keys, "left").na.fill(0, ["n_offers", "lowest", "highest", "average"])


def near_duplicate_facts(products: DataFrame, name: str = "name", scope: str | None = None) -> DataFrame:
    """seq, hw_category (with the scope before it) and what the near-duplicate test compares: model, brand, chip, memory, tokens."""

    def told(distinct: DataFrame) -> DataFrame:
        mark = I.fingerprint(T.identity_text(F.col(name))).alias("_f")
        facts = distinct.select("hw_category", name, I.exact_model(F.col("hw_category"), F.col(name)).alias("_model"), mark, T.dedupe_tokens(F.col(name)).alias("tokens"))
        return facts.select("hw_category", name, F.col("_model").alias("model"), "_f.brand", "_f.chip", "_f.memory", "tokens")

    rows = products.select("seq", "hw_category", name, *([scope] if scope else []))
    facts = per_distinct(rows, ["hw_category", name], told)
    if scope:
        facts = facts.withColumn("hw_category", F.concat_ws("|", F.col(scope).cast("string"), "hw_category"))
    return facts.select("seq", "hw_category", "model", "brand", "chip", "memory", "tokens")


def _lines(facts: DataFrame) -> DataFrame:
    """Facts with ``unit``, the first product of the same model, and ``line``, the chips that models tie to the product's own.

    Products of one model that name several chips tie these; a product that names none has its model's.
    """
    same = ["hw_category", "model"]
    models = facts.filter("model IS NOT NULL").groupBy(*same).agg(F.min("seq").alias("unit"), F.min("chip").alias("least"), F.max("chip").alias("most"))
    facts = facts.join(models, same, "left").withColumn("unit", F.coalesce("unit", "seq"))
    line = lambda chip: F.xxhash64("hw_category", chip)
    tied = facts.filter("least < most AND chip > least").select(line("chip").alias("x"), line("least").alias("y")).filter("x <> y").distinct()
    links = materialise(tied.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))
    facts = facts.withColumn("chip_of", F.coalesce("chip", "least")).withColumn("line", F.when(F.col("chip_of").isNotNull(), line("chip_of"))).drop("least", "most", "chip_of")
    if links.isEmpty():
        return facts
    found = components(links).withColumnRenamed("node", "line")
    return facts.join(found, "line", "left").withColumn("line", F.coalesce("component", "line")).drop("component")


def _blocks(facts: DataFrame, offers: DataFrame) -> DataFrame:
    """Facts with block, its first product of the category, and whether it is mixed.

    Products can meet in a cluster only over an equal model, or over an offer (store and price) that both have in one
    category and line: a cluster's chip is that of one of its products, and all of them are of one line.  A model is one
    node, the least node of each offer is tied to the others, and the components are the blocks.  A line or a block in
    which every product has the one model is a cluster as it is, so the offers of such lines are not looked at.  Keys are
    hashes: two that are equal by chance make a larger block, with the same clusters in it.
    """
    facts = materialise(_lines(facts))
    several = (F.count("model") < F.count(F.lit(1))) | F.coalesce(F.min("model") < F.max("model"), F.lit(True))
    lines = facts.filter("line IS NOT NULL").groupBy("hw_category", "line").agg((several & (F.count(F.lit(1)) > 1)).alias("open")).filter("open").drop("open")
    asked = facts.join(lines, ["hw_category", "line"]).select("seq", "unit", "hw_category", "line")
    shown = offers.filter("store_id IS NOT NULL").select("seq", F.col("store_id").cast("string").alias("store_id"), F.col("price").cast("double").alias("price")).join(asked, "seq")
    keys = materialise(shown.select(F.xxhash64("hw_category", "line", "store_id", "price").alias("key"), "unit"))
    least = keys.groupBy("key").agg(F.min("unit").alias("b"), F.max("unit").alias("top")).filter("b < top").drop("top")
    found = components(keys.join(least, "key").filter("unit > b").select(F.col("unit").alias("a"), "b"))
    placed = facts.join(found.select(F.col("node").alias("unit"), F.col("component").alias("block")), "unit", "left").withColumn("block", F.coalesce("block", "unit"))
    kinds = placed.groupBy("hw_category", "block").agg(F.min("seq").alias("first"), (several & (F.count(F.lit(1)) > 1)).alias("mixed"))
    return placed.drop("unit", "line").join(kinds, ["hw_category", "block"])


def cluster_near_duplicates(products: DataFrame, offers: DataFrame, newer_wins: bool = False, scope: str | None = None) -> DataFrame:
    """(seq, cluster): the greedy merge in order of seq, cluster being the first product of the cluster.

    A product joins the first cluster with its model, or with its chip, a shared offer, no other brand or memory and
    tokens that contain or are contained.  The longer name stands for a cluster from then on, and its offers are merged
    and compared anew, so what comes later depends on all before.  Blocks of one model need no order: an aggregate tells
    them.  Only mixed blocks are chains of decisions; each is streamed, with its clusters as state and an index over
    their models and offers.

    ``products``: seq, hw_category, name, and ``scope``, a column within whose values products merge; ``offers``: seq,
    place, store_id, price, stock, updated.
    """
    facts = materialise(_blocks(materialise(near_duplicate_facts(products, scope=scope)), offers))
    plain = facts.filter("NOT mixed").select("seq", F.col("first").alias("cluster"))
    rows = facts.filter("mixed").join(offers, "seq", "left")
    rows = rows.withColumns({"store_id": F.col("store_id").cast("string"), "price": F.col("price").cast("double"), "tokens": F.array_join("tokens", " ")})

    def step(state, seq, model, brand, chip, memory, tokens, store_id, price, stock, updated):
        if state["row"] is None or state["row"]["seq"] != seq:
            _decide(state, newer_wins)
            state["row"] = {"seq": seq, "model": model, "brand": brand, "chip": chip, "memory": memory, "tokens": tokens.split(), "offers": []}
        if store_id is not None:
            once = state["once"].setdefault
            state["row"]["offers"].append((once(store_id, store_id), price, once(stock, stock), updated))
        return state

    def end(key, state):
        _decide(state, newer_wins)
        return state["out"]

    columns = "seq model brand chip memory tokens store_id price stock updated".split()
    start = lambda key: {"row": None, "clusters": [], "models": {}, "shown": {}, "once": {}, "out": []}
    mixed = runs.stream(rows, ["hw_category", "block"], ["seq", "place"], columns, start, step, end, "seq long, cluster long")
    return plain.unionByName(mixed)


def _decide(state: dict, newer_wins: bool) -> None:
    """Where the product that has ended goes: into the first cluster that takes it, or into one of its own.

    The indexes name the clusters with a model, and per chip those that show an offer now (one as it is, several as a
    set); each is kept by what changes, and what stands for an offer there is what its cluster holds it by.
    """
    row, clusters, models, shown = state["row"], state["clusters"], state["models"], state["shown"]
    if row is None:
        return
    row["words"] = frozenset(row["tokens"])
    same = models.get(row["model"], [])
    while same and clusters[same[0]]["model"] != row["model"]:  # it has another model by now
        heappop(same)
    sharing = _sharing(shown.get(row["chip"]), row["offers"]) if row["chip"] else ()
    alike = (k for k in sharing if _alike(clusters[k], row))
    at = min((*same[:1], *islice(alike, 1)), default=None)
    if at is None:
        at = len(clusters)
        clusters.append({**row, "first": row["seq"]})
        _show(shown, at, clusters[at])
        model = None
    else:
        held = clusters[at]
        chip, model = held["chip"], held["model"]
        longer = len(row["tokens"]) > len(held["tokens"])
        anew = not isinstance(held["offers"], runs.Held) or (longer and row["chip"] != chip)
        if anew:
            _show(shown, at, held, False)
        if longer:
            held |= {k: row[k] for k in ("model", "brand", "chip", "memory", "tokens", "words")}
        held["offers"] = runs.merged_over(held["offers"], row["offers"], newer_wins)
        if anew:
            _show(shown, at, held)
        else:
            for (come, offer), place in zip(held["offers"].changes, held["offers"].places, strict=True):
                _mark(shown, held["chip"], offer, at, come, place)
    if clusters[at]["model"] and clusters[at]["model"] != model:
        heappush(models.setdefault(clusters[at]["model"], []), at)
    state["out"].append((row["seq"], clusters[at]["first"]))


def _sharing(shown: dict | None, offers: list[tuple]) -> list[int]:
    """The clusters that show one of the offers, in order."""
    found: set[int] = set()
    for offer in offers if shown else ():
        at = shown.get((offer[1], offer[0]))
        if at.__class__ is set:
            found |= at
        elif at is not None:
            found.add(at)
    return sorted(found)


def _show(shown: dict, at: int, cluster: dict, come: bool = True) -> None:
    for offer in cluster["offers"]:
        _mark(shown, cluster["chip"], offer, at, come)


def _mark(shown: dict, chip: str | None, offer: tuple, at: int, come: bool, place: tuple | None = None) -> None:
    """Note that a cluster shows an offer, or no longer does; without a chip no offer ties products together."""
    if not chip:
        return
    of_chip = shown.setdefault(chip, {})
    key = place if place is not None and place[1] == offer[0] else (offer[1], offer[0])
    held = of_chip.get(key)
    if come:
        if held is None:
            of_chip[key] = at
        elif held.__class__ is set:
            held.add(at)
        elif held != at:
            of_chip[key] = {held, at}
    elif held.__class__ is set:
        held.discard(at)
        if len(held) == 1:
            of_chip[key] = held.pop()
    elif held == at:
        del of_chip[key]


def _alike(a: dict, b: dict) -> bool:
    """Whether names of one chip say the same: no other brand or memory, and words that contain or are contained."""
    if not a["chip"] or a["chip"] != b["chip"] or any(a[k] and b[k] and a[k] != b[k] for k in ("brand", "memory")):
        return False
    x, y = (r["words"] if "words" in r else frozenset(r["tokens"]) for r in (a, b))
    return bool(x and y) and (x <= y or y <= x)


def _mergeable(a: dict, b: dict) -> bool:
    if a["model"] and a["model"] == b["model"]:
        return True
    return _alike(a, b) and not {o[:2] for o in a["offers"]}.isdisjoint(o[:2] for o in b["offers"])


def merge_near_duplicates(products: DataFrame, offers: DataFrame, newer_wins: bool = False, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(products, offers) after the near-duplicate merge: one row per cluster, and its comparable offers.

    The name, brand and model of the most tokens stand (of equal ones the first); where ``newer_wins`` the model is the
    name and the first image stays, else the first real image is taken.  A product that nothing joined keeps its offers.
    """
    clusters = materialise(cluster_near_duplicates(products, offers, newer_wins, scope))
    rows = products.join(clusters, "seq").withColumn("_n", F.struct(F.size(T.dedupe_tokens(F.col("name"))).alias("n"), (-F.col("seq")).alias("s")))
    longest = lambda c: F.max_by(c, "_n")
    merged = rows.groupBy("cluster").agg(
        F.min_by("product_id", "seq").alias("product_id"), longest("name").alias("name"), longest("brand").alias("brand"),
        longest("name" if newer_wins else "model").alias("model"), (F.min_by("image", "seq") if newer_wins else first_image()).alias("image"),
        F.min("created").alias("created"), F.max("updated").alias("updated"), F.count(F.lit(1)).alias("n_products"),
    )
    kept = materialise(runs.fold_products(offers.join(clusters, "seq"), ["cluster"], newer_wins, compare_single=False))
    return with_stats(merged, kept, ["cluster"]), kept


def winners(products: DataFrame, updated: str = "updated") -> DataFrame:
    """One product per canonical key (or id, where the key is blank), the newest, then the smallest id; aggregated before the shuffle."""
    key = F.coalesce(F.nullif(F.trim("canonical_key"), F.lit("")), F.col("product_id").cast("string"))
    best = products.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*products.columns), F.struct(F.col(updated), -F.col("product_id"))).alias("b"))
    return best.select("b.*")


def content_signature(columns: list[Column]) -> Column:
    """SHA-1 of the columns as a JSON array; maps go in sorted by key."""
    return F.sha1(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns)))))


def sorted_map(column: Column) -> Column:
    return F.array_sort(F.map_entries(column))
