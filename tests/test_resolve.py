"""Folds over sorted runs and the near-duplicate merge against plain loops."""

import datetime as dt
import random
import re
import time

import pytest

from catalith import constants as C
from catalith.operators import resolve, runs
from catalith.operators.components import components
from catalith.plans import live

DAY = dt.datetime(2026, 3, 1)
STOCKS = ["in-stock", "out-of-stock", "low-stock"]
OFFERS = "seq long, place long, store_id string, price double, stock string, updated timestamp, key string"


def offer(r, seq, place, prices=(100_000, 110_000, 120_000, 900_000, 30_000)):
    return seq, place, f"{r.choice('ABC')}{r.randint(1, 3)}", float(r.choice(prices)), r.choice(STOCKS), DAY + dt.timedelta(days=r.randint(0, 5)), "x"


@pytest.mark.parametrize("better", [runs.beats, runs.replaces, runs.replaces_or_newer])
def test_offer_folds(spark, better):
    r = random.Random(4)
    rows = [(*offer(r, k % 5, k)[:6], f"k{k % 3}") for k in range(400)] + [(9, 1, "z", 5.0, "in-stock", DAY, None)]
    found = runs.fold_offers(spark.createDataFrame(rows, OFFERS).repartition(3), ["key", "store_id"], ["seq", "place"], better)
    want = {}
    for row in sorted(rows, key=lambda x: (x[0], x[1])):
        held, new = want.get((row[6], row[2])), row[3:6]
        want[row[6], row[2]] = new if held is None or better(held, new) else held
    assert {(x["key"], x["store_id"]): (x["price"], x["stock"], x["updated"]) for x in found.collect()} == want
    assert runs.fold_offers(spark.createDataFrame([], OFFERS), ["key"], ["seq"], better).count() == 0


def test_comparable_offers():
    of = lambda *prices: [o[1] for o in runs.comparable((f"s{k}", p, "in-stock", DAY) for k, p in enumerate(prices))]
    assert of() == [] and of(5) == [5] and of(0, -3) == []
    assert of(250_000, 24_849_611) == [250_000] and of(100_000, 240_000) == [100_000, 240_000]
    assert of(260_000, 24_849_611, 262_000) == [260_000, 262_000] and of(10, 262_000, 260_000) == [260_000, 262_000]
    same = [("s", 9, "out-of-stock", DAY), ("S", 10, "in-stock", DAY), ("S", 10, "in-stock", DAY + dt.timedelta(1)), ("", 1, "in-stock", DAY)]
    assert runs.comparable(same) == [same[2]]


@pytest.mark.parametrize("newer", [True, False])
def test_product_folds(spark, newer):
    r = random.Random(5)
    rows = [(*offer(r, k % 40, k)[:6], f"k{k % 40 % 3}") for k in range(300)]
    found = runs.fold_products(spark.createDataFrame(rows, OFFERS).repartition(4), ["key"], newer, compare_first=not newer)
    want = {}
    for key in ("k0", "k1", "k2"):
        held = None
        for seq in sorted({x[0] for x in rows if x[6] == key}):
            own = [x[2:6] for x in sorted(rows, key=lambda x: x[1]) if x[0] == seq]
            held = (own if newer else runs.comparable(own)) if held is None else runs.merged(held, own, newer)
        want[key] = sorted(held)
    got = {}
    for x in found.collect():
        got.setdefault(x["key"], []).append((x["store_id"], x["price"], x["stock"], x["updated"]))
    assert {k: sorted(v) for k, v in got.items()} == want
    lone = [offer(r, 1, k, (100_000, 110_000, 900_000)) for k in range(9)]
    alone = {c: sorted(x["price"] for x in runs.fold_products(spark.createDataFrame(lone, OFFERS), ["key"], newer, compare_single=c).collect()) for c in (True, False)}
    assert alone == {True: [o[1] for o in runs.comparable(x[2:6] for x in lone)], False: sorted(x[3] for x in lone)}


def test_components(spark):
    r = random.Random(6)
    links = [(k + 1, k) for k in range(60)] + [(1000 + r.randint(1, 200), 1000) for _ in range(300)] + [(b + r.randint(1, 9), b) for b in (r.randint(2000, 2400) for _ in range(300))]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        todo = [node] if node not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = node
                todo += near[x]
    assert {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PRODUCTS = "seq long, product_id long, hw_category string, name string, brand string, model string, image string, created timestamp, updated timestamp"


def plain_merge(products, offers, newer, facts):
    """The rule as it reads: each product goes into the first cluster that takes it."""
    held = []
    for p in sorted(products, key=lambda x: x["seq"]):
        row = {**facts[p["seq"]], "seq": p["seq"], "name": p["name"], "offers": [o[2:6] for o in offers if o[0] == p["seq"]], "all": [p["seq"]]}
        at = next((c for c in held if c["hw_category"] == row["hw_category"] and resolve._mergeable(c, row)), None)
        if at is None:
            held.append(row)
            continue
        if len(row["tokens"]) > len(at["tokens"]):
            at |= {k: row[k] for k in ("model", "brand", "chip", "memory", "tokens", "name")}
        at["offers"] = runs.merged(at["offers"], row["offers"], newer)
        at["all"].append(p["seq"])
    return held


@pytest.mark.parametrize("newer, seed", [(False, 1), (True, 2), (False, 3)])
def test_near_duplicates_against_a_loop(spark, newer, seed):
    r = random.Random(seed)
    parts = [["MSI", "ASUS", "Zotac", ""], ["RTX 4060", "RTX 4060 Ti", "RX 7600"], ["Ventus", "Dual", "", "Shadow"], ["8GB", "", "12GB"], ["OC", "", "2X"]]
    names = [" ".join(w for w in map(r.choice, parts) if w) for _ in range(90)] + ["Mouse Logitech G502"] * 4 + ["", "Combo RTX 4060 + fuente", "combo rtx 4060 + fuente"]
    products = [
        {"seq": k, "product_id": 500 - k, "hw_category": r.choice(["tarjetas-graficas", "procesadores"]) if k < 90 else "perifericos", "name": n, "brand": None, "model": f"m{k}",
         "image": r.choice(["/pixel-box.svg", f"/{k}.png"]), "created": DAY, "updated": DAY + dt.timedelta(days=k % 7)}
        for k, n in enumerate(names)
    ]
    offers = [offer(r, k % 95, k, (100_000, 110_000, 700_000)) for k in range(240)]
    rows, prices = spark.createDataFrame([tuple(p.values()) for p in products], PRODUCTS), spark.createDataFrame(offers, OFFERS).drop("key")
    facts = {x["seq"]: x.asDict() for x in resolve.near_duplicate_facts(rows).collect()}
    want = plain_merge(products, offers, newer, facts)
    got = {x["seq"]: x["cluster"] for x in resolve.cluster_near_duplicates(rows, prices, newer).collect()}
    assert got == {s: c["all"][0] for c in want for s in c["all"]} and any(len(c["all"]) > 2 for c in want)
    merged, kept = resolve.merge_near_duplicates(rows, prices, newer)
    found = {}
    for x in kept.collect():
        found.setdefault(x["cluster"], []).append((x["store_id"], x["price"], x["stock"], x["updated"]))
    assert {k: sorted(v) for k, v in found.items()} == {c["all"][0]: sorted(c["offers"]) for c in want if c["offers"]}
    by = {p["seq"]: p for p in products}
    for x in merged.collect():
        own = next(c for c in want if c["all"][0] == x["cluster"])
        real = [by[s]["image"] for s in own["all"] if by[s]["image"] != "/pixel-box.svg"]
        image = by[own["all"][0]]["image"] if newer or not real else real[0]
        assert (x["name"], x["image"], x["product_id"], x["n_products"]) == (own["name"], image, by[x["cluster"]]["product_id"], len(own["all"]))
        assert x["updated"] == max(by[s]["updated"] for s in own["all"]) and (x["model"] == x["name"] if newer else x["model"].startswith("m"))
        cheapest = [o[1] for o in own["offers"]]
        assert (x["n_offers"], x["lowest"]) == (len(cheapest), min(cheapest, default=0))
    assert resolve.cluster_near_duplicates(rows.limit(0), prices).count() == 0


def plain_live(search, products, offers, keys, facts):
    """One search as it reads: groups with a name that has enough words, filters, merges in order, near duplicates, tests of the names, sort."""
    from catalith.functions.text import plain_identity
    from catalith.operators.reading import single_variants, strict_variants

    query = search["query"] or ""
    text, words = plain_identity(query), [w for w in plain_identity(query).split() if len(w) > 1]

    def score(name, category, lowest):
        n = plain_identity(name)
        hit = sum(w in n for w in words)
        bundle = lambda t: "+" in t or any(f" {b} " in f" {t} " for b in C.BUNDLE_TERMS)
        out = hit * 25 + (120 if words and hit == len(words) else 0) + (120 if text and text in n else 0) + (30 if search["category"] and category == search["category"] else 0)
        return out - (120 if bundle(n) and not bundle(text) else 0) + (max(0, 20 - int(lowest // 200_000)) if lowest > 0 else 0)

    def fits(name):
        n = plain_identity(name)
        models = [w for w in words if re.search("[a-z]", w) and re.search(r"\d", w) or re.fullmatch(r"\d{3,5}", w)]
        need = len(words) if len(words) <= 2 else -(-7 * len(words) // 10)
        single = all(any(m + v in n or re.search(rf"\b{m}\s+{v}\b", n) for m in models) for v in single_variants(query)) if models else True
        return sum(w in n for w in words) >= need and single and all(re.search(rf"\b{v}\b", n) for v in strict_variants(query))

    need = len(words) if len(words) <= 2 else -(-7 * len(words) // 10)
    named = {keys[p["seq"]] for p in products if sum(w in plain_identity(p["name"]) for w in words) >= need and (words or p["hw_category"] == search["category"])}
    groups = {}
    for p in sorted(products, key=lambda x: x["seq"]):
        if keys[p["seq"]] not in named:
            continue
        own = [o[2:6] for o in sorted(offers, key=lambda x: x[1]) if o[0] == p["seq"]]
        least = p["lowest"]
        if (search["category"] and p["hw_category"] != search["category"]) or least < (search["lowest"] or 0) or (search["highest"] is not None and least > search["highest"]):
            continue
        g = groups.get(keys[p["seq"]])
        if g is None:
            groups[keys[p["seq"]]] = {"shown": p, "first": p, "offers": runs.comparable(own), "updated": p["updated"]}
            continue
        if score(p["name"], p["hw_category"], least) > score(g["shown"]["name"], g["shown"]["hw_category"], g["offers"][0][1] if g["offers"] else 0):
            g["shown"] = p
        g["offers"], g["updated"] = runs.merged(g["offers"], own, False), max(g["updated"], p["updated"])
    held = []
    for g in groups.values():
        row = {**facts[g["shown"]["seq"]], "name": g["shown"]["name"], "first": g["first"], "offers": g["offers"], "updated": g["updated"], "hw_category": g["first"]["hw_category"]}
        at = next((c for c in held if c["hw_category"] == row["hw_category"] and resolve._mergeable(c, row)), None)
        if at is None:
            held.append(row)
            continue
        if len(row["tokens"]) > len(at["tokens"]):
            at |= {k: row[k] for k in ("model", "brand", "chip", "memory", "tokens", "name")}
        at["offers"], at["updated"] = runs.merged(at["offers"], row["offers"], False), max(at["updated"], row["updated"])
    kept = [c for c in held if not words or fits(c["name"])]
    low = lambda c: min((o[1] for o in c["offers"]), default=0)
    bundle = lambda c: "+" in c["name"] or any(f" {b} " in f" {plain_identity(c['name'])} " for b in C.BUNDLE_TERMS)
    order = {"price-asc": lambda c: low(c), "price-desc": lambda c: -low(c), "newest": lambda c: -c["updated"].timestamp(), "name": lambda c: c["name"]}
    kept.sort(key=order.get(search["sort"], lambda c: (bundle(c), -score(c["name"], c["hw_category"], low(c)), low(c))))
    return [(search["search_id"], k + 1, len(kept), c["first"]["product_id"], c["name"], low(c), len(c["offers"])) for k, c in enumerate(kept)]


def test_live_search_against_a_loop(spark):
    r = random.Random(9)
    parts = [["MSI", "ASUS", ""], ["RTX 4060", "RTX 4060 Ti", "rtx4060ti"], ["Ventus", "Dual", "", "Shadow"], ["8GB", "", "12GB"], ["OC", ""]]
    names = [" ".join(w for w in map(r.choice, parts) if w) for _ in range(60)] + ["Mouse Logitech G502 X", "Mouse Logitech G502X Plus", "Mouse Logitech G502 Hero", "Combo PC RTX 4060 + fuente"]
    offers = [offer(r, k % 62, k, (100_000, 110_000, 500_000)) for k in range(260)]
    least = lambda k: min((o[1] for o in runs.comparable(x[2:6] for x in offers if x[0] == k)), default=0)
    kinds = ["tarjetas-graficas"] * 60 + ["perifericos"] * 3 + ["tarjetas-graficas"]
    products = [
        {"seq": k, "product_id": 900 - k, "hw_category": kinds[k], "name": n, "brand": None, "model": None, "image": "/i.png", "created": DAY, "updated": DAY + dt.timedelta(minutes=k), "lowest": int(least(k))}
        for k, n in enumerate(names)
    ]
    rows = spark.createDataFrame([tuple(p.values()) for p in products], PRODUCTS + ", lowest long")
    keyed = resolve.with_keys(rows, "name").select(*rows.columns, "canonical_key")
    keys, facts = {x["seq"]: x["canonical_key"] for x in keyed.collect()}, {x["seq"]: x.asDict() for x in resolve.near_duplicate_facts(rows).collect()}
    texts = ["rtx 4060", "msi rtx 4060 ti dual 8gb", "Shadow 4060", "logitech g502 x", "logitech g502 hero", "combo rtx 4060", "ti", "zzz 4060", "ásus RTX-4060 oc", "", None, "x"]
    sorts = ["relevance", "price-asc", "price-desc", "newest", "name", None]
    searches = [
        {"search_id": 3 * k, "query": t, "category": [None, "tarjetas-graficas", "perifericos"][k % 3] if t else "tarjetas-graficas", "lowest": [None, 100_000][k % 2], "highest": [None, 110_000][k % 4 == 3], "sort": sorts[k % 6]}
        for k, t in enumerate(texts + texts[:6])
    ]
    table = spark.createDataFrame([tuple(s.values()) for s in searches], "search_id long, query string, category string, lowest long, highest long, sort string")
    found = live.live_search(table, keyed, spark.createDataFrame(offers, OFFERS).drop("key"))
    got = sorted((x["search_id"], x["rank"], x["total"], x["product_id"], x["name"], x["lowest"], x["n_offers"]) for x in found.collect())
    want = sorted(row for s in searches for row in plain_live({**s, "sort": s["sort"] or "relevance"}, products, offers, keys, facts))
    assert [g for g in got if g not in want] == [] and got == want and len({w[0] for w in want}) > 8
    assert live.live_search(table.limit(0), keyed, spark.createDataFrame(offers, OFFERS)).count() == 0


@pytest.mark.parametrize("newer", [True, False])
def test_held_offers_are_those_of_plain_merges(newer):
    """Stores in either case, without a name, without a price, and prices that come and go as outliers."""
    r = random.Random(11)
    for _ in range(60):
        one = lambda: (r.choice(["a", "A", "b", "B", "c", "d", "e", "", None]), float(r.choice([0, -1, 30_000, 100_000, 110_000, 120_000, 260_000, 900_000])), r.choice(STOCKS), r.randint(0, 5))
        plain = [one() for _ in range(r.randint(0, 4))]
        held, shown = plain, None
        for _ in range(40):
            new = [one() for _ in range(r.randint(0, 4))]
            plain, held = runs.merged(plain, new, newer), runs.merged_over(held, new, newer)
            assert sorted(held) == sorted(plain) and [o[1] for o in held] == [o[1] for o in plain]
            if shown is not None:
                for come, o in held.changes:
                    (shown.add if come else shown.discard)(o[:2])
            shown = {o[:2] for o in held} if shown is None else shown
            assert shown == {o[:2] for o in held}


def test_sorted_blocks(monkeypatch):
    monkeypatch.setattr(runs.Sorted, "SIZE", 4)
    r, want = random.Random(12), []
    held = runs.Sorted([])
    for k in range(600):
        if want and r.random() < (0.3 if k < 300 else 0.7):
            held.remove(want.pop(r.randrange(len(want))))
        else:
            value = (r.randint(0, 50), k)
            held.add(value)
            want.append(value)
            want.sort()
        assert [held[i] for i in range(len(want))] == want and all(len(b) <= 8 for b in held.blocks)
        assert not want or (held.first(), held.last()) == (want[0], want[-1])


def _took(function):
    began = time.perf_counter()
    function()
    return time.perf_counter() - began


def test_merges_cost_what_is_new():
    """Products of ten thousand stores under one key: work by product, not by what is held."""

    def merges(n):
        held = [("s0", 1000.0, "in-stock", 0)]
        for k in range(n):
            held = runs.merged_over(held, [(f"s{k * 7 % n}", 1000.0 + k % 97, "in-stock", k)], True)
        assert len(held) == n

    assert _took(lambda: merges(20_000)) < 4


def test_near_duplicates_cost_what_is_new():
    """Bundles of one chip, each tied to the first over one of its many stores."""

    def decisions(n):
        state = {"row": None, "clusters": [], "models": {}, "shown": {}, "out": []}
        for k in range(n):
            offers = [(f"s{j}", 1000.0, "in-stock", k) for j in (k, k + 1)]
            state["row"] = {"seq": k, "model": None, "brand": None, "chip": "rtx3060", "memory": None, "tokens": ["combo", "rtx"], "offers": offers}
            resolve._decide(state, False)
        assert {c for _, c in state["out"]} == {0} and len(state["out"]) == n

    assert _took(lambda: decisions(20_000)) < 4


@pytest.mark.parametrize("better", [runs.beats, runs.replaces, runs.replaces_or_newer])
def test_long_runs_of_offers(spark, better):
    """Runs over several batches, falling behind a cheap first offer, which column rounds alone would take one by one."""
    day = int(DAY.replace(tzinfo=dt.UTC).timestamp())
    stock = "CASE WHEN id % 7 = 0 THEN 'out-of-stock' ELSE 'in-stock' END"
    made = f"SELECT IF(id < 30000, 'long', IF(id % 3 = 0, NULL, 'x')) AS key, CAST(id % 2 AS STRING) AS store_id, id AS seq, CAST(IF(id < 2, 5, 50000 - id) AS DOUBLE) AS price, {stock} AS stock, timestamp_seconds({day} + id) AS updated FROM range(40000)"
    rows = spark.sql(made)
    want = {}
    for x in sorted(rows.collect(), key=lambda x: x["seq"]):
        held, new = want.get((x["key"], x["store_id"])), (x["price"], x["stock"], x["updated"])
        want[x["key"], x["store_id"]] = new if held is None or better(held, new) else held
    found = runs.fold_offers(rows, ["key", "store_id"], ["seq"], better).collect()
    assert len(found) == len(want) and {(x["key"], x["store_id"]): (x["price"], x["stock"], x["updated"]) for x in found} == want


def test_per_distinct(spark):
    """Each distinct value is worked on once, dealt over all tasks, whatever partitions the rows come in; nulls are values."""
    rows = spark.createDataFrame([(k, ["a", "b", None][k % 3], "x" if k % 2 else None) for k in range(60)], "id long, t string, u string").coalesce(1)
    seen = []

    def add(distinct):
        seen.append((distinct.count(), distinct.rdd.getNumPartitions()))
        return distinct.selectExpr("t", "u", "concat_ws('-', t, u) AS both")

    found = resolve.per_distinct(rows, ["t", "u"], add)
    assert seen == [(6, 4 * spark.sparkContext.defaultParallelism)] and found.columns == ["id", "t", "u", "both"]
    assert {r["id"]: r["both"] for r in found.collect()} == {k: "-".join(x for x in (["a", "b", None][k % 3], "x" if k % 2 else None) if x) for k in range(60)}


def test_blocks_are_of_one_line_of_chips(spark):
    """An offer ties products of one chip only, chips of one model are one line, and a line of one model asks for no offers."""
    chips = {1: "a", 2: "a", 3: "b", 4: "b", 5: "c", 6: "d", 7: None, 8: "e", 9: "e", 10: None, 11: "c"}
    models = {5: "m", 6: "m", 7: "m", 8: "n", 9: "n"}
    facts = [(k, "x", models.get(k), None, chip, None, ["t"]) for k, chip in chips.items()]
    facts = spark.createDataFrame(facts, "seq long, hw_category string, model string, brand string, chip string, memory string, tokens array<string>")
    offers = spark.createDataFrame([(k, k, "s", 5.0, "in-stock", DAY) for k in chips], "seq long, place long, store_id string, price double, stock string, updated timestamp")
    found = {x["seq"]: (x["first"], x["mixed"]) for x in resolve._blocks(facts, offers).collect()}
    assert found == {1: (1, True), 2: (1, True), 3: (3, True), 4: (3, True), **{k: (5, True) for k in (5, 6, 7, 11)}, 8: (8, False), 9: (8, False), 10: (10, False)}


def test_a_held_offer_takes_little_memory():
    """A cluster's offers of many stores, as a block of a large table holds them."""
    import tracemalloc

    n, state = 20_000, {"row": None, "clusters": [], "models": {}, "shown": {}, "out": []}
    rows = [[(f"s{j}", 1000.0 + j % 97, "in-stock", j) for j in range(k, k + 20)] for k in range(0, n, 20)]
    facts = {"model": "m", "brand": None, "chip": "rtx3060", "memory": None, "tokens": ["rtx"]}
    tracemalloc.start()
    for k, offers in enumerate(rows):
        state["row"] = {**facts, "seq": k, "offers": offers}
        resolve._decide(state, False)
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(state["clusters"][0]["offers"]) == n and taken / n < 260


def test_searches_that_see_the_same_of_a_group_share_a_lead(spark):
    """By category and prices, null or not; a group of several names is each search's own."""
    names = [("k1", "rtx 4060", "g"), ("k1", "rtx 4060", "g"), ("k2", "rtx 4060", "g"), ("k2", "rtx 4060 oc", "g"), ("k3", "x", None)]
    named = spark.createDataFrame(names, "canonical_key string, name_text string, hw_category string")
    asked = spark.createDataFrame([(1, None, 0, None), (2, None, 0, None), (3, "g", 0, None), (4, None, 5, None), (5, "g", 0, None), (6, None, 0, 9)], "search_id long, category string, lowest long, highest long")
    pairs = spark.createDataFrame([(s, k) for s in range(1, 7) for k in ("k1", "k2", "k3")], "search_id long, canonical_key string")
    found = {(r["search_id"], r["canonical_key"]): r["lead"] for r in live._led(pairs, asked, named).collect()}
    lead = {1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 6}
    assert found == {(s, k): s if k == "k2" else lead[s] for s in range(1, 7) for k in ("k1", "k2", "k3")}
