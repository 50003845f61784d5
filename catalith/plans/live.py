"""Many searches over the products of all sources as one job.

Names are found through postings of two and three letters: a word that stands anywhere in a
name has its letters there, so the rarest of a word's three-letter pieces gives its
candidates, and of n words that must hit k times only the n - k + 1 rarest are looked up.
What they find is verified word by word.  A search's products are then filtered, grouped by
canonical key with their offers merged in order, cleared of near duplicates, tested for what
the query asks, and ranked by its sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import resolve, runs
from ..storage import materialise

#: Searches are told apart within one number with a product's place: below 2**23 searches, 2**40 products.
_PLACES = 1 << 40


def _pieces(text: Column, size: int) -> Column:
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def understood(searches: DataFrame) -> DataFrame:
    """Searches with what their text asks: words, how many must hit, and the variants that must stand in a name.

    ``searches``: search_id, query, category, lowest, highest, sort; a search without words and category asks for nothing.
    """
    text = T.identity_text(F.coalesce("query", F.lit("")))
    asked = searches.withColumn("text", text).withColumn("all", F.split("text", " "))
    asked = asked.withColumn("words", F.filter("all", lambda w: F.length(w) > 1))
    n = F.size("words")
    model = lambda w: (w.rlike("[a-z]") & w.rlike("[0-9]")) | w.rlike(r"^\d{3,5}$")
    return asked.withColumns({
        "need": F.when(n <= 2, n).otherwise(F.ceil(n * 7 / 10).cast("int")),
        "models": F.filter("words", model),
        "single": F.filter("all", lambda w: w.isin(*C.SINGLE_VARIANTS)),
        "strict": F.filter("all", lambda w: w.isin(*C.STRICT_VARIANTS)),
        "bundle": T.is_bundle(F.col("text")),
    }).drop("all")


def hits(text: Column) -> Column:
    return F.size(F.filter("words", lambda w: F.contains(text, w)))


def fits_intent(text: Column) -> Column:
    """Whether a normalised name has enough of a search's words, its single-letter variants behind a model, and its strict ones as words."""
    padded = F.concat(F.lit(" "), F.replace(text, F.lit("+"), F.lit(" ")), F.lit(" "))
    word = lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" ")))
    behind = lambda m, v: F.contains(text, F.concat(m, v)) | F.contains(padded, F.concat(F.lit(" "), m, F.lit(" "), v, F.lit(" ")))
    single = (F.size("models") == 0) | F.forall("single", lambda v: F.exists("models", lambda m: behind(m, v)))
    return (hits(text) >= F.col("need")) & single & F.forall("strict", word)


def _named(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(search_id, text): normalised names that have enough of a search's words."""
    postings = names.select("text", F.explode(F.array_distinct(F.concat(_pieces(F.col("text"), 2), _pieces(F.col("text"), 3)))).alias("piece"))
    counts = postings.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    words = asked.select("search_id", F.posexplode("words").alias("place", "word"), F.size("words").alias("of"), "need")
    pieces = words.withColumn("piece", F.explode(F.when(F.length("word") == 2, F.array("word")).otherwise(_pieces(F.col("word"), 3))))
    rarest = pieces.join(counts, "piece", "left").na.fill(0, ["n"]).groupBy("search_id", "place", "of", "need").agg(F.min(F.struct("n", "piece")).alias("p"))
    order = F.row_number().over(Window.partitionBy("search_id").orderBy("p", "place"))
    looked_up = rarest.withColumn("k", order).filter("k <= of - need + 1").select("search_id", "p.piece").distinct()
    found = looked_up.join(postings, "piece").select("search_id", "text").distinct()
    return found.join(asked.select("search_id", "words", "need"), "search_id").filter(hits(F.col("text")) >= F.col("need")).select("search_id", "text")


def _score(text: Column, bundle: Column) -> Column:
    """What a name scores for a search, but for its price."""
    n = hits(text)
    score = n * C.SCORE_WORD + F.when((n == F.size("words")) & (n > 0), C.SCORE_ALL).otherwise(0)
    score = score + F.when((F.col("text") != "") & F.contains(text, F.col("text")), C.SCORE_PHRASE).otherwise(0)
    score = score + F.when(F.col("category").isNotNull() & (F.col("hw_category") == F.col("category")), C.SCORE_CATEGORY).otherwise(0)
    return (score + F.when(bundle & ~F.col("bundle"), C.SCORE_BUNDLE).otherwise(0)).cast("long")


def _cheap(lowest: float) -> int:
    return max(0, C.SCORE_PRICE - int(lowest // C.PRICE_STEP)) if lowest > 0 else 0


def _grouped(rows: DataFrame, offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(search_id, canonical_key, shown, first) and the offers of each: products merged in order, the better scored one shown."""
    keys = ["search_id", "canonical_key"]
    facts = rows.select(*keys, "seq", "score", F.col("lowest").cast("double").alias("lowest")).join(offers, "seq", "left")
    facts = facts.withColumns({"store_id": F.col("store_id").cast("string"), "price": F.col("price").cast("double")})

    def close(state):
        new = state["new"]
        if new is None:
            return state
        if state["held"] is None:
            state |= {"held": runs.Held(runs.comparable(new["offers"])), "shown": new, "first": new["seq"]}
        else:
            least = state["held"].least() if state["held"] else 0
            if new["score"] + _cheap(new["lowest"]) > state["shown"]["score"] + _cheap(least):
                state["shown"] = new
            state["held"].merge(new["offers"], newer_wins=False)
        state["new"] = None
        return state

    def step(state, seq, score, lowest, store_id, price, stock, updated):
        if state["new"] is None or state["new"]["seq"] != seq:
            state = close(state)
            state["new"] = {"seq": seq, "score": score, "lowest": lowest or 0, "offers": []}
        if store_id is not None:
            state["new"]["offers"].append((store_id, price, stock, updated))
        return state

    def end(key, state):
        state = close(state)
        return [(*key, state["shown"]["seq"], state["first"], *offer) for offer in state["held"] or [(None, None, None, None)]]

    schema = "search_id long, canonical_key string, shown long, first long, store_id string, price double, stock string, updated timestamp"
    columns = ["seq", "score", "lowest", "store_id", "price", "stock", "updated"]
    start = lambda key: {"held": None, "shown": None, "first": None, "new": None}
    out = materialise(runs.stream(facts, keys, ["seq", "place"], columns, start, step, end, schema))
    groups = out.select(*keys, "shown", "first").distinct()
    return groups, out.filter("store_id IS NOT NULL").select(*keys, "store_id", "price", "stock", "updated")


def _led(pairs: DataFrame, asked: DataFrame, named: DataFrame) -> DataFrame:
    """(search_id, canonical_key) with ``lead``, the first search that sees the same of the group.

    Which products a search sees of a group is told by its category and prices; where all have one normalised name and
    category they score alike, so which is shown does not depend on the search.  Other groups are each search's own.
    """
    name = F.struct("name_text", "hw_category")
    alike = named.groupBy("canonical_key").agg(F.min(name).eqNullSafe(F.max(name)).alias("alike"))
    rows = pairs.join(alike, "canonical_key").join(asked.select("search_id", "category", "lowest", "highest"), "search_id")
    first = F.min("search_id").over(Window.partitionBy("canonical_key", "category", "lowest", "highest"))
    return rows.withColumn("lead", F.when(F.col("alike"), first).otherwise(F.col("search_id"))).select("search_id", "canonical_key", "lead")


def live_search(searches: DataFrame, products: DataFrame, offers: DataFrame) -> DataFrame:
    """Ranked results of all searches: search_id, rank, total, product_id, name, lowest, highest, average, n_offers.

    ``products``: seq, product_id, name, hw_category, brand, model, canonical_key, image, created, updated, lowest;
    ``offers``: seq, place, store_id, price, stock, updated.  A search sees the groups in which some name has enough of
    its words (without words, those of its category).  Category and price filters act on products, before they are
    merged; the query's intent is asked of a group's shown name.
    """
    asked = materialise(understood(searches))
    named = materialise(products.withColumnRenamed("name", "_name").withColumn("name_text", T.identity_text(F.col("_name"))).withColumnRenamed("_name", "name"))
    texts = _named(asked.filter("size(words) > 0"), named.select(F.col("name_text").alias("text")).distinct())
    by_text = texts.join(named.select(F.col("name_text").alias("text"), "canonical_key").distinct(), "text").select("search_id", "canonical_key").distinct()
    browsed = asked.filter("size(words) = 0 AND category IS NOT NULL").select("search_id", F.col("category").alias("hw_category"))
    by_category = browsed.join(named.select("hw_category", "canonical_key").distinct(), "hw_category").select("search_id", "canonical_key")
    within = (F.col("category").isNull() | (F.col("hw_category") == F.col("category"))) & (F.col("lowest_price") >= F.coalesce(F.col("lowest"), F.lit(0)))
    within = within & (F.col("highest").isNull() | (F.col("lowest_price") <= F.col("highest")))
    # A group is folded once for all searches that see the same of it.
    pairs = materialise(_led(by_text.unionByName(by_category), asked, named))
    rows = pairs.filter("lead = search_id").drop("lead").join(named.withColumnRenamed("lowest", "lowest_price"), "canonical_key").join(asked, "search_id").filter(within)
    scored = rows.withColumn("score", _score(F.col("name_text"), T.is_bundle(F.col("name"))))
    groups, kept = _grouped(materialise(scored.select("search_id", "canonical_key", "seq", "score", F.col("lowest_price").alias("lowest"))), offers)
    # The first product of a group lends its id, the best scored one its name; near duplicates merge within a search,
    # where a group stands with a number of its own.
    own = scored.groupBy("search_id", "canonical_key").agg(
        F.min_by("product_id", "seq").alias("product_id"), F.min_by("hw_category", "seq").alias("hw_category"), resolve.first_image().alias("image"),
        F.min_by("created", "seq").alias("created"), F.max("updated").alias("updated"),
    )
    shown = named.select(F.col("seq").alias("shown"), "name", "brand", "model")
    place = (F.col("search_id") * _PLACES + F.col("first")).alias("seq")
    led = groups.join(shown, "shown").join(own, ["search_id", "canonical_key"]).withColumnRenamed("search_id", "lead").join(pairs, ["lead", "canonical_key"])
    entries = materialise(led.select(place, "search_id", "lead", "canonical_key", "product_id", "name", "hw_category", "brand", "model", "image", "created", "updated"))
    ranked = F.dense_rank().over(Window.partitionBy("search_id", "canonical_key").orderBy("price", "store_id")).alias("place")
    prices = kept.select(F.col("search_id").alias("lead"), "canonical_key", ranked, "store_id", "price", "stock", "updated")
    prices = materialise(prices.join(entries.select("lead", "canonical_key", "seq"), ["lead", "canonical_key"]).select("seq", "place", "store_id", "price", "stock", "updated"))
    merged, _ = resolve.merge_near_duplicates(entries, prices, scope="search_id")
    found = merged.join(entries.select(F.col("seq").alias("cluster"), "search_id", "hw_category"), "cluster").join(asked.drop("lowest", "highest"), "search_id")
    found = found.withColumn("name_text", T.identity_text(F.col("name"))).filter((F.size("words") == 0) | fits_intent(F.col("name_text")))
    cheap = F.when(F.col("lowest") > 0, F.greatest(F.lit(0), C.SCORE_PRICE - F.floor(F.col("lowest") / C.PRICE_STEP))).otherwise(0)
    score = _score(F.col("name_text"), T.is_bundle(F.col("name"))) + cheap
    sort = F.col("sort")
    first = F.when(sort == "price-asc", F.col("lowest")).when(sort == "price-desc", -F.col("lowest")).when(sort == "newest", -F.unix_micros("updated")).when(sort == "name", 0).otherwise(T.is_bundle(F.col("name")).cast("long"))
    relevance = ~sort.isin("price-asc", "price-desc", "newest", "name")
    order = [first, F.when(relevance, -score), F.when(relevance, F.col("lowest")), F.collate(F.when(sort == "name", F.col("name")), "es"), F.col("cluster")]
    ranked = Window.partitionBy("search_id")
    return found.select(
        "search_id", F.row_number().over(ranked.orderBy(*order)).alias("rank"), F.count(F.lit(1)).over(ranked).alias("total"), "product_id", "name", "lowest", "highest", "average", "n_offers",
    )
