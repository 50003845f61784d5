"""The catalogue operators: known values, edge cases, and batch against stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalith.functions import identity as I
from catalith.functions import price as P
from catalith.functions import text as T
from catalith.functions import urls as U
from catalith.operators import offers as O
from catalith.operators import reading as R
from catalith.operators import resolve
from catalith.plans import search, snapshot
from catalith.sources import feeds
from catalith.sources.tables import with_views
from catalith.streaming import limits


def values(spark, rows, column, schema="s string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


def test_price_texts(spark):
    cases = {
        "$ 248.496,11": 248496, "248.496": 248496, "ARS 248496,50": 248497, "3 cuotas de $82.832": 82832,
        "Antes: $300.000 Ahora: $248.496": 248496, "$ 38.188,80 3 cuotas de $ 15.084,58": 38189, "": 0, "sin precio": 0, "1,234.56": 1235,
    }
    assert values(spark, list(cases), P.parse_price(F.col("s"))) == list(cases.values())
    assert values(spark, [None], P.parse_price(F.col("s"))) == [0]


OFFER = "store_id string, price double, stock string, updated timestamp, seq long"


def folded(spark, rows, function):
    day = dt.datetime(2026, 3, 13)
    array = [(s, float(p), stock, day + dt.timedelta(hours=h), k) for k, (s, p, stock, h) in enumerate(rows)]
    return spark.createDataFrame([(array,)], f"p array<struct<{OFFER.replace(' ', ':').replace(',:', ',')}>>").select(function(F.col("p")).alias("r")).first()["r"]


def test_best_store_prices_is_a_fold(spark):
    best = lambda *rows: [(o["store_id"], o["price"]) for o in folded(spark, rows, P.best_store_prices)]
    assert best(("venex", 320000, "in-stock", 0), ("venex", 300000, "in-stock", 0), ("mexx", 305000, "in-stock", 0)) == [("venex", 300000), ("mexx", 305000)]
    assert best(("a", 100, "out-of-stock", 0), ("A", 120, "in-stock", 0)) == [("A", 120)]
    assert best(("a", 120, "in-stock", 0), ("a", 100, "out-of-stock", 0)) == [("a", 100)]
    assert best(("a", 0, "in-stock", 0), ("", 5, "in-stock", 0)) == []


def test_merges_differ_on_newer_offers(spark):
    rows = [("a", 100, "in-stock", 0), ("a", 110, "in-stock", 5), ("b", 7, "out-of-stock", 0)]
    merged = lambda newer: [o["price"] for o in folded(spark, rows, lambda p: P.merge_prices(p, newer))]
    assert merged(False) == [100, 7] and merged(True) == [110, 7]


def test_comparable_stats(spark):
    stats = lambda *prices: folded(spark, [(f"s{i}", p, "in-stock", 0) for i, p in enumerate(prices)], P.comparable_stats)
    s = stats(260_000, 262_000, 24_849_611)
    assert (len(s["prices"]), s["lowest"], s["highest"], s["average"]) == (2, 260_000, 262_000, 261_000)
    assert [o["price"] for o in stats(255_000, 24_849_611)["prices"]] == [255_000]
    assert stats()["average"] == 0 and stats(5)["lowest"] == 5


def test_identity_keys(spark):
    def key(category, primary, fallback):
        row = spark.createDataFrame([(category, primary, fallback)], "c string, a string, b string")
        source = I.identity_source(F.col("a"), F.col("b"))
        return row.select(I.canonical_key(F.col("c"), source), I.variant_key(F.col("c"), source), I.family_key(F.col("c"), source)).first()

    assert key("tarjetas-graficas", "MSI RTX 5060 8GB", "MSI GeForce RTX 5060 Shadow 2X OC 8GB")[0] == "tarjetas-graficas::gpu:rtx5060:8gb:msi:shadow"
    assert key("perifericos", "Mouse Logitech G502", "Mouse Logitech G502 X Gaming Black")[0] == "perifericos::generic:logitech:mouse:g502-g502-x"
    assert key("perifericos", "Combo Logitech MK120", None)[1] == "perifericos::bundle"
    assert key("procesadores", "AMD Ryzen 5 5600X", None)[:] == ("procesadores::cpu:ryzen55600x", "procesadores::cpu:ryzen55600x", "cpu-family:ryzen5-5600")
    assert key("procesadores", "", None)[0] == "procesadores::unknown"
    assert key("motherboards", "Gigabyte B550M Aorus Elite AM4 WiFi", None)[0] == "motherboards::mb:gigabyte:b550m:am4:aorus:wifi"


def test_heuristic_titles(spark):
    cases = {"Placa de Video ASUS Dual RTX4060TI 8G OC": "ASUS RTX 4060 TI DUAL 8GB", "Kit Teclado + Mouse": "COMBO KIT MOUSE TECLADO", "": ""}
    assert values(spark, list(cases), I.model_spacing(I.heuristic_title(F.col("s")))) == list(cases.values())


def test_fnv_of_known_texts(spark):
    def plain(text):
        h = 2166136261
        for c in text.encode():
            h = ((h ^ c) * 16777619) & 0xFFFFFFFF
        digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
        while h:
            h, r = divmod(h, 36)
            out = digits[r] + out
        return out

    texts = ["", "a", "procesadores|cpu:ryzen55600", "x" * 200]
    assert values(spark, texts, I.fnv1a36(F.col("s"))) == [plain(t) for t in texts]


def test_text_functions(spark):
    assert values(spark, ["  Óptico  ÑANDÚ+x! "], T.identity_text(F.col("s"))) == ["optico nandu+x"]
    assert values(spark, ["TelÃ©fono â\x80\x93 ok", "clean – “x”"], T.repair_display_text(F.col("s"))) == ["Teléfono - ok", 'clean - "x"']
    assert values(spark, ["combo x", "a+b", "comboy", "kit"], T.is_bundle(F.col("s"))) == [True, True, False, True]
    assert values(spark, ["http://a/b?utm_source=x&q=1&ref=2#top", "http://a/b#t"], U.url_key(F.col("s"))) == ["http://a/b?q=1", "http://a/b"]
    assert values(spark, ["A%2520b_c/d", None], U.normal_id(F.col("s"))) == ["a-b-c-d", None]


def test_query_intent(spark):
    assert R.single_variants("mouse logitech g502 x") == ["x"] and R.strict_variants("msi shadow 2x oc rtx 5060") == ["shadow"]
    names = ["Logitech G502 X", "Logitech G502X Plus mouse", "Mouse Logitech G502 Hero"]
    assert values(spark, names, R.has_single_variants(F.col("s"), "mouse logitech g502 x")) == [True, True, False]
    assert values(spark, names, R.covers_query(F.col("s"), "mouse logitech g502")) == [False, True, True]


def test_search_parameters():
    params = search.coerce({"q": "  rtx   5060 ", "minPrice": "900", "maxPrice": "100", "stores": "B, a,,b", "category": "nope", "sort": "name", "limit": "9999"})
    assert params == search.SearchParams("rtx 5060", None, ("a", "b"), 100, 900, "name", 1200)
    assert search.coerce({"minPrice": "-5", "sort": "odd"}).lowest is None
    assert search.cache_key(params) == "rtx 5060||a,b|100|900|name|1200"


def test_change_capture(spark):
    now = dt.datetime(2026, 3, 13, 12)
    new = spark.createDataFrame([(1, "a", now - dt.timedelta(hours=5)), (2, "b", now - dt.timedelta(hours=16)), (3, "c", now), (4, None, now)], "id long, signature string, last_updated timestamp")
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x"), (4, None), (9, "z")], "id long, signature string")
    plan = snapshot.write_plan(O.stored_state(new, old, ["id"]), F.lit(now))
    assert sorted((r["id"], r["change"], r["upsert"], r["append"]) for r in plan.collect()) == [
        (1, "same", False, False), (2, "same", True, False), (3, "changed", True, True), (4, "same", False, False)
    ]
    table = snapshot.upsert(old, new.select("id", "signature"), ["id"])
    assert sorted(r["id"] for r in table.collect()) == [1, 2, 3, 4, 9]
    again = snapshot.upsert(table, new.select("id", "signature"), ["id"])
    assert sorted(map(str, again.collect())) == sorted(map(str, table.collect()))


def test_feeds(spark):
    payload = '{"d": "{\\"data\\": {\\"items\\": [{\\"item_id\\": \\"7\\", \\"item_desc\\": \\"SSD\\", \\"prli_price\\": \\"1200.5\\"}]}}"}'
    got = feeds.decode_rpc(spark.createDataFrame([(payload,), (None,), ("{}",)], "payload string")).collect()
    assert [tuple(r) for r in got] == [("7", "SSD", 1200)]


def events(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(k, k % 3, start + dt.timedelta(minutes=(k * 37) % 600), ["ok", "blocked", "slow"][k % 7 % 3]) for k in range(120)]
    return spark.createDataFrame(rows, "event_id long, source long, ts timestamp, status string")


@pytest.mark.parametrize("count_denied", [True, False])
def test_rate_windows_in_batch_and_stream(spark, tmp_path, count_denied):
    table = events(spark)
    batch = limits.anchored_windows(table, 3600, limit=4, count_denied=count_denied)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    out = limits.anchored_window_stream(stream, 3600, limit=4, count_denied=count_denied)
    job = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination()
    want = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, spark.read.schema(batch.schema).parquet(str(tmp_path / "out")).collect())) == want
    assert any(not r[-1] for r in want)


def test_breaker(spark):
    rows = limits.breaker_open(events(spark)).filter("source = 1").orderBy("ts", "event_id").collect()
    last = None
    for r in rows:
        expected = last is not None and last[1] == "blocked" and r["ts"] < last[0] + dt.timedelta(minutes=30)
        assert r["skipped"] == expected
        if r["status"] in ("blocked", "ok", "slow"):
            last = (r["ts"], r["status"])


def test_views_in_sql():
    assert with_views("SELECT 1 FROM region") == "SELECT 1 FROM region"
    assert with_views("WITH x AS (SELECT 1) SELECT * FROM stores, x").startswith("WITH stores AS (")


def test_relative_times_count_whole_seconds(spark):
    rows = [("2026-03-13 10:00:00.9", "2026-03-13 10:09:00.1"), ("2026-03-13 10:00:00.9", "2026-03-13 10:08:59.95"), ("2026-03-13 10:00:00.2", "2026-03-13 11:00:00.1")]
    time, as_of = (F.col(c).cast("timestamp") for c in ("a", "b"))
    assert values(spark, rows, U.relative_time(time, as_of), "a string, b string") == ["9 min", "8 min", "1 h"]
