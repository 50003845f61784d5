"""Refresh plans and stored tables."""

import datetime as dt
import os

from pyspark.sql import functions as F

from catalith.plans import refresh, stored

NOW = dt.datetime(2026, 3, 26, 12)
REQUEST = "request_id long, mode string, query string, categories array<string>, max_queries int, stale_minutes int, reason string"


def plans(spark, requests, tracked=(), hot=()):
    of = lambda rows, more="": spark.createDataFrame(list(rows), "product_id long, name string, category string" + more)
    return refresh.refresh_plan(spark.createDataFrame(requests, REQUEST), of(tracked), of(hot, ", updated timestamp"), F.lit(NOW))


def test_refresh_sources_and_fallbacks(spark):
    own, gone = ["procesadores"], "service_client_unavailable"
    requests = [(1, "tracked", None, own, 5, 180, gone), (2, "tracked", None, own, 5, 180, None), (3, "hot", None, own, 5, 180, None), (4, "hot", None, own, 5, 180, gone)]
    requests += [(5, "cleanup-history", "x", own, 5, 180, gone), (6, "full", None, [], 5, 180, None), (7, "custom", " rtx  5070 ", own, 5, 180, gone), (8, "custom", None, ["nada", "procesadores", "procesadores"], 5, 180, None)]
    hot = [(1, "Ryzen 7600", "procesadores", NOW - dt.timedelta(days=1))]
    found, targets = plans(spark, requests, hot=hot)
    got = {r["request_id"]: (r["source"], r["fallback_applied"], r["fallback_reason"], r["n_targets"]) for r in found.collect()}
    assert got == {
        1: ("tracked-fallback-categories", True, gone, 1), 2: ("tracked-idle", False, None, 0), 3: ("hot-db", False, None, 1), 4: ("hot-fallback-categories", True, gone, 1),
        5: ("cleanup-history", False, None, 0), 6: ("full-categories", False, None, 9), 7: ("custom-query", False, None, 1), 8: ("custom-categories", False, None, 1),
    }
    rows = {(r["request_id"], r["kind"], r["value"], r["category"]) for r in targets.filter("request_id <> 6").collect()}
    assert rows == {(1, "category", "procesadores", "procesadores"), (3, "query", "Ryzen 7600", "procesadores"), (4, "category", "procesadores", "procesadores"), (7, "query", "rtx 5070", "procesadores"), (8, "category", "procesadores", "procesadores")}


def test_refresh_budget(spark):
    """Empty names use up no budget, equal queries do; stale products come oldest first."""
    names = ["  AMD   Ryzen 7 7800X3D  ", "   ", None, "amd ryzen 7 7800x3d", "RTX 5070", "x" * 200]
    tracked = [(k, n, "procesadores" if k < 4 else "not-valid") for k, n in enumerate(names)]
    hot = [(k, f"p{k}", "procesadores", NOW - dt.timedelta(minutes=170 + 5 * k)) for k in range(8)]
    _, targets = plans(spark, [(1, "tracked", None, [], 3, 0, None), (2, "tracked", None, [], 9, 0, None), (3, "hot", None, [], 3, 180, None)], tracked, hot)
    got = {}
    for r in targets.orderBy("request_id", "place").collect():
        got.setdefault(r["request_id"], []).append((r["value"], r["category"]))
    assert got[1] == [("AMD Ryzen 7 7800X3D", "procesadores"), ("RTX 5070", None)]
    assert got[2] == [*got[1], ("x" * 120, None)]
    assert [v for v, _ in got[3]] == ["p7", "p6", "p5"]


def test_stored_upserts_touch_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "stored")
    rows = [(k, f"n{k}", None if k % 3 else 1.5) for k in range(200)]
    schema = "id long, name string, price double"
    stored.create(spark.createDataFrame(rows, schema), path, ["id"], 16)
    files = lambda: {(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    first = files()
    new = [(3, "changed", 2.0), (5, "n5", None), (900, "new", None)]
    assert stored.upsert(spark, path, spark.createDataFrame(new, schema), ["id"], 16) == 2
    second = files()
    assert len(first - second) <= 2 and len(second - first) <= 2
    want = {**{r[0]: r for r in rows}, **{r[0]: r for r in new}}
    assert {r["id"]: tuple(r) for r in stored.read(spark, path).collect()} == want
    assert stored.upsert(spark, path, spark.createDataFrame(new, schema), ["id"], 16) == 0 and files() == second
    assert stored.upsert(spark, path, spark.createDataFrame([], schema), ["id"], 16) == 0
    keep = {"name": lambda new, old: F.coalesce(F.nullif(F.trim(new), F.lit("")), old)}
    assert stored.upsert(spark, path, spark.createDataFrame([(3, " ", 2.0), (7, "named", 9.0)], schema), ["id"], 16, keep) == 1
    assert {r["name"] for r in stored.read(spark, path).filter("id IN (3, 7)").collect()} == {"changed", "named"}
