"""Neighbours in order, over many parts, against a sorted list."""

import random

import pytest

from catalith.operators.ordered import with_next


@pytest.mark.parametrize("parts", [1, 7, None])
def test_next_rows(spark, parts):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randint(0, 40), k, "x") for k in range(600)]
    found = with_next(spark.createDataFrame(rows, "g string, price int, id long, _v string"), ["g"], ["price", "id"], "id", "next", parts)
    want = set()
    for g in ("a", "b", None):
        own = sorted((p, i) for x, p, i, _ in rows if x == g)
        want |= {(g, p, i, "x", own[k + 1][1] if k + 1 < len(own) else None) for k, (p, i) in enumerate(own)}
    assert set(map(tuple, found.collect())) == want
    assert with_next(spark.createDataFrame([], "g string, price int, id long"), ["g"], ["price", "id"], "id", "next").count() == 0
