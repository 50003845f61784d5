"""Centroid clustering, hard negatives and license scan against brute force, with edge rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from catalith.llm import centroids, hard_negatives, license_rules, license_scan

VECTORS = "vec_id long, embedding array<float>, label int, q string, cluster int, score long"


def vector_rows(dim, seed=5, n=90):
    """Nulls, odd lengths, non-finite and huge components, ties, repeated rows and ids, clashing columns."""
    r = random.Random(seed)
    rows = [(k, [float(np.float32(r.randint(-6, 6) / 16)) for _ in range(dim)], r.randint(0, 3)) for k in range(n)]
    rows += [(k, list(rows[k % 7][1]), 1) for k in range(n, n + 30)]  # ties
    rows += [rows[3], rows[3], (10, list(rows[40][1]), 2), (100, list(rows[5][1]), 2), (200, list(rows[9][1]), 0), (200, list(rows[9][1]), 0)]
    rows += [(None, list(rows[2][1]), 1), (300, None, 1), (301, [0.5] * dim, None), (302, [0.5] * (dim - 1) + [None], 1), (303, [0.5] * (dim - 1) + [math.nan], 1)]
    rows += [(304, [0.5] * (dim - 1) + [math.inf], 1), (305, [0.5] * (dim + 1), 1), (306, [], 1), (400, [0.25] * (dim + 1), 1), (401, [1e30] * dim, 1), (402, [0.0] * dim, 2), (-7, [0.5] * dim, 3), (-100, [0.25] * dim, 3)]
    return [(*row, "x", 7, 8) for row in rows]


def whole(vector, scale):
    return [math.floor(scale * x) for x in vector]


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, whole(v, 1024)) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) < 1e5 for x in v)]
    key = lambda row: (row[0] is None, hashlib.sha256(f"3:{row[0]}".encode()).hexdigest())
    middle = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, m), c) for c, m in enumerate(middle))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        middle = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else m for c, m in enumerate(middle)]
    found = [(i, *near(v)) for i, v in kept]
    total = lambda c=None: sum(d for _, d, own in found if c in (None, own))
    return [(i, c, d, total(c), total(), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for i, d, c in found]


def test_clusters_against_plain_python(spark):
    rows = vector_rows(6)
    found = centroids.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), k=8, dim=6)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, plain_clusters(rows, 8, 10, 6)))
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert sorted(map(tuple, centroids.cluster(few, k=8, dim=6).collect())) == sorted(plain_clusters(rows[:3], 8, 10, 6))
    empty = centroids.cluster(spark.createDataFrame([], VECTORS), dim=6)
    assert empty.count() == 0 and empty.columns == found.columns


def test_repeated_start_vectors_leave_the_later_empty(spark):
    rows = [(k // 4, [float(k // 4)] * 4, 0, "x", 1, 2) for k in range(40)]
    found = centroids.cluster(spark.createDataFrame(rows, VECTORS), k=8, dim=4)
    assert sorted(map(tuple, found.collect())) == sorted(plain_clusters(rows, 8, 10, 4))


@pytest.mark.parametrize("size", [3, 2**10, 2**26])
def test_screen_keeps_the_nearest(size):
    """Near ties of large integers, where a float32 product alone would choose wrongly."""
    r = np.random.default_rng(1)
    middle = r.integers(-size, size, (8, 64))
    middle[5] = middle[2]
    middle[6, 0] = middle[3, 0] + 1
    middle[6, 1:] = middle[3, 1:]
    rows = np.concatenate([r.integers(-size, size, (300, 64)), middle, (middle[:4] + middle[4:]) // 2]).astype(np.int32)
    exact = ((rows[:, None, :].astype(object) - middle[None].astype(object)) ** 2).sum(axis=2)
    found, distance = centroids.nearest(rows, middle)
    assert found.tolist() == exact.argmin(axis=1).tolist() and distance.tolist() == exact.min(axis=1).tolist()
    low, high = centroids.intervals(rows, middle)
    own = (rows.astype(object) ** 2).sum(axis=1)[:, None]
    assert (low <= exact - own).all() and (exact - own <= high).all()


def plain_negatives(rows):
    limit = 2**55
    part = [(i, whole(v, 256), y) for i, v, y, *_ in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    part = [p for p in part if sum(x * x for x in p[1]) < limit]
    out = []
    for i, v, y in {(i, tuple(v), y) for i, v, y in part if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, w, z in part if len(w) == len(v) and j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:5]:
            hard = [x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(hard)]
    return out


@pytest.mark.parametrize("ties", [1000, 0])
def test_hard_negatives_against_plain_python(spark, monkeypatch, ties):
    monkeypatch.setattr(hard_negatives, "TIES", ties)  # 0: every window is refined by the digits of vec_id
    rows = [(i, v, y, *rest) for k, (i, v, y, *rest) in enumerate(vector_rows(6, n=140))]
    rows += [(1000 + k, rows[0][1], 1, "x", 1, 2) for k in range(40)]  # more than k rows share every score
    found = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(5))
    want = plain_negatives(rows)
    assert sorted(map(tuple, found.collect())) == sorted(want) and len({w[0] for w in want}) >= 4
    for none in (spark.createDataFrame([], VECTORS), spark.createDataFrame(rows[1:20], VECTORS)):
        assert hard_negatives.mine(none).count() == 0


def test_hard_negatives_in_several_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 3), ("BLOCKS", 2), ("CHUNK", 16)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = random.Random(2)
    rows = [(k, [r.uniform(-1, 1) for _ in range(5)], r.randint(0, 2), "x", 1, 2) for k in range(1500)]
    rows = [(i, list(map(float, np.float32(v))), *rest) for i, v, *rest in rows]
    assert sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, VECTORS)).collect())) == sorted(plain_negatives(rows))


def plain_licenses(text):
    """Every rule on every text, every pair of intervals: no keywords, no order."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    spaced, found = " " + "  ".join(words) + " ", []
    before = lambda at: len(spaced[:at].split())
    for place, (level, label, _, pattern) in enumerate(license_rules.rules()):
        for m in re.finditer(license_scan.expanded(pattern), spaced):
            found.append((before(m.start()), before(m.end()) - 1, level, place, label))
    inside = lambda d, o: o[0] <= d[0] and o[1] >= d[1] and o[2] <= d[2] and ((o[0], o[1]) != (d[0], d[1]) or o[2:4] < d[2:4])
    kept = [d for d in found if not any(inside(d, o) for o in found)]
    score = list(license_rules.LEVELS.values())[min(d[2] for d in kept)] if kept else license_rules.PHRASE if places else 0.0
    base = sorted({label for _, label in places})
    starts = [i for i, _ in places] or [None]
    return len(words), len(places), *((min(starts), max(starts)) if places else (None, None)), ",".join(base), ",".join(sorted({*base, *(d[4] for d in kept)})), score


LICENSED = [
    "cc by cc by-nc 4.0 CC BY", "SPDX-License-Identifier: GPL-3.0-or-later", "license = apache-2.0", "All Rights\nReserved. all rights  reserved",
    "Licensed under the GNU General Public License v3 or any later version and the MIT License.", "GNU Lesser General Public License, version 2.1",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License, https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "Neither the name of Example Corp nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "Released under the terms of the Apache License, Version 2.0 (http://www.apache.org/licenses/LICENSE-2.0). The K License, cc by ſa", "mit license " * 400, "the general public, mit Licht und Lizenz",
]


def test_licenses_against_plain_python(spark, edge_rows):
    texts = [(row[0], row[1]) for row in edge_rows] + [(1000 + k, t) for k, t in enumerate(LICENSED)] + [(None, LICENSED[0]), (1001, LICENSED[1])]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], "doc_id long, text string, labels string, score int, spaced string")
    found = license_scan.scan(docs)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str((i, *plain_licenses(t))) for i, t in texts)
    assert license_scan.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text, labels", list(zip(LICENSED[:9], ["cc-by,cc-by-nc-4.0", "gpl-3.0-or-later", "apache-2.0", "reserved", "gpl,gpl-3.0-or-later,mit", "gpl,lgpl-2.1", "mit", "cc-by-nc-sa,cc-by-nc-sa-4.0", "bsd-3-clause"], strict=True)))
def test_license_labels(text, labels):
    assert plain_licenses(text)[5] == labels


def test_rules_are_gated_by_words_of_their_own():
    for _, label, keys, pattern in license_rules.rules():
        needed = pattern
        while (bare := re.sub(r"\(\?:[^()]*\)\?", " ", needed)) != needed:
            needed = bare
        assert all(re.search(rf"\b{k}\b", needed) for k in keys), (label, keys)
    assert len(license_rules.rules()) > 400


def test_long_texts_take_time_in_proportion(spark):
    import time

    took = []
    for n in (20_000, 100_000):
        began = time.perf_counter()
        row = license_scan.scan(spark.createDataFrame([(1, "mit license cc by " * n)], "doc_id long, text string")).first()
        took.append(time.perf_counter() - began)
        assert row["n_base"] == n and row["labels"] == "cc-by,mit"
    assert took[1] < 30 and took[1] < 15 * max(took[0], 1)
