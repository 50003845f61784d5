"""Centroid clustering in exact integers, with float32 products that only screen.

Vectors become integers, ``floor(scale * x)``.  Each round assigns every vector to its
nearest centroid and moves the centroids to the floor of the mean.  Assignment is exact:

* one float32 matrix product per batch gives every distance within a proven interval
  (the product's rounding error is at most ``(d + 2) u / (1 - (d + 2) u)`` times the
  product of both norms, ``u = 2**-24``, in whatever order the products are summed);
* centroids whose interval begins beyond the end of the best one are out; where one
  remains it is the nearest, else the remaining ones are compared by exact integers,
  and the smaller number wins a tie.

Spark reads the integer vectors, written once, in every round; a task returns sums and
counts per centroid and component, which are added up before and after the shuffle, so
what reaches the driver is ``k * (dim + 1)`` numbers whatever the input.  Everything is
a function of the stored rows: a task that is run again gives the same numbers.

Edge cases: a null vector, one of another length, and one with a null or non-finite
component is not kept, nor is one with a component of ``2**27`` or more after scaling,
whose distances would not fit a long; a null vec_id comes last among the start vectors;
repeated rows are vectors of their own, so equal start vectors give equal centroids, of
which the later stays empty; fewer vectors than ``k`` give fewer centroids; an empty
table gives an empty result; an inertia that does not fit a long is null; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import cut

#: Integers below this bound, differences below twice it: squared distances over up to 64 components fit a long.
BOUND = 1 << 27
#: Unit roundoff of float32, and slack for the bounds' own float64 arithmetic.
UNIT, SLACK = 2.0**-24, 2.0**-48


def integer_rows(batch: pa.RecordBatch, column: str, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows without nulls or non-finite components, their lengths, ``floor(scale * x)`` of their components as doubles)."""
    vectors = batch.column(column)
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    flat = vectors.flatten()
    values = np.asarray(flat.fill_null(np.nan).cast(pa.float64()), dtype=np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(scale * values)
    ends = np.cumsum(np.maximum(lengths, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    begin = ends - np.maximum(lengths, 0)
    good = (lengths >= 0) & (bad[ends] == bad[begin])
    return np.flatnonzero(good), lengths[good], values[np.repeat(good, np.maximum(lengths, 0))]


def integer_vectors(vectors: DataFrame, scale: int, dim: int) -> DataFrame:
    """(vec_id, q) of the vectors that are kept; q holds ``dim`` little-endian 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lengths, values = integer_rows(batch, "embedding", scale)
            fits = lengths == dim
            values = values[np.repeat(fits, lengths)].reshape(-1, dim)
            small = (np.abs(values) < BOUND).all(axis=1)
            packed = values[small].astype("<i4")
            blobs = pa.Array.from_buffers(pa.binary(dim * 4), len(packed), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows[fits][small])), blobs], names=["vec_id", "q"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, q binary")


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row, both exact; ties: the smaller number."""
    if len(centroids) == 1:
        found = np.zeros(len(vectors), dtype=np.int64)
    else:
        low, high = intervals(vectors, centroids)
        open_ = low <= high.min(axis=1)[:, None]
        found = open_.argmax(axis=1)
        rows = np.flatnonzero(open_.sum(axis=1) > 1)
        if len(rows):
            exact = np.full((len(rows), len(centroids)), np.iinfo(np.int64).max)
            for k, centroid in enumerate(centroids):
                which = np.flatnonzero(open_[rows, k])
                exact[which, k] = ((vectors[rows[which]].astype(np.int64) - centroid) ** 2).sum(axis=1)
            found[rows] = exact.argmin(axis=1)
    return found, ((vectors.astype(np.int64) - centroids[found]) ** 2).sum(axis=1)


def intervals(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of every squared distance less the vector's own squared norm, from one float32 product."""
    dot = (vectors.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    norms = [np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in (vectors, centroids)]
    step = (vectors.shape[1] + 2) * UNIT
    both = norms[0][:, None] * norms[1][None, :]
    about = (norms[1] ** 2)[None, :] - 2 * dot
    error = 2 * step / (1 - step) * both * (1 + SLACK) + SLACK * ((norms[1] ** 2)[None, :] + 2 * np.abs(dot) + both)
    return about - error, about + error


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("q").to_pylist()), dtype="<i4").reshape(-1, dim)


def _sums(kept: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, component, total) over all vectors; component -1 counts them."""
    k, dim = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), dtype=np.int64)
        for batch in batches:
            vectors = _matrix(batch, dim)
            found, _ = nearest(vectors, centroids)
            total[:, 0] += np.bincount(found, minlength=k)
            for c in np.unique(found):
                total[c, 1:] += vectors[found == c].sum(axis=0, dtype=np.int64)
        cluster, component = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, (cluster, component - 1, total.ravel()))), names=["cluster", "component", "total"])

    parts = kept.select("q").mapInArrow(run, "cluster long, component long, total long")
    return parts.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect()


def start_vectors(kept: DataFrame, k: int, seed: str, dim: int) -> np.ndarray:
    """The ``k`` vectors of least sha256 of seed and id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(key.alias("key"), "q").orderBy(F.asc_nulls_last("key"), "q").limit(k).collect()
    return np.array([np.frombuffer(r["q"], dtype="<i4") for r in first], dtype=np.int64).reshape(-1, dim)


def fit(kept: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after so many rounds; an empty one stays where it is."""
    for _ in range(rounds):
        total = np.zeros((len(centroids), centroids.shape[1] + 1), dtype=object)
        for cluster, component, n in _sums(kept, centroids):
            total[cluster, component + 1] = n
        moved = np.array([row[1:] // row[0] if row[0] else own for row, own in zip(total, centroids, strict=True)], dtype=np.int64)
        if (moved == centroids).all():
            break  # every further round would give the same
        centroids = moved
    return centroids


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    dim = centroids.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, distance = nearest(_matrix(batch, dim), centroids)
            columns = [batch.column("vec_id"), pa.array(found.astype(np.int32)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, "vec_id long, cluster int, distance long")


def _by_cluster(values: list, kind: str) -> Column:
    """The value of the row's cluster, from a list of ``k``."""
    return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster"))


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", scale: int = 1024, dim: int = 64) -> DataFrame:
    """Per kept vector (vec_id, embedding): cluster, distance, cluster_inertia, inertia and the digest of its centroid."""
    kept = cut(integer_vectors(vectors, scale, dim))
    centroids = start_vectors(kept, k, seed, dim)
    if not len(centroids):
        columns = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".split(", ")
        return kept.select("vec_id", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns))
    centroids = fit(kept, centroids, rounds)
    assigned = cut(assign(kept, centroids))
    sums = dict(assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    longs = lambda x: int(x) if x < 1 << 63 else None
    inertia = [longs(sums.get(c, 0)) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return assigned.select(
        "*",
        _by_cluster(inertia, "long").alias("cluster_inertia"),
        F.lit(longs(sum(sums.values()))).cast("long").alias("inertia"),
        _by_cluster(digests, "string").alias("centroid_sha256"),
    )


def _sql(k: int = 8, rounds: int = 10) -> str:
    parts = [
        """kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, q AS m FROM kept QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, vec_id, q, c, m, list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM kept, m{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""m{r + 1} AS MATERIALIZED (SELECT c, list(v ORDER BY i) AS m FROM (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS v
  FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c
  UNION ALL SELECT c, m FROM m{r} WHERE c NOT IN (SELECT c FROM a{r}))"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds}"""


SQL = _sql()
