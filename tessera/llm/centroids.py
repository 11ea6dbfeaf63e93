"""Operator 13: centroid clustering of integer vectors with Orchard search.

Vectors are integers: each component times ``scale``, rounded down.  The
first centroids are the ``k`` rows whose salted id has the smallest SHA-256.
A round assigns every vector to its nearest centroid and moves every
non-empty centroid to the componentwise floor of its vectors' mean; after the
last round the vectors are assigned once more.

Orchard search.  Every centroid has a list of all centroids by rising
distance from it.  A vector starts at some centroid (the nearest by its first
components, a guess that results do not depend on) and walks along that
centroid's list.  A centroid not yet visited is evaluated and marked; if it is
closer (or as close, with a smaller number), the walk goes on from the start
of its list.  It ends where the list's distance is strictly beyond twice the
current distance: by the triangle inequality nothing later can be closer, nor
as close.  All arithmetic is in whole numbers, so results are exact.

Shape of the jobs: vectors are quantised once into a written table; a round
is one pass over it that shuffles, for each task, one row per centroid (count
and sums).  Centroids, their distances and lists (k x k numbers) travel with
the tasks and are all that the driver ever holds.

Edge cases: rows whose vector is null, has another length, or holds a null
or non-finite component take no part; a component beyond +-2**26 after
scaling counts as that bound, so that squared distances fit a long; fewer
than k rows give fewer centroids; a null id is never a first centroid but is
clustered; repeated rows are rows of their own (as first centroids ordered by
hash, then vector); a centroid without vectors stays where it is; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

SCALE, SIZE, K, ROUNDS, SALT = 256, 64, 40, 5, "2"
LIMIT = 1 << 26
GUESS = 8  # components that choose where a walk starts
ROWS = 4096  # vectors that walk together


def quantised(c: Column, scale: int = SCALE) -> Column:
    """array<int> of floor(scale * x), held within +-LIMIT; null if a component is null or not finite."""
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.least(F.greatest(F.floor(x.cast("double") * F.lit(float(scale))), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    return F.when(good, F.transform(c, whole))


class Neighbours:
    """Centroids with, for each, all centroids by rising distance and these squared distances."""

    def __init__(self, centroids: np.ndarray):
        self.at = np.asarray(centroids, np.int64)
        gap = self.at[:, None, :] - self.at[None, :, :]
        self.apart = (gap * gap).sum(axis=2)
        self.lists = np.argsort(self.apart, axis=1, kind="stable")


def nearest(x: np.ndarray, near: Neighbours) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of every row of x, and how many distances were evaluated."""
    n, k = len(x), len(near.at)
    x = x.astype(np.int64)
    guess = np.zeros((n, k), np.int64)
    for j in range(min(GUESS, x.shape[1])):
        gap = x[:, j, None] - near.at[None, :, j]
        guess += gap * gap
    current = guess.argmin(axis=1)
    away = lambda rows, c: ((x[rows] - near.at[c]) ** 2).sum(axis=1)
    walking = np.arange(n)
    dist = away(walking, current)
    visited = np.zeros((n, k), bool)
    visited[walking, current] = True
    place = np.zeros(n, np.int64)
    evaluated = n
    while walking.size:
        c = near.lists[current[walking], place[walking]]
        within = near.apart[current[walking], c] <= 4 * dist[walking]  # a list ends strictly beyond twice the distance
        walking, c = walking[within], c[within]
        place[walking] += 1
        new = ~visited[walking, c]
        rows, c = walking[new], c[new]
        visited[rows, c] = True
        d = away(rows, c)
        evaluated += len(rows)
        closer = (d < dist[rows]) | ((d == dist[rows]) & (c < current[rows]))
        rows, c = rows[closer], c[closer]
        current[rows], dist[rows], place[rows] = c, d[closer], 0
        walking = walking[place[walking] < k]
    return current, dist, evaluated


def _blocks(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            yield b, b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _round(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, size = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Neighbours(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, x in _blocks(batches, 0, size):
            c, _, _ = nearest(x, near)
            count += np.bincount(c, minlength=k)
            np.add.at(total, c, x)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64()), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
                                         ["cluster", "n", "sums"])
    part = rows.select("v").mapInArrow(sums, "cluster int, n long, sums array<long>")
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    found = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[wide(F.col("sums")[j]) for j in range(size)]).alias("sums")).collect()  # k rows at most
    after = centroids.copy()
    for r in found:
        after[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]
    return after


def cluster(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS, size: int = SIZE,
            scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every vector that takes part, final centroids)."""
    v = quantised(F.col(vec_col), scale)
    rows = stored(table.where(F.size(vec_col) == size).select(F.col(id_col).cast("long").alias(id_col), v.alias("v")).where("v is not null"), "whole-vectors")
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string")), 256)
    first = rows.where(F.col(id_col).isNotNull()).orderBy(key, "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, size)
    labels = f"`{id_col}` long, cluster int, distance long"
    if not len(centroids):
        return table.sparkSession.createDataFrame([], labels), centroids
    for _ in range(rounds):
        centroids = _round(rows, centroids)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Neighbours(centroids)
        for b, x in _blocks(batches, 1, size):
            c, d, _ = nearest(x, near)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c, pa.int32()), pa.array(d, pa.int64())], [id_col, "cluster", "distance"])
    return stored(rows.mapInArrow(label, labels), "labels"), centroids


def with_totals(labels: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``labels`` with the inertia of the cluster and of all, and the digest of the cluster's centroid."""
    sums = {r["cluster"]: int(r["s"]) for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    long = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values, kind: F.element_at(F.array(*values) if values else F.array().cast(f"array<{kind}>"), F.col("cluster") + 1)
    return labels.select("*", of([long(sums.get(c, 0)) for c in range(len(sha))], "long").alias("cluster_inertia"),
                         long(sum(sums.values())).alias("inertia"), of([F.lit(s) for s in sha], "string").alias("centroid_sha256"))
