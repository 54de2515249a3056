"""Centroid clustering of integer vectors, assigned by the threshold algorithm.

For every dimension the centroids are listed in the order of their component. A vector enters each list at
its own value and walks outward, the nearer side first; a centroid met for the first time in any list gets its
exact distance. The next values not yet met bound every centroid not met anywhere from below: once the
sum of their squared gaps strictly exceeds the best exact distance, the vector's centroid is settled (a sum that
only equals it could still hide a tie with a smaller number). All vectors of a batch walk at once.

A round reads the stored integer vectors, and each task passes on one sum per centroid, so a round shuffles
tasks x k rows whatever the number of vectors, and k rows of sums reach the driver. Sums are integers; the
order of tasks does not show.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are left out;
components beyond 2**24 after scaling count as 2**24, so that distances fit a long; fewer vectors than ``k``
give as many centroids; equal vectors share a cluster, and rows that repeat an id stay rows; a null id takes part but
starts as a centroid only when nothing else is left; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadledger.llm.common import drop_stored, stored

#: Vectors that walk at once in a Python worker.
BATCH = 4096
#: Largest size of a component after scaling.
REACH = 1 << 24


def integer_vectors(df: DataFrame, key: str, vector: str, dims: int, scale: float) -> DataFrame:
    """(key, v) of the vectors with ``dims`` finite components: floor(scale * x) of each, as int."""
    def whole(x):
        return F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(REACH))), F.lit(float(-REACH)))).cast("int")

    def unfit(x):
        return x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))

    v = F.col(vector)
    fit = (F.size(v) == dims) & ~F.exists(v, unfit)
    return df.select(F.col(key).alias("key"), F.when(fit, F.transform(v, whole)).alias("v")).where("v is not null")


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hash of ``salt:key``, in that order (a top-k: k rows reach the driver)."""
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("key").cast("string")), 256)
    rows = vectors.select(mark.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, exact distances worked out) of each row of ``x``."""
    k, dims = centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")  # [place, dim] -> centroid
    lists = np.vstack([np.full(dims, -4 * REACH), np.take_along_axis(centroids, order, 0), np.full(dims, 4 * REACH)])
    best = np.full(len(x), np.iinfo(np.int64).max)
    number = np.full(len(x), k)
    seen = np.zeros((len(x), k), bool)
    # places in ``lists`` of the next value on either side
    up = np.empty(x.shape, np.int64)
    for d in range(dims):
        up[:, d] = np.searchsorted(lists[1:-1, d], x[:, d]) + 1
    down = up - 1
    left, at, spent = np.arange(len(x)), np.arange(dims)[None, :], 0
    while len(left):
        v = x[left]
        below, above = v - lists[down, at], lists[up, at] - v
        step = below <= above
        place = np.where(step, down, up)
        met = order[np.clip(place - 1, 0, k - 1), at]
        inside = (place >= 1) & (place <= k)
        new = np.zeros((len(left), k), bool)
        new[np.broadcast_to(np.arange(len(left))[:, None], met.shape)[inside], met[inside]] = True
        new &= ~seen[left]
        row, c = np.nonzero(new)
        seen[left[row], c] = True
        gap = v[row] - centroids[c]
        exact = np.einsum("ij,ij->i", gap, gap)
        spent += len(row)
        full = np.full((len(left), k), np.iinfo(np.int64).max)
        full[row, c] = exact
        c = full.argmin(1)  # of equal ones the smaller number
        found = full[np.arange(len(left)), c]
        better = (found < best[left]) | ((found == best[left]) & (c < number[left]))
        best[left[better]], number[left[better]] = found[better], c[better]
        down, up = np.where(step, np.maximum(down - 1, 0), down), np.where(step, up, np.minimum(up + 1, k + 1))
        ahead = np.minimum(np.minimum(v - lists[down, at], lists[up, at] - v), 2 * REACH)
        frontier = np.einsum("ij,ij->i", ahead, ahead)
        going = (frontier <= best[left]) & ~seen[left].all(1)
        left, down, up = left[going], down[going], up[going]
    return number, best, spent


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part["key"], part["v"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of each one's vectors; one without vectors stays."""
    k, dims = centroids.shape

    def sums(batches):
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, x in _batches(batches, dims):
            number = nearest(x, centroids)[0]
            np.add.at(total, number, x)
            count += np.bincount(number, minlength=k)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(count[held], pa.int64()),
                                          pa.array(list(total[held]), pa.list_(pa.int64()))], ["c", "n", "s"])

    parts = vectors.select("key", "v").mapInArrow(sums, "c int, n long, s array<long>")
    rows = parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[d]).alias(f"s{d}") for d in range(dims)]).collect()
    out = centroids.copy()
    for r in rows:
        out[r["c"]] = [r[f"s{d}"] // r["n"] for d in range(dims)]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(key, cluster, distance) of every vector."""
    dims = centroids.shape[1]
    key_type = vectors.schema["key"].dataType.simpleString()

    def work(batches):
        for keys, x in _batches(batches, dims):
            number, best, _ = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([keys, pa.array(number, pa.int32()), pa.array(best, pa.int64())], ["key", "cluster", "distance"])

    return vectors.select("key", "v").mapInArrow(work, f"key {key_type}, cluster int, distance long")


def cluster_vectors(df: DataFrame, key: str, vector: str, dims: int, k: int, rounds: int, scale: float = 256.0,
                    salt: str = "2") -> DataFrame:
    """One row per kept vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = df.sparkSession
    key_type = df.schema[key].dataType.simpleString()
    kept = integer_vectors(df, key, vector, dims, scale)
    vectors = stored(kept, "vectors")
    centroids = first_centroids(vectors, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], f"{key} {key_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = stored(assigned(vectors, centroids), "clusters")
    drop_stored(vectors)
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # one row per centroid, k at most
    facts = spark.createDataFrame([(c, s, sum(inertia.values()), shas[c]) for c, s in inertia.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(dims: int, k: int, rounds: int) -> str:
    """SQL over ``embeddings`` for ``cluster_vectors`` with a scale of 256 and a salt of 2."""
    gap = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster, v AS c
        FROM kept ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) LIMIT {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({{'d': d, 'c': cluster}}) AS m
        FROM (SELECT vec_id, v, cluster, CAST({gap} AS BIGINT) AS d FROM kept, c{i}) GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN
        (SELECT cluster, list(x ORDER BY d) AS c FROM (SELECT m.c AS cluster, d, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
         FROM (SELECT m, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{i}) GROUP BY m.c, d) GROUP BY cluster) n ON o.cluster = n.cluster)""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance,
          CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} ON m.c = cluster"""
