"""Centroid clustering of integer vectors by scalar lookup tables.

Entries become integers, floor(scale * entry). In each round a task tabulates, for every dimension, the
squared differences between the integer values that occur there and every centroid; a distance is then
a sum of table rows, gathered with NumPy, and no vector is subtracted from a centroid. A task folds its
vectors into one count, exact sum and inertia per cluster, so the shuffle carries clusters x tasks rows
and the driver gets clusters x dimensions numbers, whatever the table and however many vectors share
one cluster. All numbers are integers: results do not depend on partitions, order or retries.

The tables cover the values of one Arrow batch, so their size is bounded by its rows at any spread of
values (a corpus-wide list of values would grow with the corpus).

Defined results: only vectors of `dims` entries, none null or non-finite, take part; the others give no
row, and an entry of 2^27 or more after scaling is an error (distances would not fit a long). Repeated
rows each count. Null keys are hashed as the empty text; equal hashes start in order of their vectors.
Fewer vectors than `clusters` give as many centroids as there are vectors; an empty table gives no rows.
Equal distances go to the smaller number; a centroid without vectors stays where it is. Other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwave.llm.common import Work
from quietwave.llm.vectors import WHOLE, as_block, integer_vectors, per_task, summed, whole_lists


def occurring(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur, ascending, and the place of each entry among them."""
    least, width = values.min(), int(values.max() - values.min()) + 1
    if width > 4 * len(values) + 1024:
        return np.unique(values, return_inverse=True)
    shifted = values - least
    present = np.zeros(width, dtype=bool)
    present[shifted] = True
    place = np.cumsum(present) - 1
    return np.nonzero(present)[0] + least, place[shifted]


def distances(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, vectors x centroids, summed from one table of squared differences per dimension."""
    total = np.zeros((len(block), len(centroids)), dtype=np.int64)
    for d in range(block.shape[1]):
        values, place = occurring(block[:, d])
        table = (values[:, None] - centroids[None, :, d]) ** 2
        total += table[place]
    return total


def nearest(block: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller one of equals) and the squared distance to it."""
    found = distances(block, centroids)
    cluster = found.argmin(axis=1)
    return cluster, found[np.arange(len(block)), cluster]


def exact_sum(values: np.ndarray) -> int:
    """Sum of non-negative longs without overflow."""
    return (int((values >> 32).sum()) << 32) + int((values & 0xFFFFFFFF).sum())


def first_centroids(vectors: DataFrame, key: str, clusters: int, seed: str) -> np.ndarray:
    """The vectors with the smallest sha256 of `seed:key`, in the order of the hashes."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name.cast("binary"), 256).alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Per cluster that has vectors: their count, inertia and exact sum."""
    k, dims = centroids.shape

    def start() -> dict:
        return {"n": np.zeros(k, np.int64), "inertia": [0] * k, "sums": np.zeros((k, dims), np.int64)}

    def add(state: dict, column: pa.Array) -> None:
        block = as_block(column, dims)
        cluster, distance = nearest(block, centroids)
        state["n"] += np.bincount(cluster, minlength=k)
        for c in np.unique(cluster).tolist():
            mine = cluster == c
            state["sums"][c] += block[mine].sum(axis=0)
            state["inertia"][c] += exact_sum(distance[mine])

    def finish(state: dict) -> dict:
        lists = [[int(n), inertia, *sums.tolist()] for n, inertia, sums in zip(state["n"], state["inertia"], state["sums"], strict=True)]
        return {"cluster": pa.array(range(k), pa.int32()), "parts": whole_lists(lists)}

    partial = per_task(vectors, ["x"], start, add, finish, "cluster int, parts array<decimal(38,0)>")
    found = {c: parts for (c,), parts in summed(partial, ["cluster"], "parts").items()}
    return {c: (p[0], p[1], [p[2 + d] for d in range(dims)]) for c, p in found.items() if p[0]}


def moved(centroids: np.ndarray, sums: dict[int, tuple[int, int, list[int]]]) -> np.ndarray:
    """Non-empty centroids at the floor of the mean of their vectors."""
    out = centroids.copy()
    for c, (n, _, total) in sums.items():
        out[c] = [t // n for t in total]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, clusters: int = 16, rounds: int = 3,
                    scale: float = 64.0, seed: str = "1") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 and centroid of every usable vector."""
    vectors = Work(df.sparkSession, "clusters").save(integer_vectors(df, [key], vector, dims, scale), "vectors")
    centroids = first_centroids(vectors, key, clusters, seed).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids, cluster_sums(vectors, centroids))
    sums = cluster_sums(vectors, centroids) if len(centroids) else {}
    of_cluster = [sums[c][1] if c in sums else 0 for c in range(len(centroids))]
    total, names = sum(of_cluster), [digest(c) for c in centroids]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, distance = nearest(as_block(batch.column(1), dims), centroids)
            pick = pa.array(cluster)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(of_cluster, WHOLE).take(pick),
                pa.array([total] * batch.num_rows, WHOLE), pa.array(names).take(pick), pa.array(centroids.tolist(), pa.list_(pa.int64())).take(pick),
            ], names=[key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"])

    kind = df.schema[key].dataType.simpleString()
    assigned = vectors.mapInArrow(assign, f"`{key}` {kind}, cluster int, distance long, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string, centroid array<long>")
    return assigned.withColumns({c: F.col(c).cast("long") for c in ("cluster_inertia", "inertia")})
