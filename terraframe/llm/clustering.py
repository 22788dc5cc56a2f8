"""Centroid clustering (Lloyd's rounds) whose result is exact although most of its arithmetic is float32.

Vectors become integers, floor(SCALE * x), so distances, sums and ties are well defined. A round's
work is the nearest centroid of every vector. A float32 matrix product tells all inner products at once; each has an
error of at most a bound that follows from the number of components and the lengths of both vectors,
so each distance lies in an interval. Where one interval lies below all others, it is the nearest;
where intervals overlap, those centroids' distances are computed anew in exact integers, and the lowest
number of the least wins. A result never depends on how a machine rounds or in which order it adds.

The bound: for m components, float32's unit u = 2**-24 and any order of additions, fused or not,
|computed - true| <= g * sum(|x_i| * |c_i|) <= g * |x| * |c|, where g covers m roundings of sums, one of
each product and two of the inputs: g = (m + 4) * u / (1 - (m + 4) * u). Components of at most LARGEST keep products and
sums far from float32's ends and exact distances within 63 bits. The intervals' own double arithmetic is covered by
widening them by a 2**-40th.

A round sends each task's sums and counts, a row per centroid and component, to sums by (centroid,
component): a cluster of a third of all vectors is no hot group, and the driver gets k * m numbers.
Vectors are quantised once, kept in the checkpoint folder, and read once a round.

Defined results: rows whose vector is null, of another length, or holds null or non-finite components are left out; a
vector with a component beyond LARGEST / SCALE (131,072) in size raises a ValueError, as its distances may not fit a
long; rows with a null key are clustered but are no starting centroids; equal keys that both start go by
their vectors; with fewer keyed vectors than k there are fewer centroids, with none no rows; repeated rows
count as often as they stand. No columns but key and vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

CLUSTERS, ROUNDS, COMPONENTS, SCALE = 8, 10, 64, 1024
#: Quantised components are at most so large.
LARGEST = 1 << 27
OFFSET = 1 << 31
#: Numbers of all centroids together; they are sent to every task.
MOST = 1 << 24
#: Rows whose products a task makes at a time, for so many centroids.
CELLS = 1 << 20
UNIT, SLACK = 2.0**-24, 1 + 2.0**-40


def quantised(df: DataFrame, key: str, vector: str, components: int, scale: int) -> DataFrame:
    """id and q (components in four bytes each, ordered as vectors are) of the rows that take part."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") == components)).filter(finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if len(values) and np.abs(values).max() > LARGEST:
                raise ValueError(f"a component is larger than {LARGEST / scale:g}: exact distances may not fit a long")
            whole = (values.astype(np.int64) + OFFSET).astype(">u4")
            at = np.arange(len(batch) + 1, dtype=np.int32) * (4 * components)
            q = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(whole.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), q], ["id", "q"])

    return rows.mapInArrow(run, "id long, q binary")


def matrix(column: pa.Array, components: int) -> np.ndarray:
    return _components(b"".join(column.to_pylist())).reshape(len(column), components)


def _components(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, ">u4").astype(np.int64) - OFFSET


def exact_distance(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows that belong together."""
    apart = vectors - centroids
    return np.einsum("ij,ij->i", apart, apart)


def shortlist(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids may be the nearest of each vector, by float32 products and their error intervals."""
    m = vectors.shape[1]
    product = (vectors.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", vectors.astype(np.float64), vectors.astype(np.float64)))
    square = np.einsum("ij,ij->i", centroids.astype(np.float64), centroids.astype(np.float64))
    g = (m + 4) * UNIT / (1 - (m + 4) * UNIT)
    error = 2 * g * SLACK * length[:, None] * np.sqrt(square)
    # |c|^2 - 2 x c orders centroids as the distance does
    value = square - 2 * product
    error += (SLACK - 1) * (square + 2 * np.abs(product) + error)
    return value - error <= (value + error).min(axis=1)[:, None]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centroid of each vector, the lowest number among equals; and how many needed exact distances."""
    near = shortlist(vectors, centroids)
    out = near.argmax(axis=1)
    open_ = np.flatnonzero(near.sum(axis=1) > 1)
    if len(open_):
        row, number = np.nonzero(near[open_])
        distance = exact_distance(vectors[open_[row]], centroids[number])
        order = np.lexsort((number, distance, row))
        first = order[np.r_[True, np.diff(row[order]) != 0]]
        out[open_] = number[first]
    return out, len(open_)


def blocks(batches: Iterator[pa.RecordBatch], components: int, k: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    step = max(1, CELLS // max(k, components))
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            yield part.column(0), matrix(part.column(1), components)


def starting(rows: DataFrame, k: int, seed: int, components: int) -> np.ndarray:
    """The k vectors of the least hashes of `seed:id`, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.filter(F.col("id").isNotNull()).select("q", hashed.alias("h")).orderBy("h", "q").limit(k).collect()
    return np.array([_components(r["q"]) for r in first], np.int64).reshape(len(first), components)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of each cluster's means; an empty cluster's centroid stays."""
    k, m = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, m), np.int64), np.zeros(k, np.int64)
        for _, vectors in blocks(batches, m, k):
            cluster, _ = nearest(vectors, centroids)
            counts += np.bincount(cluster, minlength=k)
            for c in range(k):
                sums[c] += vectors[cluster == c].sum(axis=0)
        held = np.flatnonzero(counts)
        table = np.concatenate([sums[held], counts[held, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, m + 1), pa.int32()), pa.array(np.tile(np.arange(m + 1), len(held)), pa.int32()), pa.array(table.ravel())], ["c", "i", "s"])

    out, total = centroids.copy(), np.zeros((k, m + 1), np.int64)
    for r in rows.mapInArrow(run, "c int, i int, s long").groupBy("c", "i").agg(F.sum("s").alias("s")).collect():
        total[r["c"], r["i"]] = r["s"]
    held = total[:, m] > 0
    out[held] = total[held, :m] // total[held, m :]
    return out


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = 3) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every row that takes part."""
    if k * components > MOST:
        raise ValueError(f"more than {MOST} components of centroids")
    if key in ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"):
        raise ValueError(f"the key {key} is called like a result")
    rows = cut(quantised(df, key, vector, components, scale))
    centroids = starting(rows, k, seed, components)
    if not len(centroids):
        return rows.limit(0).select(F.col("id").alias(key), *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        centroids = moved(rows, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in blocks(batches, components, len(centroids)):
            number, _ = nearest(vectors, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(exact_distance(vectors, centroids[number]))], ["id", "cluster", "distance"])

    placed = cut(rows.mapInArrow(assign, "id long, cluster int, distance long"), rows)
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = df.sparkSession.createDataFrame([(c, s, sum(sums.values()), digest[c]) for c, s in sorted(sums.items())], "number int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = placed.join(F.broadcast(told), F.col("cluster") == F.col("number"))  # a row per cluster
    return joined.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
