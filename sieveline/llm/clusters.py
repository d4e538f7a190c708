"""Centroid clustering by weighted deduplication.

1. Vectors are turned into integers, and identical ones become one row with their number: an aggregation with partial
   counts, so a vector that a third of all rows hold costs one row a task.
2. Each round reads the stored distinct vectors, assigns them in numpy to the nearest of the few centroids, and sums
   them, times their numbers, in exact integers: a task sends one row a centroid and component, and the sums are added
   by Spark. Only the k new centroids reach the driver.
3. The last assignment of the distinct vectors is joined back to the ids. The commonest vectors, at most 1,000, are
   joined by broadcast, so no task meets all copies of one.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import discard_since, mark, prepare, scratch, stored

LARGEST = 1 << 27  #: quantised components saturate here, so that the square of a distance fits 64 bits
COMMON = 1000  #: a vector of more than one row in so many is joined by broadcast
LOW_BITS = 20  #: weights are multiplied in two halves, so that no product of a batch leaves 64 bits


def usable(vector: Column, dim: int) -> Column:
    """Exactly dim components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def _quantise(scale: int):
    def run(batches):
        for batch in batches:
            x = batch.column("x")
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.empty((0, 1))
            with np.errstate(over="ignore"):  # what overflows saturates
                q = np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in q], pa.binary())], ["id", "q"])

    return run


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; the smaller number where two are as near."""
    far = np.stack([((q - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(q)), at]


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("q").to_pylist()), "<i4").reshape(batch.num_rows, -1).astype(np.int64)


def _sums(centroids: np.ndarray):
    """Rows (cluster, at, total): the weighted sum of each component of a cluster's vectors; at = -1: their number."""

    def run(batches):
        k, dim = centroids.shape
        total, number = np.zeros((k, dim), object), [0] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            q, w = _vectors(batch), batch.column("w").to_numpy()
            at, _ = nearest(q, centroids)
            for c in np.unique(at).tolist():
                mine, high, low = q[at == c], w[at == c] >> LOW_BITS, w[at == c] & ((1 << LOW_BITS) - 1)
                total[c] += ((mine * high[:, None]).sum(axis=0).astype(object) << LOW_BITS) + (mine * low[:, None]).sum(axis=0).astype(object)
                number[c] += sum(w[at == c].tolist())
        rows = [(c, j, Decimal(v)) for c in range(k) if number[c] for j, v in [(-1, number[c]), *enumerate(total[c].tolist())]]
        made = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, [pa.int32(), pa.int32(), pa.decimal128(38, 0)])]
        yield pa.RecordBatch.from_arrays(made, ["cluster", "at", "total"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, far = nearest(_vectors(batch), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("w"), pa.array(at, pa.int32()), pa.array(far, pa.int64())], ["q", "w", "cluster", "distance"])

    return run


def weighted_clusters(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable row of vectors(key, column, ...).

    Components become floor(scale * x), x as double. The first centroids are the k rows with the smallest sha256 of
    "salt:key", in that order. Each round assigns every vector to the nearest centroid (squared distance; the smaller
    number of equally near ones) and moves every centroid that has vectors to their componentwise floor(sum / count).
    - Rows without exactly dim components, or with a null or non-finite one, are left out, as are null vectors.
    - A null key is clustered like any other but starts no centroid; rows that repeat a key are vectors of their own
      (of equal keys the one with the smaller packed vector starts first).
    - Equal vectors may start several centroids; those of higher number then stay empty and where they are.
    - Fewer than k rows start as many centroids as there are; no row, or none with a key, gives an empty result.
    - Components beyond 2^27 / scale in size saturate there. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kept = scratch(spark, "assigned")
    begin = mark()
    x = F.col(column).cast("array<double>")
    rows = vectors.where(usable(x, dim)).select(F.col(key).alias("id"), x.alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.mapInArrow(_quantise(scale), f"id {kind}, q binary")
    first = rows.where("id is not null").orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256), "q").limit(k).select("q").collect()
    if not first:
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.stack([np.frombuffer(r.q, "<i4") for r in first]).astype(np.int64)
    distinct = stored(rows.groupBy("q").agg(F.count("*").alias("w")), "distinct")
    for _ in range(rounds):
        found = distinct.mapInArrow(_sums(centroids), "cluster int, at int, total decimal(38,0)").groupBy("cluster", "at").agg(F.sum("total").alias("total"))
        total = {(r.cluster, r["at"]): int(r.total) for r in found.collect()}  # (dim + 1) numbers a centroid
        for c in {c for c, _ in total}:
            centroids[c] = [total[c, j] // total[c, -1] for j in range(dim)]
    done = stored(distinct.mapInArrow(_assign(centroids), "q binary, w long, cluster int, distance long"), "assigned", kept)
    discard_since(spark, begin)
    inertia = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("w")).alias("far"), F.sum("w").alias("n")).collect()
    whole = int(sum(r.far for r in inertia))
    told = [(r.cluster, int(r.far), whole, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in inertia]
    told = F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    common = F.col("w") > max(1, sum(r.n for r in inertia) // COMMON)
    hot = F.broadcast(done.where(common).select("q", F.col("cluster").alias("c"), F.col("distance").alias("d")))
    rows = rows.join(hot, "q", "left")
    near = rows.where("c is null").select("id", "q").join(done.where(~common), "q").select("id", "cluster", "distance")
    out = near.unionByName(rows.where("c is not null").select("id", F.col("c").alias("cluster"), F.col("d").alias("distance")))
    return out.join(told, "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
