"""Centroid clustering on integer vectors: a vantage-point tree over the centroids, rebuilt and broadcast each round.

A round reads the stored vectors once. Each vector walks the tree best first: the open node with the least possible
distance comes next, until no open node can hold a centroid as near as the nearest one seen. The pruning radius is
inclusive, so equally near centroids are all looked at, and the distances that decide are exact 64-bit integers.
Tasks add up their vectors by centroid before anything is shuffled; what reaches the driver, and is broadcast again,
is one row per centroid and component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from folioflux.llm.rows import quoted, table

LEAF = 3            # centroids a leaf holds at most
LIMIT = 1 << 27     # components beyond this could pass 64 bits in a squared distance of up to 128 components
SLACK = 1e-9        # relative error allowed to the square roots in a bound
BATCH = 8_192       # vectors that walk together


class VantageTree:
    """Nodes over centroid numbers. A node has a vantage point and two children, each with the least and the
    greatest distance of its centroids from that point; a leaf has up to LEAF centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64)
        self.members: list[list[int]] = []
        self.children: list[list[tuple[int, float, float]]] = []
        self._grow(np.arange(len(self.centroids)))

    def _grow(self, numbers: np.ndarray) -> int:
        node = len(self.members)
        self.children.append([])
        if len(numbers) <= LEAF:
            self.members.append(numbers.tolist())
            return node
        # The centroid farthest from the middle sees the others at the most different distances.
        points = self.centroids[numbers]
        at = int(((points - points.mean(0)) ** 2).sum(1).argmax())
        far = np.sqrt(((points - points[at]) ** 2).sum(1).astype(float))
        self.members.append([int(numbers[at])])
        order = [i for i in np.argsort(far, kind="stable").tolist() if i != at]
        half = len(order) // 2
        for part in (order[:half], order[half:]):
            self.children[node].append((self._grow(numbers[part]), float(far[part].min()), float(far[part].max())))
        return node

    def distances(self, vectors: np.ndarray, number: int) -> np.ndarray:
        apart = vectors - self.centroids[number]
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's nearest centroid, ties to the smaller number, and how many
        distances were computed. Every vector follows its own order of nodes; those at one node are computed together."""
        n = len(vectors)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.centroids))
        least = np.full((n, len(self.members)), np.inf)
        least[:, 0] = 0
        active, computed = np.arange(n), 0
        while len(active):
            node = least[active].argmin(1)
            low = least[active, node]
            going = low * (1 - SLACK) <= np.sqrt(best[active].astype(float))
            active, node, low = active[going], node[going], low[going]
            least[active, node] = np.inf
            for t in np.unique(node).tolist():
                rows, floor = active[node == t], low[node == t]
                for c in self.members[t]:
                    d = self.distances(vectors[rows], c)
                    computed += len(rows)
                    nearer = (d < best[rows]) | (d == best[rows]) & (c < who[rows])
                    best[rows[nearer]], who[rows[nearer]] = d[nearer], c
                if self.children[t]:
                    root = np.sqrt(d.astype(float))
                    for child, nearest, farthest in self.children[t]:
                        gap = np.maximum(root - farthest, nearest - root) - SLACK * (root + farthest)
                        least[rows, child] = np.maximum(floor, gap)
            active = active[np.isfinite(least[active].min(1))]
        return who, best, computed


def integer_vectors(vectors: DataFrame, dimensions: int = 64, scale: int = 64, id_column: str = "vec_id",
                    vector: str = "embedding") -> DataFrame:
    """(id, v): the vectors of exactly ``dimensions`` components, none null or non-finite, as floor(scale * component)."""
    x = quoted(vector)
    usable = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.coalesce(usable, F.lit(False))) \
        .select(quoted(id_column).alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(batch: pa.RecordBatch, lo: int) -> np.ndarray:
    column = batch.column("v").slice(lo, BATCH)
    return column.flatten().to_numpy().reshape(len(column), -1)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of "seed:id"; those without id come last, ties by components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors; one without vectors stays."""
    shared = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))
    k, width = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                x = _matrix(batch, lo)
                who = shared.value.nearest(x)[0]
                for c in np.unique(who).tolist():
                    sums[c] += x[who == c].sum(0)
                    counts[c] += np.count_nonzero(who == c)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen]), pa.array(sums[seen].tolist(), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "total"])

    parts = vectors.select("v").mapInArrow(run, "cluster long, n long, total array<long>")
    rows = parts.select("cluster", "n", F.posexplode("total").alias("i", "x")) \
        .groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
    shared.destroy()
    return out


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance): the nearest centroid of each vector and its squared distance."""
    shared = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))
    schema = StructType([vectors.schema["id"], StructField("cluster", IntegerType()), StructField("distance", LongType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                who, best, _ = shared.value.nearest(_matrix(batch, lo))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, BATCH), pa.array(who, pa.int32()), pa.array(best)],
                                                 names=schema.names)

    return vectors.select("id", "v").mapInArrow(run, schema)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dimensions: int = 64, scale: int = 64,
            id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) for each usable vector.

    Vectors of another length, or with a null, NaN or infinite component, and null vectors are left out. Rows
    without id and repeated rows are clustered one by one; fewer usable vectors than ``k`` make fewer centroids, and
    none make an empty result. Ties of distance go to the smaller number. A scaled component beyond LIMIT stops the
    job with a message, as exact squares of it need more than 64 bits. Other columns of the input are not read.
    """
    whole = integer_vectors(vectors, dimensions, scale, id_column, vector)
    refuse = F.raise_error(F.lit(f"a scaled component is beyond {LIMIT}"))
    inside = F.forall("v", lambda c: F.abs(c) <= LIMIT)
    whole = table(whole.select("id", F.when(inside, F.col("v")).otherwise(refuse.cast("array<bigint>")).alias("v")), "vectors")
    spark = whole.sparkSession
    centroids = first_centroids(whole, k, seed)
    result = "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    if not len(centroids):
        none = spark.createDataFrame([], result)
        return whole.select("id", F.lit(0).cast("long").alias("distance"), F.lit(0).alias("cluster")).join(F.broadcast(none), "cluster") \
            .select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
    for _ in range(rounds):
        centroids = moved(whole, centroids)
    last = table(assign(whole, centroids), "assigned")
    inertia = {r["cluster"]: int(r["x"]) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    every = sum(inertia.values())
    # One row for each centroid: no larger than ``k``.
    facts = spark.createDataFrame([(c, x, every, centroids[c].tolist(), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
                                   for c, x in sorted(inertia.items())], result)
    return last.join(F.broadcast(facts), "cluster") \
        .select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
