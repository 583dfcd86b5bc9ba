"""Centroid clustering of integer vectors by bit planes (operator 11).

A vector has 64 integer components. Bit i of all of them is one 64-bit number, its plane i; the highest plane holds the
signs (two's complement). The dot product of two vectors is the sum over pairs of planes of the weighted popcount of
their AND, exactly, and so are squared distances. The sum of a cluster's vectors follows from how often each bit is set.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmill.llm.text import extended
from boxmill.session import write_table

COMPONENTS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3

# Up to so many planes on both sides, 64-bit numbers hold every distance; beyond it, Python's integers do.
NARROW = 28
# Doubles below this are exact integers after scaling and fit 64 bits.
SAFE = 2.0**52
LARGEST = (1 << 63) - 1

# Rows worked on at once inside a task.
AT_ONCE = 8192


def usable(embedding: Column) -> Column:
    """Whether a vector has exactly 64 components, none of them null, NaN or infinite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(embedding) == COMPONENTS) & F.forall(embedding.cast("array<double>"), fine), F.lit(False))


def scaled(values: np.ndarray) -> np.ndarray:
    """``floor(1024 * x)`` of doubles as 64-bit integers, or as Python's where one does not fit."""
    if (np.abs(values) < SAFE / SCALE).all():
        return np.floor(values * SCALE).astype(np.int64)
    # A product with a power of two is exact, and above 2 ** 53 a double is an integer.
    exact = [math.floor(x * SCALE) if abs(x) < 2.0**1000 else int(x) * SCALE for x in values.ravel().tolist()]
    found = np.empty(values.size, object)
    found[:] = exact
    return found.reshape(values.shape)


def plane_count(vectors: np.ndarray) -> np.ndarray:
    """How many planes each row needs, the signs included."""
    size = np.where(vectors < 0, -1 - vectors, vectors).max(axis=1)
    if vectors.dtype == object:
        return np.array([int(x).bit_length() + 1 for x in size], np.int64)
    return np.frexp(size.astype(np.float64))[1].astype(np.int64) + 1


def planes_of(vectors: np.ndarray, count: int) -> np.ndarray:
    """Planes 0 to ``count - 1`` of each row as unsigned numbers; component k is bit k."""
    found = np.empty((len(vectors), count), np.uint64)
    for k in range(count):
        bits = ((vectors >> k) & 1).astype(np.uint8)
        found[:, k] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return found


def weights(count: int) -> list[int]:
    """The weight of each plane; the highest one counts against the others."""
    return [1 << k for k in range(count - 1)] + [-(1 << (count - 1))]


def bits_of(plane: np.ndarray) -> np.ndarray:
    """The 64 bits of each number as a row of zeros and ones."""
    return np.unpackbits(np.ascontiguousarray(plane).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def vectors_of(planes: np.ndarray) -> list[list[int]]:
    """The components, as Python's integers, of rows that have all their planes."""
    total = np.zeros((len(planes), COMPONENTS), object)
    for weight, plane in zip(weights(planes.shape[1]), planes.T):
        total = total + weight * bits_of(plane).astype(object)
    return total.tolist()


def dot_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All dot products of the rows of two plane tables, by popcounts of pairs of planes."""
    narrow = max(left.shape[1], right.shape[1]) <= NARROW
    found = np.zeros((len(left), len(right)), np.int64 if narrow else object)
    for a, plane in zip(weights(left.shape[1]), left.T):
        # Popcounts of one plane with all of the other side's, weighed by these first.
        sums = np.zeros(found.shape, found.dtype)
        for b, other in zip(weights(right.shape[1]), right.T):
            ones = np.bitwise_count(plane[:, None] & other[None, :])
            sums += ones.astype(np.int64) * b if narrow else ones.astype(object) * b
        found += sums * a
    return found


class Centroids:
    """Integer centroids, numbered from 0, as planes."""

    def __init__(self, vectors: list[list[int]]):
        self.vectors = vectors
        exact = np.empty((len(vectors), COMPONENTS), object)
        for k, vector in enumerate(vectors):
            exact[k, :] = vector
        self.planes = planes_of(exact, int(plane_count(exact).max()))
        self.norms = [sum(x * x for x in v) for v in vectors]

    def nearest(self, planes: np.ndarray, norms: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid (the smaller one of equally near ones) and the squared distance."""
        dots = dot_products(planes, self.planes)
        if norms is None or dots.dtype == object:
            norms = np.array([sum(x * x for x in v) for v in vectors_of(planes)], object)
        own = np.array(self.norms, dots.dtype)
        distance = norms[:, None].astype(dots.dtype) - 2 * dots + own[None, :]
        cluster = np.argmin(distance, axis=1)
        return cluster, distance[np.arange(len(cluster)), cluster]

    def digest(self, number: int) -> str:
        return hashlib.sha256(",".join(map(str, self.vectors[number])).encode()).hexdigest()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(k, AT_ONCE)
            column = part.column("embedding")
            vectors = scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS))
            counts = plane_count(vectors)
            ends = np.cumsum(counts)
            flat, norms = np.empty(int(ends[-1]), np.int64), np.zeros(len(counts), np.int64)
            for count in np.unique(counts).tolist():
                mine = np.flatnonzero(counts == count)
                places = (ends[mine] - count)[:, None] + np.arange(count)
                flat[places] = planes_of(vectors[mine], count).view(np.int64)
                if count <= NARROW:
                    norms[mine] = (vectors[mine].astype(np.int64) ** 2).sum(axis=1)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            planes = pa.ListArray.from_arrays(offsets, pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), planes, pa.array(norms)], names=["vec_id", "planes", "norm"])


def packed(embeddings: DataFrame) -> DataFrame:
    """``vec_id, planes, norm`` of the usable vectors; ``norm`` counts only for up to NARROW planes."""
    rows = embeddings.where(usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_packed, extended(rows.select("vec_id").schema, {"planes": "array<long>", "norm": "long"}))


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Row numbers, planes and norms of the rows of a batch that have the same number of planes, block by block."""
    for k in range(0, batch.num_rows, AT_ONCE):
        part = batch.slice(k, AT_ONCE)
        column = part.column("planes")
        counts = np.diff(column.offsets.to_numpy())
        starts = np.cumsum(counts) - counts
        flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        norms = part.column("norm").to_numpy(zero_copy_only=False)
        for count in np.unique(counts).tolist():
            mine = np.flatnonzero(counts == count)
            yield mine + k, flat[starts[mine][:, None] + np.arange(count)], norms[mine] if count <= NARROW else None


def seeds(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id, those without an id last; equal hashes go by planes."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(drawn.asc_nulls_last(), "planes").limit(clusters).select("planes").collect()
    return [vectors_of(np.array([r["planes"]], np.int64).view(np.uint64))[0] for r in rows]


def sums(vectors: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int]]]:
    """Size and exact component sums of each cluster that has vectors.

    A task counts set bits per cluster and plane, so it sends on a few rows however many vectors it reads.
    """
    clusters = len(centroids.vectors)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[tuple[int, bool], np.ndarray] = {}
        ones: dict[tuple[int, bool], np.ndarray] = {}
        for batch in batches:
            for _, planes, norms in _by_width(batch):
                cluster, _ = centroids.nearest(planes, norms)
                mine = (cluster[None, :] == np.arange(clusters)[:, None]).astype(np.float32)
                for k, plane in enumerate(planes.T):
                    key = (k, k == planes.shape[1] - 1)
                    # At most AT_ONCE ones are added up, which single precision holds exactly.
                    found = (mine @ bits_of(plane).astype(np.float32)).astype(np.int64)
                    ones[key] = ones.get(key, 0) + found
                    sizes[key] = sizes.get(key, 0) + mine.sum(axis=1).astype(np.int64)
        rows = [(c, k, top, sizes[k, top][c], ones[k, top][c].tolist()) for k, top in ones for c in range(clusters) if sizes[k, top][c]]
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["cluster", "plane", "top", "n", "ones"])

    found = vectors.mapInArrow(counted, "cluster int, plane int, top boolean, n long, ones array<long>")
    added = F.array(*(F.sum(F.col("ones")[k]) for k in range(COMPONENTS))).alias("ones")
    # Every vector has one lowest plane, so these rows give the sizes; a row per cluster and plane comes to the driver.
    rows = found.groupBy("cluster", "plane", "top").agg(F.sum("n").alias("n"), added).collect()
    totals: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        size, total = totals.get(r["cluster"], (0, [0] * COMPONENTS))
        weight = -(1 << r["plane"]) if r["top"] else 1 << r["plane"]
        totals[r["cluster"]] = (size + (r["n"] if r["plane"] == 0 else 0), [a + weight * b for a, b in zip(total, r["ones"])])
    return totals


def clustered(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED
) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every usable vector after the given rounds, and the final centroids.

    Vectors that are null, have another length or a component that is null, NaN or infinite are left out. Repeated rows are
    vectors of their own; a null ``vec_id`` stays, but is drawn last as a start. With fewer vectors than clusters there are fewer
    centroids, and an empty table gives an empty result without any. Components of any finite size are exact;
    a squared distance beyond the largest long is given as that. Other columns are not read.
    """
    vectors = write_table(packed(embeddings), "planes")
    found = seeds(vectors, clusters, seed)
    schema = extended(vectors.select("vec_id").schema, {"cluster": "int", "distance": "long"})
    if not found:
        return vectors.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        for number, (size, total) in sums(vectors, Centroids(found)).items():
            found[number] = [x // size for x in total]
    final = Centroids(found)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for rows, planes, norms in _by_width(batch):
                cluster[rows], exact = final.nearest(planes, norms)
                distance[rows] = np.minimum(exact, LARGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(assigned, schema), found


def with_inertia(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` (at most the largest long) and ``centroid_sha256`` to clustered rows."""
    rows = write_table(rows, "clustered")
    totals = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    every = min(sum(int(r["total"]) for r in totals), LARGEST)
    digests = Centroids(centroids).digest if centroids else None
    # A row per cluster.
    listed = [(r["cluster"], min(int(r["total"]), LARGEST), every, digests(r["cluster"])) for r in totals]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(listed, schema)), "cluster")
