"""Centroid clustering of integer-scaled vectors, exact to the last bit.

A vector's components become integers ``floor(scale * x)``. They are kept as packed blocks
of floats that hold such integers exactly, in a written table that every round reads.
Distances come from ``|x|^2 - 2 x.c + |c|^2`` with one matrix product a block. With M the
largest magnitude in a row and C that of the centroids, no partial sum of that expansion
exceeds ``dim * (M + C)^2``; rows for which this stays within 2^53 are exact in float64,
whatever the order in which BLAS adds. Other rows are computed in 64-bit integers, or in
Python's where those could overflow too. Sums of a round are combined by
``RDD.treeAggregate`` as exact integers, so the driver gets one table of k sums and counts
a round, whatever the input.

Defined cases: null vectors, vectors of another length and those with a null or non-finite
component (or one whose scaled value is not finite) take no part. Repeated rows are separate
vectors. The first centroids are the k rows with the smallest hash of their id; rows with
equal ids come in the order of their components, and a null id hashes like an empty one.
With fewer rows than k there are as many centroids as rows; an empty table gives an empty
result. Ties in distance go to the smaller number, empty centroids stay where they are. A
distance or inertia beyond 64 bits is null. Columns other than id and vector are left out,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.llm.shared import cut

#: Vectors in a block; bounds within which float64 and int64 are exact; integers that float32 holds.
BLOCK, EXACT, WIDE, SHORT = 4096, 1 << 53, (1 << 63) - 1, 1 << 24
Centroids = list[list[int]]


@dataclass(frozen=True)
class Sums:
    """Of each centroid: how many vectors it has, their componentwise sums and the sum of their distances."""

    counts: list[int]
    sums: np.ndarray
    inertia: list[int]

    def __add__(self, other: Sums) -> Sums:
        counts = [a + b for a, b in zip(self.counts, other.counts, strict=True)]
        return Sums(counts, self.sums + other.sums, [a + b for a, b in zip(self.inertia, other.inertia, strict=True)])

    def moved(self, centroids: Centroids) -> Centroids:
        """The next centroids: floors of the means, the old one where there is no vector."""
        return [[int(s) // n for s in row] if n else old for n, row, old in zip(self.counts, self.sums, centroids, strict=True)]


def exact_integers(values: np.ndarray) -> np.ndarray:
    """Python integers of a float array that holds integers."""
    return np.array([int(v) for v in values.ravel().tolist()], object).reshape(values.shape)


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid; ``x`` holds integers as float64.

    Distances are int64, or Python integers if one of them is beyond.
    """
    dim = x.shape[1]
    at, dist = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    far = max(abs(v) for c in centroids for v in c)
    top = np.abs(x).max(axis=1, initial=0)
    floats, longs = (top <= float(isqrt(bound // dim) - far) for bound in (EXACT, WIDE))
    if floats.any():
        part, c = x[floats], np.array(centroids, np.float64)
        d = (part * part).sum(axis=1)[:, None] - 2.0 * (part @ c.T) + (c * c).sum(axis=1)
        at[floats], dist[floats] = d.argmin(axis=1), d.min(axis=1)
    for rows, kind in ((longs & ~floats, np.int64), (~longs, object)):
        if rows.any():
            part = exact_integers(x[rows]).astype(kind)
            d = np.stack([((part - c) ** 2).sum(axis=1) for c in np.array(centroids, object).astype(kind)], axis=1)
            found = d.min(axis=1)
            if max(found) > WIDE:
                dist = dist.astype(object)
            at[rows], dist[rows] = d.argmin(axis=1), found
    return at, dist


def summed(x: np.ndarray, centroids: Centroids) -> Sums:
    """The sums of one block of vectors."""
    at, dist = nearest(x, centroids)
    k = len(centroids)
    if x.size * float(np.abs(x).max(initial=0)) < EXACT:
        sums = exact_integers((at == np.arange(k)[:, None]).astype(np.float64) @ x)
    else:
        whole = exact_integers(x)
        sums = np.stack([whole[at == j].sum(axis=0) + np.zeros(x.shape[1], object) for j in range(k)])
    return Sums(np.bincount(at, minlength=k).tolist(), sums, [sum(dist[at == j].tolist()) for j in range(k)])


def scaled(df: DataFrame, vec_id: str, vector: str, dim: int, scale: float) -> DataFrame:
    """``id, v``: the vectors that take part, times ``scale``."""
    v = F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: x * float(scale))
    bounded = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))  # noqa: E731  NaN counts as larger than infinity
    return df.select(F.col(f"`{vec_id}`").alias("id"), v.alias("v")).where((F.size("v") == dim) & F.forall("v", bounded))


def blocks(vectors: DataFrame) -> DataFrame:
    """``ids, x, n``: up to :data:`BLOCK` vectors a row, their integers as float32 where those are exact."""
    id_type = vectors.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                x, ids = np.floor(part.column("v").flatten().to_numpy(zero_copy_only=False)), part.column("id")
                x = x.astype(np.float32) if np.abs(x).max(initial=0) <= SHORT else x
                held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([held, pa.array([x.tobytes()], pa.binary()), pa.array([len(ids)], pa.int32())], ["ids", "x", "n"])

    return vectors.mapInArrow(pack, f"ids array<{id_type}>, x binary, n int")


def cluster(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024.0, seed: str = "3") -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid`` of every vector that takes part.

    ``rounds`` times, every vector goes to its nearest centroid and every centroid to the
    floor of its vectors' mean; then vectors are assigned once more. Rounds after one that
    moves nothing are left out, as they would move nothing either. ``centroid`` lists the
    final centroid's components in decimal.
    """
    vectors = scaled(df, vec_id, vector, dim, scale)
    id_type = vectors.schema["id"].dataType.simpleString()
    out = f"id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid string"
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    firsts = vectors.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()  # k rows, a parameter
    if not firsts:
        return df.sparkSession.createDataFrame([], out)
    centroids = [[int(np.floor(x)) for x in row["v"]] for row in firsts]
    packed = cut(blocks(vectors), "vector-blocks")

    def unpack(x: bytes, n: int) -> np.ndarray:
        return np.frombuffer(x, np.float32 if len(x) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)

    def totals(centroids: Centroids) -> Sums:
        none = Sums([0] * len(centroids), np.zeros((len(centroids), dim), object), [0] * len(centroids))
        return packed.select("x", "n").rdd.treeAggregate(none, lambda s, row: s + summed(unpack(row["x"], row["n"]), centroids), lambda a, b: a + b)

    for _ in range(rounds):
        after = totals(centroids).moved(centroids)
        if after == centroids:
            break
        centroids = after
    inertia = totals(centroids).inertia
    final, written = centroids, [",".join(map(str, c)) for c in centroids]
    long = lambda v: v if v <= WIDE else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x, n in zip(batch.column("ids"), batch.column("x"), batch.column("n"), strict=True):
                at, dist = nearest(unpack(x.as_py(), n.as_py()), final)
                columns = [
                    ids.values,
                    pa.array(at, pa.int32()),
                    pa.array([long(d) for d in dist.tolist()], pa.int64()),
                    pa.array([long(inertia[j]) for j in at.tolist()], pa.int64()),
                    pa.array([long(sum(inertia))] * len(at), pa.int64()),
                    pa.array(written).take(pa.array(at)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return packed.mapInArrow(assign, out)
