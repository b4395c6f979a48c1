"""Approximate nearest neighbours with a forest of random-projection trees.

Vectors are dealt into shards by a hash, and each shard builds one forest and is written
with it: every node splits its vectors at the median of their products with a random
direction, level by level, until about ``LEAF`` are left. Queries meet a shard in blocks.
All trees of a forest share one priority queue: a leaf's priority is the sum of the
squared margins by which the query lies on the other side of the planes above it. As a
priority never falls on the way down, popping the queue visits leaves in the order of
their priorities, so the order of a whole block of queries comes from one pass over the
levels. Each leaf is then scored once against all queries of the block that visit it, by
one matrix product; what beats a query's ``k``-th best so far is a candidate, and the best
candidates are ranked by their exact products in double precision. The best of all shards
are the answer.

How many leaves a query visits is measured, not set: when a shard builds its forest, up to
``TRIALS`` of its own vectors are searched by brute force in that shard, and the number of
leaves is the least with which ``RECALL`` of their ``k`` nearest are found. Vectors with
structure need few leaves. Vectors without any (evenly spread directions) have no shortcut
in many dimensions and need most of a shard; the README has figures.

Every shard's vectors meet every query once, which the search itself asks for: a shard is
copied once for each ``BLOCK_BYTES`` of queries, and a group holds one shard and one block,
whatever the input. Equal vectors are indexed once with the smallest ids they have, as many
as an answer can hold, so a very common vector is neither a hot group nor a full leaf.

Nearness is the largest inner product. Splits look at directions only, which suits
vectors of about equal length; every candidate is scored on the original vectors.

Defined cases: null or zero vectors, and vectors with null or non-finite components or of
another dimension than the most common one, take no part, and so do null ids; ties go to
the smaller id; repeated rows (same id and vector) count once; with fewer candidates than
``k`` all are returned; an empty table gives an empty result; only the two columns named
are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.llm.shared import cut

#: Bytes of vectors in a shard and of queries in a block, as doubles.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 8 << 20
TREES, LEAF = 16, 192
#: Share of the nearest that a shard's trials must find, and the number of trials.
RECALL, TRIALS = 0.95, 256
#: Queries searched at once.
PART = 1024


class Forest:
    """Random-projection trees over the rows of ``unit`` (directions), all of one depth."""

    def __init__(self, planes: np.ndarray, offsets: np.ndarray, leaf_of: np.ndarray, visits: int = 1):
        self.planes, self.offsets, self.leaf_of, self.visits = planes, offsets, leaf_of, visits
        self.trees, self.leaves = len(leaf_of), planes.shape[1] + 1

    @classmethod
    def grow(cls, unit: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 0) -> Forest:
        n, d = unit.shape
        depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
        rng = np.random.default_rng(seed)
        planes = rng.standard_normal((trees, (1 << depth) - 1, d)).astype(np.float32)
        planes /= np.linalg.norm(planes, axis=2, keepdims=True)
        offsets = np.zeros(planes.shape[:2], np.float32)
        leaf_of = np.zeros((trees, n), np.int32)
        unit = unit.astype(np.float32)
        for t in range(trees):
            groups = [np.arange(n)]
            for level in range(depth):
                parts = []
                for j, rows in enumerate(groups):
                    node = (1 << level) - 1 + j
                    at, half = unit[rows] @ planes[t, node], len(rows) // 2
                    if half:
                        order = np.argpartition(at, half)
                        offsets[t, node] = (at[order[:half]].max() + at[order[half]]) / 2
                        parts += [rows[order[:half]], rows[order[half:]]]
                    else:
                        parts += [rows[:0], rows]
                groups = parts
            for j, rows in enumerate(groups):
                leaf_of[t, rows] = j
        return cls(planes, offsets, leaf_of)

    def order(self, unit: np.ndarray) -> np.ndarray:
        """Leaves of all trees (tree * leaves + leaf) for each query, in the order in which the queue gives them."""
        q = len(unit)
        margin = (unit.astype(np.float32) @ self.planes.reshape(-1, self.planes.shape[2]).T).reshape(q, self.trees, self.leaves - 1) - self.offsets
        cost = np.zeros((q, self.trees, 1), np.float32)
        width = 1
        while width < self.leaves:
            m = margin[:, :, width - 1 : 2 * width - 1]
            below = np.empty((q, self.trees, 2 * width), np.float32)
            below[:, :, 0::2] = cost + np.square(np.maximum(m, 0))
            below[:, :, 1::2] = cost + np.square(np.minimum(m, 0))
            cost, width = below, 2 * width
        return np.argsort(cost.reshape(q, -1), axis=1, kind="stable").astype(np.int32)

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all leaves, one leaf after the other, and where each leaf begins (with the end)."""
        key = (self.leaf_of + np.arange(self.trees, dtype=np.int32)[:, None] * self.leaves).ravel()
        order = np.argsort(key, kind="stable")
        return order % self.leaf_of.shape[1], np.concatenate(([0], np.cumsum(np.bincount(key, minlength=self.trees * self.leaves))))

    def calibrate(self, data: np.ndarray, unit: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS) -> float:
        """Sets ``visits`` to the least with which the first ``trials`` rows find ``recall`` of their ``k`` nearest; returns that recall.

        Rows stand in the order of a hash, so the first ones are a random sample.
        """
        some = min(trials, len(data))
        score = data[:some] @ data.T
        score[np.arange(some), np.arange(some)] = -np.inf
        k = min(k, len(data) - 1)
        if k < 1:
            return 1.0
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        order = self.order(unit[:some])
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1], dtype=np.int32), order.shape), axis=1)
        # the first visit that meets each neighbour, in whichever tree
        first = np.full(near.shape, order.shape[1], np.int32)
        for t in range(self.trees):
            first = np.minimum(first, np.take_along_axis(place, t * self.leaves + self.leaf_of[t][near], axis=1))
        ranked = np.sort(first.ravel())
        self.visits = int(ranked[min(len(ranked), int(np.ceil(recall * len(ranked)))) - 1]) + 1
        return float((first < self.visits).mean())

    def search(self, asks: np.ndarray, ask_unit: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, exact score) of the ``k`` best rows in the leaves that each query visits, and of rows equal to the last."""
        rows, begin = self.members()
        found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for lo in range(0, len(asks), PART):
            q, r = self._part(asks[lo : lo + PART], ask_unit[lo : lo + PART], data, k, rows, begin)
            # one order of summation for all, so equal pairs have equal scores wherever they are met
            exact = (data[r] * asks[lo + q]).sum(axis=1)
            for to, x in zip(found, (lo + q, r, exact), strict=True):
                to.append(x)
        return tuple(np.concatenate(x) for x in found)

    def _part(self, asks: np.ndarray, ask_unit: np.ndarray, data: np.ndarray, k: int, rows: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = self.order(ask_unit)[:, : self.visits]
        held = np.empty(0, np.int64), np.empty(0)  # query * rows + row, score
        least = np.full(len(asks), -np.inf)
        n, lo, step = len(data), 0, 4
        # the nearest leaves first: after them few rows beat what is held
        while lo < self.visits:
            visit = order[:, lo : lo + step]
            leaf, who = visit.ravel(), np.repeat(np.arange(len(asks)), visit.shape[1])
            by = np.argsort(leaf, kind="stable")
            leaf, who = leaf[by], who[by]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(leaf)) + 1, [len(leaf)]))
            keys, scores = [held[0]], [held[1]]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                q, r = who[a:b], rows[begin[leaf[a]] : begin[leaf[a] + 1]]
                score = asks[q] @ data[r].T
                i, j = np.nonzero(score >= least[q, None])
                keys.append(q[i] * n + r[j])
                scores.append(score[i, j])
            held = self._best(np.concatenate(keys), np.concatenate(scores), k, n)
            owner = held[0] // n
            ends = np.flatnonzero(np.concatenate((np.diff(owner) != 0, [True]))) if len(owner) else np.empty(0, np.int64)
            full = ends[np.diff(np.concatenate(([-1], ends))) >= k]
            # the room for rounding is far below any difference that could matter
            least[owner[full]] = held[1][full] - 1e-9 * np.maximum(1.0, np.abs(held[1][full]))
            lo, step = lo + step, 2 * step
        return held[0] // n, held[0] % n

    @staticmethod
    def _best(key: np.ndarray, score: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each query's distinct rows the ``k`` best and those about equal to the last, by query and falling score."""
        _, once = np.unique(key, return_index=True)
        key, score = key[once], score[once]
        by = np.lexsort((-score, key // n))
        key, score = key[by], score[by]
        q = key // n
        start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, np.int64)
        size = np.diff(np.concatenate((start, [len(q)])))
        last = score[np.minimum(start + k, start + size) - 1]
        keep = score >= np.repeat(last - 1e-9 * np.maximum(1.0, np.abs(last)), size)
        return key[keep], score[keep]

    def scanned(self, ask_unit: np.ndarray) -> float:
        """The share of all rows that the queries look at."""
        rows, begin = self.members()
        share = []
        for o in self.order(ask_unit)[:, : self.visits]:
            seen = np.zeros(self.leaf_of.shape[1], bool)
            for x in o.tolist():
                seen[rows[begin[x] : begin[x + 1]]] = True
            share.append(seen.mean())
        return float(np.mean(share))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    df = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return df.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))


SHARD_SCHEMA = "s int, n int, visits int, vectors binary, planes binary, offsets binary, leaf_of binary, ids array<array<long>>"


def _build(k: int, seed: int):
    """A function that turns one shard's vectors into one row with its forest."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["f1", "f2"], kind="stable")
        data = np.stack(pdf["v"].to_numpy())
        unit = _unit(data)
        forest = Forest.grow(unit, seed=seed)
        forest.calibrate(data, unit, k)
        row = (int(pdf["s"].iloc[0]), len(data), forest.visits, data.tobytes(), forest.planes.tobytes(), forest.offsets.tobytes(), forest.leaf_of.tobytes(), pdf["ids"].tolist())
        return pd.DataFrame([row], columns=[c.split()[0] for c in SHARD_SCHEMA.split(", ")])

    return build


def nearest(df: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", shard: int | None = None, block: int | None = None, seed: int = 0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best found for each row that ``is_query`` (a condition on ``id``) holds for.

    ``shard`` and ``block`` are numbers of vectors; by default they follow from ``SHARD_BYTES``
    and ``BLOCK_BYTES``. One pass counts vectors and queries, which sets the numbers of both.
    """
    rows = _usable(df, vec_id, vector)
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = size["d"]
    shard, block = shard or max(1, SHARD_BYTES // (8 * d)), block or max(1, BLOCK_BYTES // (8 * d))
    rows = rows.where(F.size("v") == F.lit(d)).withColumns({"f1": F.xxhash64("v"), "f2": F.xxhash64(F.lit(7), "v")})
    # repeated rows leave first, so that they do not take the places of other ids
    rows = rows.dropDuplicates(["id", "f1", "f2"])
    per_vector = Window.partitionBy("f1", "f2").orderBy("id")
    # the k + 1 smallest ids of each vector; Spark cuts before the shuffle as well
    few = rows.withColumn("r", F.row_number().over(per_vector)).where(F.col("r") <= k + 1).groupBy("f1", "f2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("v", "id").alias("v"))
    index = cut(few, "vectors")
    asked = rows.where(is_query).select("id", "f1", "f2")
    wanted = asked.select("f1", "f2").distinct()
    queries = cut(index.join(wanted, ["f1", "f2"], "left_semi").select("f1", "f2", "v"), "queries")
    shards = max(1, -(-index.count() // shard))
    blocks = max(1, -(-queries.count() // block))
    dealt = index.withColumn("s", F.pmod(F.xxhash64("f1", F.lit(1)), F.lit(shards)).cast("int"))
    # each shard's forest is grown once and written with its vectors
    forests = cut(dealt.groupBy("s").applyInPandas(_build(k, seed), SHARD_SCHEMA), "forests")
    side = forests.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ask = queries.withColumn("b", F.pmod(F.xxhash64("f1", F.lit(2)), F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search_pair(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("f1", "int64"), ("f2", "int64"), ("found", "object"))})
        x = x.iloc[0]
        data = np.frombuffer(x["vectors"]).reshape(x["n"], d)
        offsets = np.frombuffer(x["offsets"], np.float32).reshape(TREES, -1)
        forest = Forest(np.frombuffer(x["planes"], np.float32).reshape(TREES, -1, d), offsets, np.frombuffer(x["leaf_of"], np.int32).reshape(TREES, -1), int(x["visits"]))
        asks = np.stack(q["v"].to_numpy())
        who, row, score = forest.search(asks, _unit(asks), data, k + 1)
        ids = [np.asarray(i, np.int64) for i in x["ids"]]
        count = np.asarray([len(ids[r]) for r in row.tolist()], np.int64)
        vec = np.concatenate([ids[r] for r in row.tolist()]) if len(row) else np.empty(0, np.int64)
        who, score = np.repeat(who, count), np.repeat(score, count)
        by = np.lexsort((vec, -score, who))
        who, score, vec = who[by], score[by], vec[by]
        start = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.empty(0, np.int64)
        ends = np.concatenate((start[1:], [len(who)]))
        found = [[{"less": -s, "vec_id": v} for s, v in zip(score[a:e].tolist(), vec[a:e].tolist(), strict=True)] for a, e in zip(start.tolist(), np.minimum(ends, start + k + 1).tolist(), strict=True)]
        of = who[start]
        return pd.DataFrame({"f1": q["f1"].to_numpy()[of], "f2": q["f2"].to_numpy()[of], "found": found})

    pairs = ask.groupBy("b", "s").cogroup(side.groupBy("b", "s")).applyInPandas(search_pair, "f1 long, f2 long, found array<struct<less: double, vec_id: long>>")
    best = pairs.select("f1", "f2", F.explode("found").alias("x")).select("f1", "f2", "x.*")
    ranked = Window.partitionBy("f1", "f2").orderBy("less", "vec_id")
    best = best.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1)
    best = cut(best.groupBy("f1", "f2").agg(F.array_sort(F.collect_list(F.struct("less", "vec_id"))).alias("found")), "best")
    # every query of the same vector has the vector's answers but itself; one row a vector, so AQE can split a common one
    each = asked.join(best, ["f1", "f2"]).select("id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k).alias("found"))
    return each.select(F.col("id").alias("query_id"), F.posexplode("found").alias("r", "x")).select("query_id", (F.col("r") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
