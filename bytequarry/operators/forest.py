"""Random forests for binary targets whose trees are grown, kept and asked in tasks.

The rule is that of Spark's RandomForestClassifier: Poisson draws of the rows for each tree,
features binned by quantiles, a random subset of the features at each node, splits by Gini
impurity with class weights until a node is pure, has no gain or is as deep as allowed; then
leaves beside each other that decide alike are merged. A row's probability is the mean over
the trees of its leaf's share of class 1.

Spark's forest keeps all nodes of all trees on the driver, and full trees have about as many
nodes as rows. Here the driver has the nodes of more than ``Settings.rows`` draws only (or of
more than a 64th of a label's rows): those are split by counts summed up over packed blocks of
rows, the nodes of all trees and labels in the same pass, and the driver gets the splits. What
a tree has drawn below them is dealt out by node, and a task grows what stands below a node
to its end. The trees are a written table. To ask them, blocks of rows and groups of trees
meet in a task by shuffle, so neither is broadcast.

Draws and subsets of features follow from hashes of the row and of the place in the tree, and
draws are counted as integers. So the result depends neither on how rows lie in partitions nor on which
nodes are split where. Rows of one id and equal features are drawn alike. A gain of up to
1e-12 counts as none, as it may be a rounding error.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.operators.order import exact_quantiles
from bytequarry.operators.steps import dropped, written

#: Rows of a block to fit on and of one to score, and rows that a task scores by a group of trees.
BLOCK, ASKED, TOGETHER = 8192, 1 << 16, 1 << 22
#: Trees in a group that scores together, cells of histograms worked on at once (they fit a core's cache).
GROUP, CELLS = 10, 1 << 15
LEAF = 255
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
_GOLDEN = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Settings:
    trees: int = 300
    depth: int = 30
    bins: int = 32
    seed: int = 7
    bootstrap: bool = True
    #: Draws of a node up to which one task grows all that stands below it.
    rows: int = 1 << 18

    def features(self, width: int) -> int:
        """Features looked at in a node."""
        return width if self.trees == 1 else math.ceil(math.sqrt(width))


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def root(settings: Settings, tree: int) -> np.ndarray:
    """The key of a tree's first node."""
    return mixed(np.array([(settings.seed * 1_000_003 + tree + 1) * _GOLDEN & (1 << 64) - 1], np.uint64))


def below(keys: np.ndarray) -> np.ndarray:
    """Keys of the children of nodes, left and right by turns."""
    return mixed((keys[:, None] ^ np.array([1, 2], np.uint64)) * np.uint64(_GOLDEN)).reshape(-1)


def draws(rows: np.ndarray, settings: Settings, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    if not settings.bootstrap:
        return np.ones(len(rows), np.uint8)
    u = mixed(rows ^ mixed(~root(settings, tree))) >> np.uint64(11)
    return np.searchsorted(_POISSON, u * 2.0**-53, side="right").astype(np.uint8)


def looked_at(keys: np.ndarray, width: int, settings: Settings) -> np.ndarray:
    """The features that each node looks at, in ascending order."""
    if (m := settings.features(width)) == width:
        return np.broadcast_to(np.arange(width), (len(keys), width))
    order = mixed(keys[:, None] + np.arange(3, width + 3, dtype=np.uint64) * np.uint64(_GOLDEN))
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :m], axis=1)


def histogram(bins: np.ndarray, y: np.ndarray, c: np.ndarray, slot: np.ndarray, looked: np.ndarray, n_bins: int) -> np.ndarray:
    """Draws by (node, feature looked at, bin, class); ``slot`` has each row's node."""
    k, m = looked.shape
    place = np.arange(len(bins))[:, None] * bins.shape[1] + looked[slot]
    cell = ((slot[:, None] * m + np.arange(m)) * n_bins + bins.reshape(-1)[place]) * 2 + y[:, None]
    return np.bincount(cell.reshape(-1), np.repeat(c, m), k * m * n_bins * 2).reshape(k, m, n_bins, 2)


def best_splits(hist: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node: the best split's gain (or 0), which feature of those looked at, the last bin that goes left, and the draws there.

    Of equal gains the first feature and bin count.
    """
    k, _, n_bins, _ = hist.shape
    left = hist.cumsum(axis=2)
    whole = left[:, :1, -1:]
    right = whole - left
    l0, l1, r0, r1 = (side[..., i] * weights[i] for side in (left, right) for i in (0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        # a node's Gini impurity times its weight is twice this
        apart = l0 * l1 / (l0 + l1) + r0 * r1 / (r0 + r1)
    apart = np.where(np.isnan(apart), np.inf, apart).reshape(k, -1)  # nothing on one side
    at = apart.argmin(axis=1)
    node = np.arange(k)
    a, b = whole[:, 0, 0, 0] * weights[0], whole[:, 0, 0, 1] * weights[1]
    gain = 2 * (a * b / (a + b) - apart[node, at]) / (a + b)
    q, last = np.divmod(at, n_bins)
    return np.where(gain > 1e-12, gain, 0.0), q, last, left[node, q, last].astype(np.int64)


@dataclass
class Tree:
    """Nodes, a split's children beside each other: feature (or :data:`LEAF`), last bin that goes left, left child, draws of both classes."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    counts: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(bins), np.int32)
        flat, width = np.ascontiguousarray(bins).reshape(-1), bins.shape[1]
        rows = np.arange(len(bins) if self.feature[0] != LEAF else 0)
        k, f = at[rows], self.feature[at[rows]]
        while len(rows):
            k = self.left[k] + (flat[rows * width + f] > self.bin[k])
            f = self.feature[k]
            done = f == LEAF
            if done.any():
                at[rows[done]] = k[done]
                on = np.flatnonzero(~done)
                rows, k, f = rows[on], k[on], f[on]
        return at


def grow(bins: np.ndarray, y: np.ndarray, c: np.ndarray, key: np.ndarray, depth: int, settings: Settings, weights: tuple[float, float]) -> Tree:
    """What stands below one node with rows, level by level; ``c`` has the draws, ``depth`` that of the node."""
    width = bins.shape[1]
    blank = lambda counts: [np.full(len(counts), LEAF, np.uint8), np.zeros(len(counts), np.uint8), np.zeros(len(counts), np.int32), counts]
    levels = [blank(np.array([[c[y == 0].sum(dtype=np.int64), c[y == 1].sum(dtype=np.int64)]]))]
    total, ids, keys, slot = 1, np.arange(1), key, np.zeros(len(bins), np.int64)
    if not levels[0][3].all() or depth >= settings.depth:
        ids = ids[:0]
    many = max(1, CELLS // (settings.features(width) * settings.bins))
    while len(ids):
        # rows are in the order of their nodes
        starts = np.searchsorted(slot, np.arange(len(ids) + 1))
        found = []
        for lo in range(0, len(ids), many):
            hi = min(lo + many, len(ids))
            looked, r = looked_at(keys[lo:hi], width, settings), slice(starts[lo], starts[hi])
            gain, q, last, left = best_splits(histogram(bins[r], y[r], c[r], slot[r] - lo, looked, settings.bins), weights)
            found.append((gain, looked[np.arange(hi - lo), q], last, left))
        gain, feature, last, left = (np.concatenate(v) for v in zip(*found, strict=True))
        split = np.flatnonzero(gain > 0)
        level, of = levels[-1], ids[split]
        level[0][of], level[1][of], level[2][of] = feature[split], last[split], total + 2 * np.arange(len(split))
        counts = np.stack([left[split], level[3][of] - left[split]], axis=1).reshape(-1, 2)
        total += len(counts)
        depth += 1
        levels.append(blank(counts))
        ids = np.flatnonzero(counts.all(axis=1) if depth < settings.depth else np.zeros(len(counts), bool))
        rank = np.full(len(keys), -1)
        rank[split] = np.arange(len(split))
        place = np.full(len(counts) + 2, -1)  # the last two for rows of nodes that are not split
        place[ids] = np.arange(len(ids))
        keys = below(keys[split])[ids]
        right = bins.reshape(-1)[np.arange(len(bins)) * width + feature[slot]] > last[slot]
        child = place[2 * rank[slot] + right]
        rows = np.flatnonzero(child >= 0)
        rows = rows[np.argsort(child[rows].astype(np.min_scalar_type(len(ids))), kind="stable")]
        bins, y, c, slot = bins[rows], y[rows], c[rows], child[rows]
    return Tree(*(np.concatenate(v) for v in zip(*levels, strict=True)))


def decides(counts: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    """Whether class 1 weighs more."""
    return counts[:, 1] * weights[1] > counts[:, 0] * weights[0]


def pruned(tree: Tree, weights: tuple[float, float]) -> Tree:
    """The tree after merging leaves beside each other that decide alike, from the bottom up."""
    one, leaf = decides(tree.counts, weights), tree.feature == LEAF
    inner = np.flatnonzero(~leaf)
    while len(inner):
        a = tree.left[inner]
        alike = leaf[a] & leaf[a + 1] & (one[a] == one[a + 1])
        if not alike.any():
            break
        leaf[inner[alike]] = True
        inner = inner[~alike]
    feature = np.where(leaf, LEAF, tree.feature).astype(np.uint8)
    used, now = np.zeros(len(leaf), bool), np.zeros(1, np.int64)
    while len(now):
        used[now] = True
        now = now[feature[now] != LEAF]
        now = np.concatenate([tree.left[now], tree.left[now] + 1])
    number = np.cumsum(used) - 1
    left = np.where(feature == LEAF, 0, number[tree.left])
    return Tree(feature[used], tree.bin[used], left[used].astype(np.int32), tree.counts[used])


@dataclass
class Top:
    """The nodes of a tree that the driver has: splits, leaves, and ends where a task goes on."""

    feature: list[int] = field(default_factory=lambda: [LEAF])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    counts: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])
    keys: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=lambda: [0])
    open: list[int] = field(default_factory=list)
    ends: set[int] = field(default_factory=set)

    def tree(self) -> Tree:
        return Tree(np.array(self.feature, np.uint8), np.array(self.bin, np.uint8), np.array(self.left, np.int32), np.array(self.counts, np.int64).reshape(-1, 2))

    def split(self, node: int, feature: int, last: int, left: tuple[int, int]) -> None:
        new = len(self.feature)
        self.feature[node], self.bin[node], self.left[node] = feature, last, new
        whole = self.counts[node]
        self.counts += [left, (whole[0] - left[0], whole[1] - left[1])]
        self.keys += below(np.array([self.keys[node]], np.uint64)).tolist()
        self.depth += [self.depth[node] + 1] * 2
        for column, v in ((self.feature, LEAF), (self.bin, 0), (self.left, 0)):
            column += [v, v]


@dataclass(frozen=True)
class Forests:
    """The forests of some labels: bounds of bins, class weights, the driver's nodes of each tree, and a table of what tasks grew below them."""

    labels: list
    edges: list[list[list[float]]]
    weights: list[tuple[float, float]]
    settings: Settings
    tops: list[list[tuple[Tree, list[int]]]]
    trees: DataFrame

    def scores(self, features: DataFrame) -> DataFrame:
        """``id, label, prob`` of every row of ``id, x`` for every label."""
        edges, labels, settings, weights, tops = self.edges, self.labels, self.settings, self.weights, self.tops
        id_type = features.schema["id"].dataType

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting, n, block = [], 0, TaskContext.get().partitionId() << 32

            def packed() -> pa.RecordBatch:
                ids = pa.concat_arrays([b.column("id") for b in waiting])
                x = np.concatenate([_wide(b, len(edges[0])) for b in waiting])
                bins = [binned(x, e).tobytes() for e in edges]
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), one(ids), one(pa.array(bins, pa.binary()))], ["block", "ids", "bins"])

            for whole in batches:
                for at in range(0, whole.num_rows, ASKED):
                    batch = whole.slice(at, ASKED)
                    if waiting and n + batch.num_rows > ASKED:
                        yield packed()
                        waiting, n, block = [], 0, block + 1
                    waiting, n = [*waiting, batch], n + batch.num_rows
            if waiting:
                yield packed()

        schema = f"block long, ids array<{id_type.simpleString()}>, bins array<binary>"
        asked = written(features.select("id", F.col("x").cast("array<double>").alias("x")).mapInArrow(pack, schema), "forest_asked")
        parts = -(-(asked.agg(F.sum(F.size("ids"))).first()[0] or 0) // TOGETHER) or 1
        groups = -(-settings.trees // GROUP)
        part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        trees = self.trees.select("k", F.floor(F.col("tree") / GROUP).cast("int").alias("g"), "tree", "node", "grown", part)
        rows = asked.select("block", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), F.posexplode("bins").alias("k", "bins"))
        rows = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        width = len(edges[0])

        def ask(key: tuple, trees: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            k, g = int(key[0]), int(key[1])
            grown = {at: pickle.loads(v) for at, v in zip(zip(trees["tree"].tolist(), trees["node"].tolist(), strict=True), trees["grown"], strict=True)}
            bins = [np.frombuffer(b, np.uint8).reshape(-1, width) for b in rows["bins"]]
            sums, n = [np.zeros(len(b)) for b in bins], 0
            for t in range(g * GROUP, min((g + 1) * GROUP, settings.trees)):
                top, ends = tops[k][t]
                parts = {node: v for (of, node), v in grown.items() if of == t}
                if len(parts) < len(ends):
                    continue  # of so few rows that none was drawn
                whole, value = joined(top, parts, weights[k])
                n += 1
                for s, b in zip(sums, bins, strict=True):
                    s += value[whole.nodes(b)]
            return pd.DataFrame({"block": rows["block"], "k": k, "g": g, "n": n, "sums": [s.tobytes() for s in sums]})

        by = ["k", "g", "part"]
        sums = trees.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(ask, "block long, k int, g int, n int, sums binary")

        def mean(found: pd.DataFrame) -> pd.DataFrame:
            found = found.sort_values("g")
            total = sum(np.frombuffer(s) for s in found["sums"])
            return pd.DataFrame({"block": found["block"].iloc[:1], "k": found["k"].iloc[:1], "probs": [total / max(1, found["n"].sum())]})

        probs = sums.groupBy("block", "k").applyInPandas(mean, "block long, k int, probs array<double>")
        each = probs.join(asked.select("block", "ids"), "block").select("k", F.explode(F.arrays_zip("ids", "probs")).alias("r"))
        label = F.element_at(F.array(*[F.lit(v) for v in labels]), F.col("k") + 1)
        return each.select(F.col("r.ids").alias("id"), label.alias("label"), F.col("r.probs").alias("prob"))


def joined(top: Tree, grown: dict[int, Tree], weights: tuple[float, float]) -> tuple[Tree, np.ndarray]:
    """One tree of the driver's nodes and of what was grown below some of them, and each node's share of class 1.

    The root of what was grown takes the place of the driver's node; the others follow behind.
    """
    feature, last, left, counts = ([v.copy()] for v in (top.feature, top.bin, top.left, top.counts))
    n = len(top.feature)
    for node, t in sorted(grown.items()):
        moved = np.where(t.feature == LEAF, 0, t.left + (n - 1)).astype(np.int32)
        for column, v in ((feature, t.feature), (last, t.bin), (left, moved), (counts, t.counts)):
            column[0][node] = v[0]
            column.append(v[1:])
        n += len(t.feature) - 1
    whole = pruned(Tree(*(np.concatenate(v) for v in (feature, last, left, counts))), weights)
    one = whole.counts[:, 1] * weights[1]
    return whole, one / (whole.counts[:, 0] * weights[0] + one)


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def _wide(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit_each(rows: DataFrame, weights: dict[object, tuple[float, float]], settings: Settings = Settings()) -> Forests:
    """A forest for each label of ``label, id, x, y``: an array of features and a target of 0 or 1, of which each label has both.

    ``weights`` has the weights of both classes by label; other labels' rows count for nothing.
    """
    labels = sorted(weights)
    number = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")).cast("int") - 1
    rows = rows.select(number.alias("k"), F.col("id"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("int").alias("y")).where("k >= 0")
    rows = rows.select("k", F.xxhash64("id", "x").alias("row"), "x", "y")
    width = rows.select(F.size("x").alias("n")).first()["n"]
    totals = rows.groupBy("k").agg(F.count("*").alias("n")).orderBy("k").collect()
    # exact, as approximate ones differ by the order in which rows meet
    bounds = exact_quantiles(rows.select("k", F.posexplode("x").alias("j", "v")), F.col("v"), {f"q{i}": i / settings.bins for i in range(1, settings.bins)}, "k", "j").collect()
    found = {(r["k"], r["j"]): sorted({v for v in r[2:] if v == v}) for r in bounds}
    edges = [[found.get((r["k"], j), []) for j in range(width)] for r in totals]
    limits = [max(settings.rows, r["n"] // 64) for r in totals]
    weigh = [weights[v] for v in labels]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}

        def block(k: int) -> pa.RecordBatch:
            parts = [np.concatenate(c) for c in zip(*waiting.pop(k), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((k, *parts))], pa.binary())], ["block"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _wide(part, width)
                label, row, y = (part.column(c).to_numpy(zero_copy_only=False) for c in ("k", "row", "y"))
                for k in np.unique(label).tolist():
                    mine = np.flatnonzero(label == k)
                    waiting.setdefault(k, []).append((row[mine].astype(np.uint64), binned(x[mine], edges[k]), y[mine].astype(np.uint8)))
                    if sum(len(p[0]) for p in waiting[k]) >= BLOCK:
                        yield block(k)
        for k in list(waiting):
            yield block(k)

    blocks = -(-sum(r["n"] for r in totals) // BLOCK)
    packed = written(rows.mapInArrow(pack, "block binary"), "forest_blocks")
    tops = [[_started(settings, t, r["n"] > limit) for t in range(settings.trees)] for r, limit in zip(totals, limits, strict=True)]
    _split_large(packed.repartition(blocks), tops, limits, weigh, settings)
    ends = [[(top.tree(), sorted(top.ends), {n: (top.keys[n], top.depth[n]) for n in top.ends}) for top in of] for of in tops]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each tree has drawn, by the driver's node that it comes to."""
        for batch in batches:
            for packed in batch.column("block"):
                k, row, bins, y = pickle.loads(packed.as_py())
                for t, (tree, nodes, _) in enumerate(ends[k]):
                    c = draws(row, settings, t)
                    rows = np.flatnonzero(c)
                    b = bins[rows]
                    data, at = np.concatenate([b, (c[rows] * 2 + y[rows])[:, None]], axis=1), tree.nodes(b)
                    parts = [(n, data[at == n].tobytes()) for n in nodes]
                    parts = [p for p in parts if p[1]]
                    if parts:
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(parts), pa.int32()), pa.array([t] * len(parts), pa.int32()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["k", "tree", "node", "part"])

    def finish(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        k, t, node = map(int, key)
        data = np.concatenate([np.frombuffer(p, np.uint8).reshape(-1, width + 1) for p in parts["part"]])
        bins, code = np.ascontiguousarray(data[:, :width]), data[:, width]
        path, depth = ends[k][t][2][node]
        tree = pruned(grow(bins, code & 1, code >> 1, np.array([path], np.uint64), depth, settings, weigh[k]), weigh[k])
        tree.counts = tree.counts.astype(np.min_scalar_type(tree.counts.max()))
        return pd.DataFrame({"k": [k], "tree": [t], "node": [node], "grown": [pickle.dumps(tree)]})

    dealt = packed.repartition(blocks).mapInArrow(deal, "k int, tree int, node int, part binary")
    trees = written(dealt.groupBy("k", "tree", "node").applyInPandas(finish, "k int, tree int, node int, grown binary"), "forest_trees")
    dropped(packed)
    return Forests(labels, edges, weigh, settings, [[e[:2] for e in of] for of in ends], trees)


def _started(settings: Settings, tree: int, large: bool) -> Top:
    top = Top(keys=root(settings, tree).tolist())
    if large:
        top.open = [0]
    else:
        top.ends = {0}
    return top


def _split_large(packed: DataFrame, tops: list[list[Top]], limits: list[int], weights: list[tuple[float, float]], settings: Settings) -> None:
    """Splits nodes until none has more draws than its label's limit: a pass over the blocks for each level."""
    base = packed.rdd.map(lambda row: pickle.loads(bytes(row["block"])))
    while True:
        wanted = {(k, t): (top.tree(), top.open, np.array([top.keys[n] for n in top.open], np.uint64)) for k, of in enumerate(tops) for t, top in enumerate(of) if top.open}
        if not wanted:
            return

        def count(block: tuple, wanted=wanted) -> Iterator[tuple]:
            k, row, bins, y = block
            for (of, t), (tree, nodes, keys) in wanted.items():
                if of != k:
                    continue
                c = draws(row, settings, t)
                slot = np.full(len(tree.feature), -1)
                slot[nodes] = np.arange(len(nodes))
                slot = slot[tree.nodes(bins)]
                rows = np.flatnonzero((slot >= 0) & (c > 0))
                looked = looked_at(keys, bins.shape[1], settings)
                yield (k, t), (looked, histogram(bins[rows], y[rows], c[rows], slot[rows], looked, settings.bins))

        def best(key: tuple, found: tuple) -> list[tuple]:
            looked, hist = found
            gain, q, last, left = best_splits(hist, weights[key[0]])
            return list(zip((gain > 0).tolist(), looked[np.arange(len(q)), q].tolist(), last.tolist(), map(tuple, left.tolist()), [tuple(map(int, h[0].sum(axis=0))) for h in hist], strict=True))

        merged = base.flatMap(count).reduceByKey(lambda a, b: (a[0], a[1] + b[1]))
        for (k, t), splits in merged.map(lambda x: (x[0], best(*x))).collect():
            top = tops[k][t]
            now, top.open = top.open, []
            for node, (some, feature, last, left, whole) in zip(now, splits, strict=True):
                top.counts[node] = whole
                if not some or top.depth[node] >= settings.depth:
                    continue
                top.split(node, feature, last, left)
                for child in (len(top.feature) - 2, len(top.feature) - 1):
                    if sum(top.counts[child]) > limits[k]:
                        top.open.append(child)
                    elif all(top.counts[child]) and top.depth[child] < settings.depth:
                        top.ends.add(child)
