"""Leaf-wise histogram boosting for one binary target.

Features are binned by quantiles, and rows become packed blocks of bins in a written table.
A tree grows best leaf first, up to a number of leaves: the gains of a leaf's splits come
from histograms of gradients, one aggregate over the blocks for all leaves that are about to
be split, in which only the smaller child of each is counted; the other one is the parent
less that child. So a tree takes about as many passes as it has levels, and the driver gets
histograms (features times bins for each leaf counted), whose size is that of the model's
parameters. Rows never leave their blocks; each block's scores are kept with it, and every
:data:`REBASE` trees they are computed anew from the written blocks and the model, so that a
lost executor costs that many trees at most.

With rows for validation, the loss on them after each tree is recorded; training ends when
it has not fallen for ``patience`` trees, and the trees after the best one are left out.

With ``residuals``, trees are fitted as Spark's GBTClassifier does: the first one to the classes
as -1 and 1, at rate 1, each other one to the negative gradients of ``2 log(1 + exp(-2 y F))``
by variance, leaves being their means; the probability is that of ``2 F``.
"""

from __future__ import annotations

import pickle
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.operators.steps import dropped, written

#: Rows of a block, and trees after which scores are computed anew.
BLOCK, REBASE = 8192, 20
#: Partitions up to which their histograms go to the driver at once.
FEW = 32


@dataclass(frozen=True)
class Settings:
    """Sizes and limits; the defaults are the reference's."""

    rounds: int = 300
    leaves: int = 31
    rate: float = 0.1
    bins: int = 255
    least_rows: int = 20
    least_hessian: float = 1e-3
    patience: int = 0
    depth: int = 0
    residuals: bool = False


@dataclass
class Tree:
    """Nodes in order of their making: a split (feature, last bin that goes left, children) or a leaf's value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        new = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, *new
        for _ in new:
            for column, blank in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                column.append(blank)
        return new

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at, feature = np.zeros(len(bins), np.int64), np.asarray(self.feature)
        bound, left, right = np.asarray(self.bin), np.asarray(self.left), np.asarray(self.right)
        flat, width = bins.reshape(-1), bins.shape[1]
        rows = np.arange(len(bins) if feature[0] >= 0 else 0)
        while len(rows):
            k = at[rows]
            k = np.where(flat[rows * width + feature[k]] <= bound[k], left[k], right[k])
            at[rows] = k
            rows = rows[feature[k] >= 0]
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.nodes(bins)]


@dataclass
class Model:
    """Bounds of bins for each feature, the score of no tree, trees, and losses after each tree tried."""

    edges: list[list[float]]
    start: float
    trees: list[Tree]
    history: list[tuple[int, float, float]]
    scale: float = 1.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def scores(self, bins: np.ndarray, start: int = 0) -> np.ndarray:
        """The sum of the trees from ``start`` on, and the score of no tree if that is the first."""
        out = np.full(len(bins), 0.0 if start else self.start)
        for tree in self.trees[start:]:
            out += tree.scores(bins)
        return out

    def probability(self, x: Column) -> Column:
        """The probability of class 1 for a column of feature arrays."""
        model = self

        def run(x: pd.Series) -> pd.Series:
            return pd.Series(1.0 / (1.0 + np.exp(-model.scale * model.scores(model.binned(np.stack(x.to_numpy())))))) if len(x) else pd.Series([], dtype="float64")

        return F.pandas_udf(run, "double")(x)


@dataclass(frozen=True)
class Block:
    """A label's bins, targets, weights, whether a row is for validation, and scores so far."""

    label: int
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    held: np.ndarray
    score: np.ndarray
    trees: int = 0
    residuals: bool = False

    def gradients(self) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives of the loss, 0 for rows of validation."""
        w = np.where(self.held, 0.0, self.w)
        if self.residuals:
            sign = 2.0 * self.y - 1.0
            return -w * (4.0 * sign / (1.0 + np.exp(2.0 * sign * self.score)) if self.trees else sign), w
        p = 1.0 / (1.0 + np.exp(-self.score))
        return w * (p - self.y), w * p * (1.0 - p)

    def losses(self) -> np.ndarray:
        """Weighted log loss and weight of training rows, then of those of validation."""
        score = self.score * (2.0 if self.residuals else 1.0)
        loss = self.w * (np.logaddexp(0.0, score) - self.y * score)
        return np.array([v for rows in (~self.held, self.held) for v in (loss[rows].sum(), self.w[rows].sum())])

    def histogram(self, tree: Tree, wanted: list[int], bins: int) -> np.ndarray:
        """Gradients, second derivatives and rows by (leaf, feature, bin) of the leaves wanted."""
        slot = np.full(len(tree.feature), -1)
        slot[wanted] = np.arange(len(wanted))
        at = slot[tree.nodes(self.bins)]
        rows = np.flatnonzero((at >= 0) & ~self.held)
        g, h = self.gradients()
        width = self.bins.shape[1]
        out = np.zeros((3, len(wanted), width, bins))
        for j in range(width):
            cell = at[rows] * bins + self.bins[rows, j]
            for k, weight in enumerate((g[rows], h[rows], None)):
                out[k, :, j] = np.bincount(cell, weight, len(wanted) * bins).reshape(-1, bins)
        return out


def best_split(hist: np.ndarray, settings: Settings) -> tuple[float, int, int] | None:
    """Gain, feature and bin of a leaf's best split: of equal gains the first feature and bin; none without a gain."""
    below = hist.cumsum(axis=2)
    whole = below[:, :1, -1:]
    above = whole - below
    fits = (np.minimum(below[2], above[2]) >= settings.least_rows) & (np.minimum(below[1], above[1]) >= settings.least_hessian)
    if not fits.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, below[0] ** 2 / below[1] + above[0] ** 2 / above[1] - whole[0] ** 2 / whole[1], -np.inf)
    at = int(gain.argmax())
    j, b = divmod(at, gain.shape[1])
    return (float(gain[j, b]), j, b) if gain[j, b] > 1e-12 else None


def grow(settings: Settings) -> Generator[tuple[Tree, list[int]], np.ndarray, Tree]:
    """One tree; it asks for the histograms of leaves of a tree, and is sent them.

    Leaves are split in order of gain. Where the next ones' children are not counted yet,
    all leaves that would be split if those had no gain are counted at once.
    """
    tree = Tree()
    hist = {0: (yield tree, [0])[:, 0]}
    splits = {0: best_split(hist[0], settings)}
    children: dict[int, tuple[int, int]] = {}
    depth = {0: 0}
    while True:
        leaves, open_ = {0}, []
        while len(leaves) + len(open_) < settings.leaves:
            able = [k for k in leaves if splits[k] and k not in open_]
            if not able:
                break
            best = max(able, key=lambda k: (splits[k][0], -k))
            if best in children:
                leaves = leaves - {best} | set(children[best])
            else:
                open_.append(best)
        if not open_:
            break
        fresh = []
        for k in open_:
            _, j, b = splits[k]
            children[k] = tree.split(k, j, b)
            depth |= dict.fromkeys(children[k], depth[k] + 1)
            few = hist[k][2, j, : b + 1].sum() * 2 <= hist[k][2, j].sum()
            fresh.append((k, *(children[k] if few else children[k][::-1])))
        found = yield tree, [x[1] for x in fresh]
        last = lambda k: settings.depth and depth[k] >= settings.depth
        for (k, small, large), counted in zip(fresh, np.moveaxis(found, 1, 0), strict=True):
            hist[small], hist[large] = counted, hist[k] - counted
            splits[small], splits[large] = (None if last(x) else best_split(hist[x], settings) for x in (small, large))
    for k in leaves:
        tree.feature[k] = -1  # a split that was counted ahead but not taken
        g, h = hist[k][0, 0].sum(), hist[k][1, 0].sum()
        tree.value[k] = -settings.rate * g / h if h > 0 else 0.0
    return tree


def counted(blocks: RDD, asked: dict[int, tuple[Tree, list[int]]], losses: set[int], bins: int) -> dict[tuple[str, int], np.ndarray]:
    """By ("leaves", label), the histograms of the leaves asked for; by ("loss", label), the losses: one aggregate for all labels."""

    def add(found: dict, b: Block) -> dict:
        own = {}
        if b.label in asked:
            own["leaves", b.label] = b.histogram(*asked[b.label], bins)
        if b.label in losses:
            own["loss", b.label] = b.losses()
        return merged(found, own)

    def merged(a: dict, b: dict) -> dict:
        return a | {k: a[k] + v if k in a else v for k, v in b.items()}

    # what few partitions have counted is as little as what the driver gets anyway
    return blocks.treeAggregate({}, add, merged, 1 if blocks.getNumPartitions() <= FEW else 2)


def fit(rows: DataFrame, settings: Settings = Settings(), edges: list[list[float]] | None = None) -> Model:
    """A model of ``x, y, w`` and optionally ``held`` (rows for validation): arrays of features, a target of 0 or 1, a weight.

    All feature arrays have one length; NaN counts as larger than every number. Without
    training rows of both classes the model is constant.
    """
    found = fit_each(rows.withColumn("label", F.lit(0)), settings, None if edges is None else {0: edges})
    return found.get(0, Model([], 0.0, [], []))


def fit_each(rows: DataFrame, settings: Settings = Settings(), edges: dict[object, list[list[float]]] | None = None) -> dict[object, Model]:
    """A model for each ``label`` of the rows, see :func:`fit`.

    The labels' trees grow in step: a pass over the blocks counts what all of them ask for, and the first
    pass of a tree also gives the losses after the one before. So passes do not grow with labels.
    """
    held = F.coalesce("held", F.lit(False)) if "held" in rows.columns else F.lit(False)
    rows = rows.select("label", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"), held.alias("held"))
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        return {}
    width, probs = first["n"], [i / settings.bins for i in range(1, settings.bins)]
    own = lambda c: F.when(~F.col("held"), c)
    quantiles = [F.percentile_approx(own(F.get("x", j)), probs, 10000).alias(f"q{j}") for j in range(width if edges is None else 0)]
    totals = rows.groupBy("label").agg(F.sum(own(F.col("w"))).alias("w"), F.sum(own(F.col("w") * F.col("y"))).alias("p"), *quantiles).orderBy("label").collect()
    models: list[Model] = []
    for r in totals:  # a few dozen labels
        share = (r["p"] or 0.0) / r["w"] if r["w"] else 0.0
        start = float(np.log(share / (1.0 - share))) if 0.0 < share < 1.0 else (-35.0 if share == 0.0 else 35.0)
        models.append(Model([sorted({float(v) for v in r[f"q{j}"] or [] if v == v}) for j in range(width)] if edges is None else edges[r["label"]], start, [], []))
    live = {k for k, m in enumerate(models) if abs(m.start) < 35.0}
    if settings.residuals:
        for k in live:
            models[k].start, models[k].scale = 0.0, 2.0
    by_label = {r["label"]: m for r, m in zip(totals, models, strict=True)}
    if not live:
        return by_label

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}

        def block(k: int) -> pa.RecordBatch:
            parts = [np.concatenate(c) for c in zip(*waiting.pop(k), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((k, *parts))], pa.binary())], ["block"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                label, *columns = (part.column(c).to_numpy(zero_copy_only=False) for c in ("k", "y", "w", "held"))
                for k in np.unique(label).tolist():
                    mine = np.flatnonzero(label == k)
                    waiting.setdefault(k, []).append((models[k].binned(x[mine]), *[c[mine] for c in columns]))
                    if sum(len(p[1]) for p in waiting[k]) >= BLOCK:
                        yield block(k)
        for k in list(waiting):
            yield block(k)

    number = F.array_position(F.array(*[F.lit(r["label"]) for r in totals]), F.col("label")).cast("int") - 1
    packed = written(rows.withColumn("k", number).where(F.col("k").isin(*live)).mapInArrow(pack, "block binary"), "boost_blocks")
    base = packed.rdd.map(lambda row: pickle.loads(bytes(row["block"])))

    def based() -> RDD:
        now = {k: Model(models[k].edges, models[k].start, list(models[k].trees), []) for k in live}
        residuals = settings.residuals
        return base.filter(lambda b: b[0] in now).map(lambda b: Block(*b, now[b[0]].scores(b[1]), len(now[b[0]].trees), residuals)).persist(StorageLevel.MEMORY_AND_DISK)

    best: dict[int, int] = {}

    def noted(found: dict[tuple[str, int], np.ndarray]) -> None:
        """Losses go into the models' histories; labels whose loss has not fallen for long are done."""
        for k in sorted(live):
            train_loss, train_w, held_loss, held_w = found["loss", k]
            history = models[k].history
            history.append((len(history) + 1, float(train_loss / train_w), float(held_loss / held_w) if held_w else float("nan")))
            if not held_w:
                continue
            if k not in best or history[-1][2] < history[best[k]][2]:
                best[k] = len(history) - 1
            if settings.patience and len(history) - 1 - best[k] >= settings.patience:
                live.remove(k)

    blocks, before = based(), None
    for r in range(settings.rounds):
        growing = {k: grow(settings if r or not settings.residuals else replace(settings, rate=1.0)) for k in live}
        asked, trees = {k: next(g) for k, g in growing.items()}, {}
        while asked:
            found = counted(blocks, asked, live if r and before is not None else set(), settings.bins)
            if before is not None:  # its scores are in the blocks that this pass has stored
                before.unpersist()
                before = None
                noted(found)
                asked = {k: v for k, v in asked.items() if k in live}
            more = {}
            for k in asked:
                try:
                    more[k] = growing[k].send(found["leaves", k])
                except StopIteration as end:
                    trees[k] = end.value
            asked = more
        if not live:
            break
        for k, tree in trees.items():
            models[k].trees.append(tree)
        before = blocks
        blocks = before.filter(lambda b, trees=trees: b.label in trees).map(lambda b, trees=trees: replace(b, score=b.score + trees[b.label].scores(b.bins), trees=b.trees + 1)).persist(StorageLevel.MEMORY_AND_DISK) if (r + 1) % REBASE else based()
    if live and before is not None:
        noted(counted(blocks, {}, set(live), settings.bins))
        before.unpersist()
    blocks.unpersist()
    dropped(packed)
    for k, at in best.items():
        del models[k].trees[at + 1 :]
    return by_label
