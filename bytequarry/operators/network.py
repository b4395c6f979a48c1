"""Networks of logistic units for binary targets, fitted by L-BFGS over packed blocks.

Hidden layers of logistic units and a softmax over two classes, as in Spark's
MultilayerPerceptronClassifier, with row weights. Rows become packed blocks of a written
table; a pass over them gives the loss and its gradient by matrix products, as one aggregate
for all labels, whose networks are fitted in step. The driver has the parameters and the last
few gradients, whatever the rows.

A label without rows gets no network; NaN among features is not handled (as in Spark).
"""

from __future__ import annotations

import pickle
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytequarry.operators.steps import dropped, written

#: Rows of a block, and those whose layers are worked out at once (they fit a core's cache).
BLOCK, ROWS = 4096, 512
#: Pairs of steps that L-BFGS remembers, evaluations of one line search.
MEMORY, TRIES = 10, 20
#: Partitions up to which their gradients go to the driver at once.
FEW = 32


@dataclass
class Network:
    """Layer sizes, and weights and offsets of all layers in one vector."""

    sizes: tuple[int, ...]
    flat: np.ndarray

    @staticmethod
    def new(sizes: tuple[int, ...], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        parts = [np.concatenate([rng.uniform(-1, 1, a * b) * 4 * np.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in zip(sizes, sizes[1:], strict=False)]
        return Network(sizes, np.concatenate(parts))

    def layers(self, kind: type = np.float64) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at, flat = [], 0, self.flat.astype(kind)
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Each layer's outputs, the inputs first; the last one's before the softmax."""
        out, layers = [x], self.layers(x.dtype)
        for i, (w, b) in enumerate(layers):
            z = out[-1] @ w
            z += b
            if i + 1 < len(layers):
                np.clip(z, -80.0, 80.0, z)
                np.negative(z, z)
                np.exp(z, z)
                z += 1.0
                np.reciprocal(z, z)
            out.append(z)
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The log odds of class 1."""
        z = self.forward(x)[-1]
        return z[:, 1] - z[:, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The weighted loss over rows, then its gradient: layers in the precision of ``x``, sums in double."""
        total = np.zeros(1 + len(self.flat))
        for lo in range(0, len(x), ROWS):
            total += self._gradient(x[lo : lo + ROWS], y[lo : lo + ROWS], w[lo : lo + ROWS])
        return total

    def _gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        out, layers, parts = self.forward(x), self.layers(x.dtype), []
        m = (out[-1][:, 1] - out[-1][:, 0]).astype(np.float64)
        loss = float(w @ (np.logaddexp(0.0, m) - y * m))
        d = w * (1.0 / (1.0 + np.exp(-np.clip(m, -500.0, 500.0))) - y)
        delta = np.stack([-d, d], axis=1).astype(x.dtype)
        for i in reversed(range(len(layers))):
            parts[:0] = [(out[i].T @ delta).reshape(-1), delta.sum(0)]
            if i:
                delta = delta @ layers[i][0].T
                delta *= out[i]
                delta *= 1.0 - out[i]
        return np.concatenate([[loss], *parts])

    def probability(self, x: Column) -> Column:
        """The probability of class 1 for a column of feature arrays."""
        model = self

        def run(x: pd.Series) -> pd.Series:
            return pd.Series(1.0 / (1.0 + np.exp(-np.clip(model.margins(np.stack(x.to_numpy())), -500.0, 500.0)))) if len(x) else pd.Series([], dtype="float64")

        return F.pandas_udf(run, "double")(x)


def lbfgs(x: np.ndarray, iterations: int, tolerance: float = 1e-6) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """The least point of a function; it asks for points, and is sent the value and gradient there.

    Steps fulfil the weak Wolfe conditions. It ends after ``iterations`` steps, where ten of them gained no
    more than ``tolerance`` of the value, or where the gradient is next to nothing.
    """
    f, g = yield x
    past, values = [], [f]
    for _ in range(iterations):
        if np.linalg.norm(g) <= max(tolerance * abs(f), 1e-8):
            break
        q, found = g.copy(), []
        for s, t in reversed(past):
            found.append((s @ q) / (s @ t))
            q -= found[-1] * t
        if past:
            s, t = past[-1]
            q *= (s @ t) / (t @ t)
        for (s, t), a in zip(past, reversed(found), strict=True):
            q += s * (a - (t @ q) / (s @ t))
        slope, step, low, high = -(g @ q), 1.0 if past else 1.0 / max(1.0, float(np.linalg.norm(g))), 0.0, np.inf
        better = None
        for _ in range(TRIES):
            at = x - step * q
            fx, gx = yield at
            if not fx <= f + 1e-4 * step * slope:
                high = step
            else:
                better = (at, fx, gx)
                if -(gx @ q) >= 0.9 * slope:
                    break
                low = step
            step = 2.0 * step if high == np.inf else (low + high) / 2
        if better is None:
            break
        s, t = better[0] - x, better[2] - g
        if s @ t > 1e-12 * (t @ t):
            past = [*past, (s, t)][-MEMORY:]
        x, f, g = better
        values.append(f)
        if len(values) > 10 and values[-11] - f <= tolerance * abs(f):
            break
    return x


def counted(blocks: RDD, asked: dict[int, Network]) -> dict[int, np.ndarray]:
    """By label, the loss and gradient of its network over its blocks: one aggregate for all labels."""

    def add(found: dict, b: tuple) -> dict:
        return merged(found, {b[0]: asked[b[0]].gradient(*b[1:])}) if b[0] in asked else found

    def merged(a: dict, b: dict) -> dict:
        return a | {k: a[k] + v if k in a else v for k, v in b.items()}

    return blocks.treeAggregate({}, add, merged, 1 if blocks.getNumPartitions() <= FEW else 2)


def fit_each(rows: DataFrame, width: int, weights: dict[object, float], hidden: tuple[int, ...], iterations: int, seed: int = 0) -> dict[object, Network]:
    """A network for each label of ``weights`` (the sum of its rows' weights) from ``label, x, y, w``: arrays of ``width`` features, a target of 0 or 1, a weight."""
    labels, sizes = list(weights), (width, *hidden, 2)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}

        def block(k: int) -> pa.RecordBatch:
            parts = [np.concatenate(c) for c in zip(*waiting.pop(k), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps((k, *parts))], pa.binary())], ["block"])

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                label, *columns = (part.column(c).to_numpy(zero_copy_only=False) for c in ("k", "y", "w"))
                for k in np.unique(label).tolist():
                    mine = np.flatnonzero(label == k)
                    waiting.setdefault(k, []).append((x[mine].astype(np.float32), *[c[mine] for c in columns]))
                    if sum(len(p[1]) for p in waiting[k]) >= BLOCK:
                        yield block(k)
        for k in list(waiting):
            yield block(k)

    number = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")).cast("int") - 1
    shaped = rows.select(number.alias("k"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"))
    packed = written(shaped.where("k >= 0").mapInArrow(pack, "block binary"), "network_blocks")
    blocks = packed.rdd.map(lambda row: pickle.loads(bytes(row["block"]))).persist(StorageLevel.MEMORY_AND_DISK)
    fitted: dict[object, Network] = {}
    running = {k: lbfgs(Network.new(sizes, seed).flat, iterations) for k in range(len(labels))}
    points = {k: next(r) for k, r in running.items()}
    while points:
        found, more = counted(blocks, {k: Network(sizes, p) for k, p in points.items()}), {}
        for k in points:
            if k not in found:
                continue
            v = found[k] / weights[labels[k]]
            try:
                more[k] = running[k].send((float(v[0]), v[1:]))
            except StopIteration as end:
                fitted[labels[k]] = Network(sizes, end.value)
        points = more
    blocks.unpersist()
    dropped(packed)
    return fitted
