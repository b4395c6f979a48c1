"""Graph layers as relations: nodes ``fp, node, h`` with vectors, edges ``fp, s, t``, and parameters as small matrices.

Products of vectors with parameters are matrix products over Arrow batches. A convolution
gathers over edges by keyed sums, combined before the shuffle. Attention brings edges to their
ends by a join, and all edges into a node meet there, in a window and a sum without a further
shuffle. Layers are as in evaluation: no dropout, and batch norms as the scale and shift that
they have learned.

A node without edges takes part (its sums are 0); edges need both their ends among the
nodes; several edges between two nodes count each. Vectors must have the width of the
parameters. No nodes give an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Matrix = list[list[float]]
VECTOR = "array<double>"
#: Added to variances before their root.
EPSILON = 1e-5


@dataclass(frozen=True)
class Linear:
    """``W x + b``; ``weight`` has a row for each output."""

    weight: Matrix
    bias: list[float] | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ np.asarray(self.weight).T
        return y if self.bias is None else y + np.asarray(self.bias)


def gelu(x: np.ndarray) -> np.ndarray:
    erf = np.frompyfunc(math.erf, 1, 1)
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2)).astype(np.float64))


def layer_norm(x: np.ndarray) -> np.ndarray:
    """Each row with mean 0 and variance 1 (scale and shift are left to what follows)."""
    centred = x - x.mean(axis=1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + EPSILON)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


ACTIVATIONS = {
    "none": lambda x: x,
    "relu": lambda x: np.maximum(x, 0.0),
    "elu": lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0.0))),
    "gelu": gelu,
    "sigmoid": sigmoid,
}


def apply(function, *columns: Column) -> Column:
    """A column of vectors: ``function`` of the matrices (or plain arrays) that ``columns`` form in each batch, read from Arrow's buffers."""

    def matrix(x: pa.Array) -> np.ndarray:
        return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if pa.types.is_list(x.type) else x.to_numpy(zero_copy_only=False)

    def run(*arrays: pa.Array) -> pa.Array:
        n = len(arrays[0])
        out = np.ascontiguousarray(function(*[matrix(x) for x in arrays]), np.float64) if n else np.zeros((0, 0))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

    return F.arrow_udf(run, VECTOR)(*columns)


def linear(layer: Linear, x: Column, activation: str = "none") -> Column:
    act = ACTIVATIONS[activation]
    return apply(lambda m: act(layer(m)), x)


def embed(nodes: DataFrame, table: Matrix, place: Linear, project: Linear) -> DataFrame:
    """``fp, node, h`` of nodes ``fp, node, opcode_id, pc``: an opcode's row of ``table`` beside a map of its place, projected."""
    known = len(table) - 1

    def run(opcode, pc):
        both = np.concatenate([np.asarray(table)[np.clip(opcode, 0, known)], place(pc[:, None].astype(np.float64))], axis=1)
        return project(both)

    return nodes.select("fp", "node", apply(run, F.col("opcode_id"), F.col("pc")).alias("h"))


def sums(rows: DataFrame, by: list[str], vector: str, width: int, as_: str, *more: Column) -> DataFrame:
    """Vectors summed by key, one aggregate a component."""
    parts = [F.sum(F.get(vector, i)).alias(f"_{i}") for i in range(width)]
    found = rows.groupBy(*by).agg(*parts, *more)
    return found.select(*[c for c in found.columns if c not in {f"_{i}" for i in range(width)}], F.array(*[f"_{i}" for i in range(width)]).alias(as_))


def with_loops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp, s, t``: every edge between two nodes, and one from each node to itself."""
    return edges.where("s <> t").select("fp", "s", "t").unionByName(nodes.select("fp", F.col("node").alias("s"), F.col("node").alias("t")))


def convolve(nodes: DataFrame, edges: DataFrame, layer: Linear, activation: str = "none") -> DataFrame:
    """One normalised convolution: ``D**-1/2 (A + I) D**-1/2 H W + b``, where D counts the edges into a node, its own loop included."""
    width = len(layer.weight)
    looped = with_loops(nodes, edges)
    root = looped.groupBy("fp", F.col("t").alias("node")).agg((1 / F.sqrt(F.count("*").cast("double"))).alias("root"))
    sent = nodes.select("fp", "node", linear(Linear(layer.weight), F.col("h")).alias("h")).join(root, ["fp", "node"])
    sent = sent.select("fp", F.col("node").alias("s"), F.transform("h", lambda x: x * F.col("root")).alias("m"))
    got = sums(looped.join(sent, ["fp", "s"]), ["fp", "t"], "m", width, "m", F.count("*").cast("double").alias("n")).withColumnRenamed("t", "node")
    # every edge's source is a node, so these are the edges that the root counts
    got = got.withColumn("root", 1 / F.sqrt("n"))
    bias = np.zeros(width) if layer.bias is None else np.asarray(layer.bias)
    act = ACTIVATIONS[activation]
    return got.select("fp", "node", apply(lambda m, r: act(m * r[:, None] + bias), F.col("m"), F.col("root")).alias("h"))


def attend(scored: DataFrame, heads: int, width: int) -> DataFrame:
    """``fp, node, m`` from edges ``fp, t, score, v``: each head's part of the vectors ``v``, weighted by the softmax of its scores over the edges into a node.

    ``score`` has one number a head. Scores are shifted by the largest of a node, over a window by
    node, and summed by node: both by the one shuffle that brought the edges to their ends.
    """
    part = width // heads
    into = Window.partitionBy("fp", "t")
    rows = scored.select("fp", "t", "v", *[F.exp(F.get("score", k) - F.max(F.get("score", k)).over(into)).alias(f"e{k}") for k in range(heads)])
    found = rows.groupBy("fp", F.col("t").alias("node")).agg(*[F.sum(f"e{k}").alias(f"e{k}") for k in range(heads)], *[F.sum(F.get("v", i) * F.col(f"e{i // part}")).alias(f"v{i}") for i in range(width)])
    return found.select("fp", "node", F.array(*[F.col(f"v{i}") / F.col(f"e{i // part}") for i in range(width)]).alias("m"))


def ends(nodes: DataFrame, edges: DataFrame, *keep: str) -> DataFrame:
    """``fp, t, hs, ht``: edges with the vectors of both ends."""
    side = lambda name, h: nodes.select("fp", F.col("node").alias(name), F.col("h").alias(h))
    return edges.join(side("s", "hs"), ["fp", "s"]).join(side("t", "ht"), ["fp", "t"]).select("fp", "t", *keep, "hs", "ht")


def graph_attention(nodes: DataFrame, edges: DataFrame, project: Linear, source: Matrix, target: Matrix, bias: list[float], slope: float = 0.2) -> DataFrame:
    """Attention with one score a head from both ends: ``leaky(source . W h_s + target . W h_t)``, with one loop a node."""
    heads, width = len(source), len(project.weight)
    a, b = np.asarray(source), np.asarray(target)

    def sides(h):
        """What a node gives: its projection, then its part of the scores as an edge's source and as its target."""
        x, split = Linear(project.weight)(h), project(h).reshape(len(h), heads, -1)
        return np.concatenate([x, (split * a).sum(axis=2), (split * b).sum(axis=2)], axis=1)

    given = nodes.select("fp", "node", apply(sides, F.col("h")).alias("x"))
    own = lambda name, *columns: given.select("fp", F.col("node").alias(name), *columns)
    at = lambda k: F.slice("x", width + 1 + k * heads, heads)
    looped = with_loops(nodes, edges).join(own("s", F.slice("x", 1, width).alias("v"), at(0).alias("a")), ["fp", "s"]).join(own("t", at(1).alias("b")), ["fp", "t"])
    leaky = F.zip_with("a", "b", lambda a, b: F.when(a + b > 0, a + b).otherwise((a + b) * slope))
    got = attend(looped.select("fp", "t", leaky.alias("score"), "v"), heads, width)
    return got.select("fp", "node", F.zip_with("m", F.array(*[F.lit(float(x)) for x in bias]), lambda m, x: m + x).alias("h"))


@dataclass(frozen=True)
class TypedAttention:
    """Parameters of a layer with projections of queries, keys and values for each edge type."""

    query: list[Linear]
    key: list[Linear]
    value: list[Linear]
    out: Linear
    widen: Linear
    narrow: Linear
    heads: int = 1
    width: int = field(default=0)

    def __post_init__(self):
        object.__setattr__(self, "width", len(self.out.weight))

    def typed(self, layers: list[Linear], x: np.ndarray, kind: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.width))
        for k in np.unique(kind):
            y[kind == k] = layers[k](x[kind == k])
        return y

    def scores(self, hs: np.ndarray, ht: np.ndarray, kind: np.ndarray) -> np.ndarray:
        split = lambda x: x.reshape(len(x), self.heads, -1)
        q, k = self.typed(self.query, ht, kind), self.typed(self.key, hs, kind)
        return (split(q) * split(k)).sum(axis=2) / math.sqrt(self.width / self.heads)

    def finish(self, h: np.ndarray, m: np.ndarray) -> np.ndarray:
        h = layer_norm(h + self.out(m))
        return layer_norm(h + self.narrow(gelu(self.widen(h))))


def typed_attention(nodes: DataFrame, edges: DataFrame, layer: TypedAttention, bias: DataFrame | None = None) -> DataFrame:
    """One layer of attention over typed edges (``type_id``), with residuals, norms and a feed-forward map of each node.

    ``bias`` (``fp, node, bias``) is added to the scores of a node's incoming edges.
    """
    both = ends(nodes, edges, "type_id")
    found = lambda hs, ht, kind: np.concatenate([layer.scores(hs, ht, kind), layer.typed(layer.value, hs, kind)], axis=1)
    both = both.select("fp", "t", apply(found, F.col("hs"), F.col("ht"), F.col("type_id")).alias("x"))
    scored = both.select("fp", "t", F.slice("x", 1, layer.heads).alias("score"), F.slice("x", layer.heads + 1, layer.width).alias("v"))
    if bias is not None:
        own = bias.select("fp", F.col("node").alias("t"), "bias")
        scored = scored.join(own, ["fp", "t"], "left").withColumn("score", F.transform("score", lambda x: x + F.coalesce("bias", F.lit(0.0)))).drop("bias")
    got = attend(scored, layer.heads, layer.width)
    none = F.array_repeat(F.lit(0.0), layer.width)
    joined = nodes.join(got, ["fp", "node"], "left").withColumn("m", F.coalesce("m", none))
    return joined.select("fp", "node", apply(layer.finish, F.col("h"), F.col("m")).alias("h"))


def pooled(nodes: DataFrame, width: int) -> DataFrame:
    """``fp, mean, top``: componentwise mean and maximum of each graph's nodes."""
    cells = [f(F.get("h", i)).alias(f"{k}{i}") for k, f in (("a", F.avg), ("b", F.max)) for i in range(width)]
    found = nodes.groupBy("fp").agg(*cells)
    return found.select("fp", *[F.array(*[f"{k}{i}" for i in range(width)]).alias(name) for k, name in (("a", "mean"), ("b", "top"))])


def gated_fusion(pairs: DataFrame, gate: Linear) -> DataFrame:
    """``fp, h, gate`` from two vectors ``a, b``: ``gate * a + (1 - gate) * b`` with mean 0 and variance 1, where the gate is a sigmoid of both."""
    open_ = lambda a, b: sigmoid(gate(np.concatenate([a, b], axis=1)))

    def fuse(a, b):
        g = open_(a, b)
        return layer_norm(g * a + (1.0 - g) * b)

    return pairs.select("fp", apply(fuse, F.col("a"), F.col("b")).alias("h"), apply(open_, F.col("a"), F.col("b")).alias("gate"))
