"""Queries over graph layers, with parameters made by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytequarry.functions import evm
from bytequarry.operators import features, graphs, layers, steps
from bytequarry.operators.layers import Linear
from bytequarry.plans import proxies as P
from bytequarry.plans.graph_queries import _PROG_INS, _REINDEX, _iedges
from bytequarry.plans.registry import query

WIDTH, HEADS, TYPES = 8, 2, 9


def _number(*at: int) -> float:
    return (sum((31 * k + 17) * (x + 3) for k, x in enumerate(at)) % 23 - 11) / 16


def _matrix(name: int, rows: int, columns: int) -> layers.Matrix:
    return [[_number(name, i, j) for j in range(columns)] for i in range(rows)]


def _linear(name: int, rows: int = WIDTH, columns: int = WIDTH) -> Linear:
    return Linear(_matrix(name, rows, columns), [_number(name, i) for i in range(rows)])


_typed = [[_linear(100 * kind + t) for t in range(TYPES)] for kind in (1, 2, 3)]
LAYER = layers.TypedAttention(*_typed, out=_linear(4), widen=_linear(5, 4 * WIDTH), narrow=_linear(6, WIDTH, 4 * WIDTH), heads=HEADS)
CONVOLUTIONS = [_linear(7), _linear(8)]
PROJECT, SOURCE, TARGET, BIAS = _linear(9), _matrix(10, HEADS, WIDTH // HEADS), _matrix(11, HEADS, WIDTH // HEADS), [_number(12, i) for i in range(WIDTH)]
GATE = _linear(13, WIDTH, 2 * WIDTH)
TABLE, PLACE, EMBED = _matrix(14, 257, 4), _linear(15, 2, 1), _linear(16, WIDTH, 6)


def _graph(s, d):
    """Nodes with vectors and typed edges of the programs' control flow."""
    ins, found = _iedges(s, d)
    at = steps.written(graphs.node_table(ins).select("fp", "node", "pc", "opcode_id"), "node_table")
    nodes = layers.embed(at.withColumn("pc", F.col("pc") / F.lit(64.0)), TABLE, PLACE, EMBED)
    return steps.written(nodes, "nodes"), steps.written(graphs.reindex(at, found), "edges")


def _out(df, *vectors: str):
    """Vectors as columns, rounded."""
    return df.select(*[c for c in df.columns if c not in vectors], *[F.round(F.get(v, i), 5).alias(f"{v}{i}") for v in vectors for i in range(WIDTH)])


def _sql(linear: Linear, x: str) -> str:
    y = f"list_transform({linear.weight}, lambda r: list_dot_product(r, {x}))"
    return f"list_transform(list_zip({y}, {linear.bias}), lambda z: z[1] + z[2])" if linear.bias else y


def _typed_sql(of: list[Linear], x: str) -> str:
    weight, bias = [a.weight for a in of], [a.bias for a in of]
    return f"list_transform(list_zip(list_transform(({weight})[type_id + 1], lambda r: list_dot_product(r, {x})), ({bias})[type_id + 1]), lambda z: z[1] + z[2])"


_add = lambda a, b: f"list_transform(list_zip({a}, {b}), lambda z: z[1] + z[2])"
_round = lambda *v: ", ".join(f"round({x}[{i + 1}], 5) AS {x}{i}" for x in v for i in range(WIDTH))
_norm = lambda x, name, source: f"{name} AS MATERIALIZED (SELECT * EXCLUDE (y, a), list_transform(y, lambda v: (v - a) / sqrt(list_avg(list_transform(y, lambda u: (u - a) * (u - a))) + {layers.EPSILON})) AS h FROM (SELECT *, list_avg(y) AS a FROM (SELECT * EXCLUDE (h), {x} AS y FROM {source})))"
_erf = lambda v: f"(1.1283791670955126 * exp(-({v}) * ({v})) * list_sum(list_transform(range(60), lambda n: pow({v}, 2 * n + 1) * exp(n * ln(4) + lgamma(n + 1) - lgamma(2 * n + 2)))))"
_H0 = f"""{_PROG_INS}, {_REINDEX},
h0 AS MATERIALIZED (SELECT fp, node, {_sql(EMBED, f"list_concat(({TABLE})[opcode_id + 1], {_sql(PLACE, '[pc / 64.0::DOUBLE]')})")} AS h FROM nodes),
loops AS (SELECT fp, s, t FROM re WHERE s <> t UNION ALL SELECT fp, node, node FROM nodes)"""
#: Each head's softmax over the edges into a node, from sc (fp, t, score, v).
_ATTEND = f"""hd AS (SELECT fp, t, k, score[k + 1] AS x, v[{WIDTH // HEADS} * k + 1:{WIDTH // HEADS} * (k + 1)] AS v FROM (SELECT *, unnest(range({HEADS})) AS k FROM sc)),
sm AS (SELECT fp, t, k, e, list_transform(v, lambda u: u * e) AS v FROM (SELECT *, exp(x - max(x) OVER (PARTITION BY fp, t, k)) AS e FROM hd)),
ms AS (SELECT fp, t, k, i, sum(v[i]) / any_value(z) AS u FROM (SELECT *, sum(e) OVER (PARTITION BY fp, t, k) AS z, unnest(range(1, {WIDTH // HEADS} + 1)) AS i FROM sm) GROUP BY fp, t, k, i),
m AS MATERIALIZED (SELECT fp, t AS node, list(u ORDER BY k, i) AS m FROM ms GROUP BY fp, t)"""


def _convolution_sql(k: int, layer: Linear) -> str:
    # the window counts a target's edges again, as sums over components do not need it before
    return f"""g{k} AS (SELECT l.fp, l.t, i, sum(x.w[i] / sqrt(ds.n) / sqrt(dt.n)) AS u FROM loops l JOIN (SELECT fp, node, {_sql(Linear(layer.weight), "h")} AS w FROM h{k}) x ON x.fp = l.fp AND x.node = l.s
  JOIN dg ds ON ds.fp = l.fp AND ds.t = l.s JOIN dg dt ON dt.fp = l.fp AND dt.t = l.t, (SELECT unnest(range(1, {WIDTH + 1})) AS i) GROUP BY ALL),
h{k + 1} AS MATERIALIZED (SELECT fp, t AS node, list_transform({_add(f"list(u ORDER BY i)", str(layer.bias))}, lambda v: greatest(v, 0.0)) AS h FROM g{k} GROUP BY fp, t)"""


@query("graph_convolution", f"WITH RECURSIVE {_H0}, dg AS MATERIALIZED (SELECT fp, t, count(*)::DOUBLE AS n FROM loops GROUP BY fp, t), {', '.join(_convolution_sql(k, x) for k, x in enumerate(CONVOLUTIONS))} SELECT fp, node::INT AS node, {_round('h')} FROM h2")
def graph_convolution(s, d):
    """Two normalised convolutions."""
    nodes, edges = _graph(s, d)
    for layer in CONVOLUTIONS:
        nodes = layers.convolve(nodes, edges, layer, "relu")
    return _out(nodes, "h")


@query("graph_attention", f"""WITH RECURSIVE {_H0},
pj AS MATERIALIZED (SELECT fp, node, {_sql(Linear(PROJECT.weight), "h")} AS w FROM h0),
sc AS MATERIALIZED (SELECT l.fp, l.t, list_transform(list_transform(range({HEADS}), lambda k: list_dot_product(({SOURCE})[k + 1], a.w[4 * k + 1:4 * k + 4]) + list_dot_product(({TARGET})[k + 1], b.w[4 * k + 1:4 * k + 4])), lambda x: CASE WHEN x > 0 THEN x ELSE 0.2 * x END) AS score, a.w AS v
  FROM loops l JOIN pj a ON a.fp = l.fp AND a.node = l.s JOIN pj b ON b.fp = l.fp AND b.node = l.t), {_ATTEND},
o AS (SELECT fp, node, {_add("m", str(BIAS))} AS h FROM m) SELECT fp, node::INT AS node, {_round("h")} FROM o""")
def graph_attention(s, d):
    """Attention over neighbours by scores of both ends."""
    nodes, edges = _graph(s, d)
    return _out(layers.graph_attention(nodes, edges, PROJECT, SOURCE, TARGET, BIAS), "h")


_TYPED = f"""{_H0},
sc AS MATERIALIZED (SELECT fp, t, list_transform(range({HEADS}), lambda k: list_dot_product(q[4 * k + 1:4 * k + 4], kk[4 * k + 1:4 * k + 4]) / 2.0) AS score, v FROM (
  SELECT re.fp, re.t, {_typed_sql(LAYER.query, "b.h")} AS q, {_typed_sql(LAYER.key, "a.h")} AS kk, {_typed_sql(LAYER.value, "a.h")} AS v
  FROM re JOIN h0 a ON a.fp = re.fp AND a.node = re.s JOIN h0 b ON b.fp = re.fp AND b.node = re.t)), {_ATTEND},
j AS (SELECT h0.fp, h0.node, h, coalesce(m, list_transform(range({WIDTH}), lambda i: 0.0::DOUBLE)) AS m FROM h0 LEFT JOIN m USING (fp, node)),
{_norm(_add("h", _sql(LAYER.out, "m")), "n1", "j")},
{_norm(_add("h", _sql(LAYER.narrow, f"list_transform({_sql(LAYER.widen, 'h')}, lambda w: 0.5 * w * (1 + {_erf('w / sqrt(2)')}))")), "n2", "n1")}"""


@query("typed_attention", f"WITH RECURSIVE {_TYPED} SELECT fp, node::INT AS node, {_round('h')} FROM n2")
def typed_attention(s, d):
    """One whole layer of attention over typed edges."""
    nodes, edges = _graph(s, d)
    return _out(layers.typed_attention(nodes, edges, LAYER), "h")


_POOLED = f"""po AS (SELECT fp, list(a ORDER BY i) AS mean, list(b ORDER BY i) AS top FROM (SELECT fp, i, avg(h[i]) AS a, max(h[i]) AS b FROM (SELECT *, unnest(range(1, {WIDTH + 1})) AS i FROM n2) GROUP BY fp, i) GROUP BY fp),
gt AS (SELECT *, list_transform({_sql(GATE, "list_concat(mean, top)")}, lambda v: 1 / (1 + exp(-v))) AS gate, mean AS h FROM po),
{_norm("list_transform(list_zip(gate, mean, top), lambda z: z[1] * z[2] + (1 - z[1]) * z[3])", "fu", "gt")}"""


@query("graph_fusion", f"WITH RECURSIVE {_TYPED}, {_POOLED} SELECT fp, {_round('h', 'gate')} FROM fu")
def graph_fusion(s, d):
    """Mean and maximum of each graph after a layer, fused by a gate."""
    nodes, edges = _graph(s, d)
    both = layers.pooled(layers.typed_attention(nodes, edges, LAYER), WIDTH)
    return _out(layers.gated_fusion(both.select("fp", F.col("mean").alias("a"), F.col("top").alias("b")), GATE), "h", "gate")


#: Vectors of the tokens: opcode ids plus three, two marks and a blank.
VECTORS = _matrix(17, 259, WIDTH)


@query("window_embeddings", f"""WITH RECURSIVE {_PROG_INS},
tk AS (SELECT fp, row_number() OVER (PARTITION BY fp ORDER BY pc) - 1 AS k, count(*) OVER (PARTITION BY fp) AS len, opcode_id + 3 AS token FROM ins),
wi AS (SELECT fp, len, unnest(range(CASE WHEN len > 32 THEN (len + 15) // 16 ELSE 1 END)) AS w FROM (SELECT DISTINCT fp, len FROM tk)),
wt AS (SELECT wi.fp, w, token FROM wi JOIN tk USING (fp) WHERE wi.len <= 32 OR k BETWEEN 16 * w AND 16 * w + 31 UNION ALL SELECT fp, w, unnest([1, 2]) FROM wi),
wm AS (SELECT fp, w, i, avg(({VECTORS})[token + 1][i]) AS m FROM (SELECT *, unnest(range(1, {WIDTH + 1})) AS i FROM wt) GROUP BY ALL),
tm AS (SELECT fp, i, count(*) AS windows, avg(m) AS m FROM wm GROUP BY ALL)
SELECT fp AS id, any_value(windows) AS windows, {", ".join(f"round(any_value(m) FILTER (WHERE i = {i + 1}), 5) AS h{i}" for i in range(WIDTH))} FROM tm GROUP BY fp""")
def window_embeddings(s, d):
    """Mean vectors of the programs' opcodes over windows of 32 that start every 16."""
    ids = evm.opcode_ids(P.programs(s, d)).where(F.size("ids") > 0)
    texts = ids.select(F.col("fp").cast("long").alias("id"), F.transform("ids", lambda x: x + 3).alias("tokens"))
    vectors = s.createDataFrame(list(enumerate(VECTORS)), "token int, v array<double>")
    return _out(features.window_embeddings(texts, vectors, WIDTH, size=34, stride=16), "h")
