"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.llm.shared import cut, drop


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


#: A node's links are dealt over so many keys before they meet.
SALTS = 64


def _least(links: DataFrame, with_self: bool) -> DataFrame:
    """``u, v, m`` for every link (columns ``u, v``), where m is u's smallest neighbour (or u itself, if asked and smaller).

    The links of a node with very many of them meet as at most ``SALTS`` rows, and go on
    from as many tasks.
    """
    salted = links.withColumn("g", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    part = salted.groupBy("u", "g").agg(F.min("v").alias("low"))
    low = part.groupBy("u").agg(F.min("low").alias("m"))
    spread = part.join(low, "u").select("u", "g", F.least("m", "u").alias("m") if with_self else "m")
    return salted.join(spread, ["u", "g"]).select("u", "v", "m")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (columns ``a, b``); the component is its smallest node.

    Each round is written to the shared folder, and the one before it is deleted. Self
    links and repeated links do no harm; no links give an empty result.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _print(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of u links to u's smallest
        large = _least(both, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large-star")
        # small star: u and its smaller neighbours link to u's smallest
        least = _least(large, False)
        small = least.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        after = cut(small.distinct(), "small-star")
        drop(edges, large)
        edges, before, seen = after, seen, _print(after)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components: still changing after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
