"""Places and quantiles in an order over all rows, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, keys: list[str], parts: int = 64) -> DataFrame:
    """Adds ``i``, each row's place (from 0) in the order of ``keys`` (no nulls).

    Rows are dealt by ranges of the keys whose bounds come from the ``16 * parts`` rows of
    least hash; only the ranges' counts are summed up in one place. Places are exact
    whatever the bounds.
    """
    sample = sorted(tuple(r) for r in df.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(16 * parts).collect())
    bounds = sorted(set(sample[16::16]))
    row = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    limits = F.array(*[F.struct(*[F.lit(x).alias(f"k{i}") for i, x in enumerate(b)]) for b in bounds])
    placed = df.withColumn("_part", F.size(F.filter(limits, lambda b: b <= row)) if bounds else F.lit(0))
    # one row for each range
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    return own.join(F.broadcast(before), "_part").withColumn("i", F.col("_r") - 1 + F.col("_before")).drop("_part", "_r", "_before")


def exact_quantiles(df: DataFrame, x: Column, probs: dict[str, float], *by: str, parts: int = 256) -> DataFrame:
    """Each group's quantiles (a column for each entry of ``probs``), interpolated between the two nearest values.

    Equal values are counted first. Some ``parts`` of them, by hash, cut a group into ranges,
    the ranges' counts tell which range holds each wanted place, and only those ranges' values
    are ordered. The ranges are used twice, so they depend on nothing but the values (approximate
    quantiles would differ by the order in which rows meet). Missing values do not count;
    groups without values are left out.
    """
    by = list(by) or ["_all"]
    counted = df.select(*([F.lit(0).alias("_all")] if by == ["_all"] else by), x.cast("double").alias("_x")).where("_x IS NOT NULL").groupBy(*by, "_x").agg(F.count("*").alias("_c"))
    same = lambda a, b: F.expr(" AND ".join(f"{a}.`{c}` <=> {b}.`{c}`" for c in by))
    sizes = counted.groupBy(*by).agg(F.sum("_c").alias("_n"), F.count("*").alias("_d"))
    chosen = counted.alias("c").join(sizes.alias("b"), same("c", "b")).where(F.pmod(F.xxhash64("_x"), F.ceil(F.col("_d") / parts)) == 0)
    chosen = chosen.groupBy(*[F.col(f"c.{c}").alias(c) for c in by]).agg(F.array_sort(F.collect_list("_x")).alias("_bounds"))
    bounds = sizes.alias("c").join(chosen.alias("b"), same("c", "b"), "left").select(*[F.col(f"c.{c}").alias(c) for c in by], "_n", F.coalesce("_bounds", F.array().cast("array<double>")).alias("_bounds"))
    ranged = counted.alias("c").join(bounds.alias("b"), same("c", "b")).select(*[F.col(f"c.{c}").alias(c) for c in by], "_x", "_c", "_n", F.size(F.filter("_bounds", lambda b: b < F.col("_x"))).alias("_bin"))
    bins = ranged.groupBy(*by, "_bin").agg(F.sum("_c").alias("_m"), F.first("_n").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_bin")
    bins = bins.withColumn("_end", F.sum("_m").over(upto)).withColumn("_start", F.col("_end") - F.col("_m"))
    places = [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), getattr(F, side)(F.lit(p) * (F.col("_n") - 1)).alias("at")) for name, p in probs.items() for side in ("floor", "ceil")]
    wanted = bins.select(*by, "_bin", "_start", "_end", "_n", F.explode(F.array(*places)).alias("w")).where("w.at >= _start AND w.at < _end")
    needed = wanted.groupBy(*by, "_bin").agg(F.first("_start").alias("_start"), F.first("_n").alias("_n"), F.collect_list("w").alias("w"))
    inside = ranged.drop("_n").alias("c").join(needed.alias("b"), same("c", "b") & F.expr("c._bin = b._bin")).select(*[F.col(f"c.{c}").alias(c) for c in by], F.col("c._bin").alias("_bin"), "_x", "_c", "_start", "_n", "w")
    run = Window.partitionBy(*by, "_bin").orderBy("_x")
    inside = inside.withColumn("_end", F.col("_start") + F.sum("_c").over(run)).withColumn("w", F.filter("w", lambda w: (w["at"] < F.col("_end")) & (w["at"] >= F.col("_end") - F.col("_c"))))
    found = inside.select(*by, "_n", "_x", F.explode("w").alias("w"))
    pick = lambda name, side: F.max(F.when((F.col("w.name") == name) & (F.col("w.side") == side), F.col("_x")))
    n = F.first("_n")
    part = lambda p: F.lit(p) * (n - 1) - F.floor(F.lit(p) * (n - 1))
    out = found.groupBy(*by).agg(*[(pick(k, "floor") + (pick(k, "ceil") - pick(k, "floor")) * part(p)).alias(k) for k, p in probs.items()])
    return out.drop("_all")
