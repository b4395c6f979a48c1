"""The relations behind the figures of a comparison of models; drawing them is left to others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bars(agg: DataFrame, mean: str, std: str) -> DataFrame:
    """``place, model, mean, std``: bars with error bars, the highest first (ties by name; a missing mean counts as 0).

    ``agg`` has one row a model, which one task puts in order.
    """
    x = agg.select("model", F.coalesce(F.col(mean), F.lit(0.0)).alias("mean"), F.coalesce(F.col(std), F.lit(0.0)).alias("std"))
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "model"))).select("place", "model", "mean", "std")


def grouped_bars(agg: DataFrame, metrics: list[str], by: str, top: int) -> DataFrame:
    """``place, model, metric, at, mean, std``: several metrics (in order ``at``) of the ``top`` models by one of them."""
    best = bars(agg, f"{by}_mean", f"{by}_std").where(F.col("place") <= top).select("place", "model")
    long = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(i).alias("at"), F.coalesce(F.col(f"{m}_mean"), F.lit(0.0)).alias("mean"), F.coalesce(F.col(f"{m}_std"), F.lit(0.0)).alias("std")) for i, m in enumerate(metrics)])
    return agg.join(best, "model").select("place", "model", F.explode(long).alias("x")).select("place", "model", "x.*")


def heatmap(scores: DataFrame, models: list[str]) -> DataFrame:
    """``row, col, model, label_id, value``: mean F1 of each model of a list in each class that any of them has, 0 where it has none; classes in order."""
    wanted = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    own = scores.where(F.col("model").isin(models)).groupBy("model", "label_id").agg(F.avg("f1").alias("value"))
    # one row a class; the list of models is a parameter
    classes = own.select("label_id").distinct().withColumn("col", F.row_number().over(Window.orderBy("label_id")) - 1)
    cells = classes.select("label_id", "col", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return cells.join(own, ["model", "label_id"], "left").select((wanted - 1).cast("int").alias("row"), "col", "model", "label_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def shade(value, low: float = 0.2, high: float = 0.75):
    """The colour of a cell's number: white on dark and on bright cells."""
    return F.when((value <= low) | (value >= high), "white").otherwise("black")


def delta_bars(deltas: DataFrame) -> DataFrame:
    """``model, comparison, value, offset``: mean deltas of every model in every comparison, 0 where there is none, and each bar's place beside its model's."""
    n = deltas.groupBy("model", "comparison").agg(F.avg("delta").alias("value"))
    # one row a comparison
    all_ = n.select("comparison").distinct().withColumn("k", F.row_number().over(Window.orderBy("comparison")) - 1)
    listed = all_.agg(F.sort_array(F.collect_list(F.struct("k", "comparison"))).alias("c"))
    cells = n.select("model").distinct().join(F.broadcast(listed)).select("model", F.explode("c").alias("c"), F.size("c").alias("of"))
    j = cells.select("model", F.col("c.comparison").alias("comparison"), ((F.col("c.k") - (F.col("of") - 1) / 2) * 0.4).alias("offset")).join(n, ["model", "comparison"], "left")
    return j.select("model", "comparison", F.coalesce("value", F.lit(0.0)).alias("value"), "offset")
