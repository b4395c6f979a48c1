"""Cascades, tables for publication, monitoring and saved models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.functions.text import age_seconds, blank_to_null, clean
from bytequarry.operators.metrics import sweep
from bytequarry.operators.order import exact_quantiles


def failure_cause(ok: Column, *causes: Column) -> Column:
    """Empty where ``ok``; else the first cause that is filled, and ``graph_unavailable`` without any."""
    return F.when(ok, "").otherwise(F.coalesce(*[blank_to_null(c) for c in causes], F.lit("graph_unavailable")))


def backend(*tries: tuple[str, Column]) -> Column:
    """The first backend that succeeded, or ``none``."""
    out = None
    for name, ok in tries:
        out = F.when(ok, name) if out is None else out.when(ok, name)
    return out.otherwise("none")


def parse_classes(listed: str | None, observed: DataFrame, low: int = 100, high: int = 136) -> DataFrame:
    """Classes from a list such as ``101, 107``, or those observed within the range."""
    if listed:
        ids = sorted({int(x) for x in listed.replace(",", " ").split()})
        return observed.sparkSession.createDataFrame([(i,) for i in ids], "swc_id int")
    return observed.where(F.col("swc_id").between(low, high)).select("swc_id").distinct()


def enrich(base: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Feature tables beside each other for every row of ``base``; what is missing is 0."""
    both = parts[0]
    for p in parts[1:]:
        both = both.join(p, key, "full")
    out = base.join(both, key, "left")
    return out.na.fill(0, [c for c in both.columns if c != key])


def nested_sample(df: DataFrame, group: str, key: str, groups: int, rows: int, seed: int = 0) -> DataFrame:
    """``rows`` members of each of ``groups`` groups, chosen by hash: a sample whose size is its purpose."""
    h = lambda c: F.sha2(F.concat_ws("|", F.lit(seed), c.cast("string")), 256)
    chosen = df.select(group).distinct().orderBy(h(F.col(group)), group).limit(groups)
    w = Window.partitionBy(group).orderBy(h(F.col(key)), key)
    return df.join(F.broadcast(chosen), group, "left_semi").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= rows).drop("_r")


def with_baselines(agg: DataFrame, rows: list[tuple[str, str, float]]) -> DataFrame:
    """Aggregated runs and published results (variant, model, mean) as single runs without deviation."""
    extra = agg.sparkSession.createDataFrame([(v, m, 1, 1, x, 0.0) for v, m, x in rows], "variant string, model string, seeds long, n long, mean double, std double")
    return agg.select("variant", "model", "seeds", "n", "mean", "std").unionByName(extra)


def results_table(agg: DataFrame, variant: str, top: int) -> DataFrame:
    """Model and ``mean ± std`` of the best models: a report whose length is its purpose."""
    rows = agg.where(F.col("variant") == variant).orderBy(F.desc("mean"), "model").limit(top)
    return rows.select("model", F.format_string("%.4f ± %.4f", "mean", "std").alias("score"))


def metric_table(agg: DataFrame, metrics: list[str], key: str = "model") -> DataFrame:
    """Every model's ``mean ± std`` of each metric and its place by the first one (ties by name): one row a model."""
    order = Window.orderBy(F.desc(f"{metrics[0]}_mean"), key)
    cells = [F.format_string("%.4f ± %.4f", f"{m}_mean", f"{m}_std").alias(m) for m in metrics]
    return agg.select(F.row_number().over(order).alias("place"), key, *cells)


def ablation_table(agg: DataFrame, base: str, metric: str, key: str = "model") -> DataFrame:
    """Every model's mean and its signed difference from the base model's (``-`` for the base itself)."""
    b = agg.where(F.col(key) == base).select(F.col(f"{metric}_mean").alias("base"))
    d = F.col(f"{metric}_mean") - F.col("base")
    return agg.join(F.broadcast(b)).select(key, F.format_string("%.4f", f"{metric}_mean").alias(metric), F.when(F.col(key) == base, "-").otherwise(F.format_string("%+.4f", d)).alias("delta"))


def class_table(scores: DataFrame, top: int) -> DataFrame:
    """``model, label_id, f1, best`` of the ``top`` models by mean F1 over classes: whether none of them is better in that class."""
    mean = scores.groupBy("model").agg(F.avg("f1").alias("mean")).orderBy(F.desc("mean"), "model").limit(top)
    rows = scores.join(mean.select("model"), "model", "left_semi").groupBy("model", "label_id").agg(F.avg("f1").alias("f1"))
    return rows.withColumn("best", F.col("f1") == F.max("f1").over(Window.partitionBy("label_id")))


def efficiency_table(runs: DataFrame) -> DataFrame:
    """Runs, mean seconds and seconds relative to the fastest model, from ``model, seconds``."""
    n = runs.groupBy("model").agg(F.count("*").alias("runs"), F.avg("seconds").alias("seconds"))
    least = n.agg(F.min("seconds").alias("least"))
    return n.join(F.broadcast(least)).select("model", "runs", "seconds", F.when(F.col("least") > 0, F.col("seconds") / F.col("least")).alias("relative"))


def inner_features(parts: list[DataFrame], key: str) -> DataFrame:
    """Feature tables beside each other for the rows that all of them have."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key)
    return out


def quantiles(df: DataFrame, x: Column, *by: str) -> DataFrame:
    """Median and 95th percentile, null without values."""
    q = exact_quantiles(df, x, {"median": 0.5, "p95": 0.95}, *by)
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    same = F.expr(" AND ".join(f"g.`{c}` <=> q.`{c}`" for c in by) or "true")
    return groups.alias("g").join(q.alias("q"), same, "left").select("g.*", "median", "p95") if by else groups.join(q, F.lit(True), "left")


def stale_runs(runs: DataFrame, now: Column, seconds: int = 180) -> DataFrame:
    """Runs by status, and how many of the running ones have not reported for so long, to the microsecond."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.try_to_timestamp("updated").cast("timestamp"))
    late = (F.col("status") == "running") & (age > seconds * 1_000_000)
    return runs.groupBy("status").agg(F.count("*").alias("n"), F.count_if(late).alias("stale"))


def snapshot(runs: DataFrame, now: Column, seconds: int = 180) -> DataFrame:
    """One row for a monitor: runs by status, running ones that have gone quiet, the share that is done, and the age of the latest news."""
    n = lambda status: F.count_if(F.col("status") == status).alias(status)
    age = age_seconds(F.col("updated"), now)
    late = F.count_if((F.col("status") == "running") & (age > seconds)).alias("stale")
    done = F.count_if(F.col("status").isin("completed", "failed"))
    return runs.agg(F.count("*").alias("total"), *map(n, ("completed", "failed", "running", "pending")), late, F.round(done / F.count("*"), 6).alias("done_share"), F.min(age).alias("latest_age"))


def strict_threshold_sweep(pred: DataFrame, steps: int = 18, eps: float = 1e-9) -> DataFrame:
    """Thresholds 0.05, 0.10, ... with F1 smoothed by ``eps``; the lowest best one of each label."""
    n = sweep(pred.where("target IS NOT NULL"), [round(0.05 * (i + 1), 2) for i in range(steps)], "label_id")
    n = n.withColumn("f1", F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn") + eps), 9))
    return n.groupBy("label_id").agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def named(c: Column) -> Column:
    return F.when(clean(c) == "", "<UNKNOWN>").otherwise(clean(c))
