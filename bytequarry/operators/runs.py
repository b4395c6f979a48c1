"""Experiment runs: matrix, resuming, aggregation over seeds, significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.functions.text import run_id


def run_matrix(variants: DataFrame, models: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every variant, model and seed (small dimensions) as a pending run."""
    return variants.crossJoin(models).crossJoin(seeds).select("variant", "model", "seed", run_id(F.col("variant"), F.col("model"), F.col("seed")).alias("run_id"), F.lit("pending").alias("status"))


def resume(matrix: DataFrame, prior: DataFrame) -> DataFrame:
    """The matrix with the status of an earlier manifest; what was running is pending again."""
    j = matrix.drop("status").join(prior.select("run_id", "status"), "run_id", "left")
    return j.withColumn("status", F.when(F.col("status").isNull() | (F.col("status") == "running"), "pending").otherwise(F.col("status")))


def seed_aggregate(runs: DataFrame, by: list[str]) -> DataFrame:
    """Seeds, rows, mean and sample deviation (0 for one row) of the metric."""
    return runs.groupBy(*by).agg(F.count_distinct("seed").alias("seeds"), F.count("*").alias("n"), F.avg("metric").alias("mean"), F.coalesce(F.stddev_samp("metric"), F.lit(0.0)).alias("std"))


def leaderboard(agg: DataFrame, variant: str = "variant") -> DataFrame:
    return agg.withColumn("rank", F.row_number().over(Window.partitionBy(variant).orderBy(F.desc("mean"), "model")))


def ablation_delta(agg: DataFrame, base: str, other: str) -> DataFrame:
    """Difference of two variants' means for each model that has both."""
    side = lambda v, name: agg.where(F.col("variant") == v).select("model", F.col("mean").alias(name))
    return side(base, "base").join(side(other, "compare"), "model").withColumn("delta", F.col("compare") - F.col("base"))


def ablation_pivot(runs: DataFrame, variants: list[str]) -> DataFrame:
    return runs.groupBy("model").pivot("variant", variants).agg(F.avg("metric")).na.fill(0.0)


def bonferroni(p: DataFrame) -> DataFrame:
    """P-values times their number, at most 1."""
    n = p.agg(F.count("*").alias("_n"))
    return p.join(F.broadcast(n)).withColumn("p_adjusted", F.least(F.col("p") * F.col("_n"), F.lit(1.0))).drop("_n")


def cohens_d(a_mean: Column, a_var: Column, b_mean: Column, b_var: Column) -> Column:
    """Difference of means over the root of the mean variance; infinite where there is no variance."""
    s, d = F.sqrt((a_var + b_var) / 2), a_mean - b_mean
    return F.when(s > 0, d / s).when(d == 0, 0.0).when(d > 0, float("inf")).otherwise(float("-inf"))


def magnitude(d: Column) -> Column:
    x = F.abs(d)
    return F.when(x < 0.2, "negligible").when(x < 0.5, "small").when(x < 0.8, "medium").otherwise("large")


def pairwise_effects(runs: DataFrame) -> DataFrame:
    """Effect size of every two models (each pair once)."""
    s = runs.groupBy("model").agg(F.avg("metric").alias("m"), F.coalesce(F.var_samp("metric"), F.lit(0.0)).alias("v"))
    a, b = s.select(F.col("model").alias("a"), F.col("m").alias("ma"), F.col("v").alias("va")), s.select(F.col("model").alias("b"), F.col("m").alias("mb"), F.col("v").alias("vb"))
    d = cohens_d(F.col("ma"), F.col("va"), F.col("mb"), F.col("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", d.alias("d"), magnitude(d).alias("magnitude"))


def wilcoxon_ranks(pairs: DataFrame) -> DataFrame:
    """Signed-rank sums of paired scores ``x, y`` (differences under 1e-12 are ties and go; equal sizes share ranks)."""
    d = pairs.withColumn("d", F.col("x") - F.col("y"))
    live = d.where(F.abs("d") > 1e-12).withColumn("size", F.round(F.abs("d"), 9))
    w = Window.partitionBy("comparison")
    same = Window.partitionBy("comparison", "size")
    ranked = live.withColumn("i", F.row_number().over(w.orderBy("size"))).withColumns({"rank": F.avg("i").over(same), "t": F.count("*").over(same)})
    # each of t equal sizes adds t * t - 1, together t ** 3 - t
    ties = F.sum(F.col("t") * F.col("t") - 1).alias("ties")
    r = ranked.groupBy("comparison").agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"), F.count("*").alias("n"), ties)
    all_ = d.groupBy("comparison").agg(F.count("*").alias("pairs"))
    out = all_.join(r, "comparison", "left").na.fill(0, ["n", "ties"]).na.fill(0.0, ["w_plus", "w_minus"])
    return out.withColumn("w", F.least("w_plus", "w_minus"))


#: Differences up to which the signed-rank distribution is exact.
EXACT = 50


def rank_sum_ways(n: int) -> list[int]:
    """Of the 2 ** n sets of ranks 1 to n, those with each sum."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    return ways


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 0.3989422804014327 * F.exp(-z * z / 2) * poly


def with_wilcoxon_p(ranks: DataFrame) -> DataFrame:
    """Adds the two-sided ``p`` to :func:`wilcoxon_ranks`: NaN under three pairs, 1 under three differences.

    It is exact for up to ``EXACT`` pairs without a tied one (a table of a few thousand
    rows), else normal with the variance corrected for equal sizes.
    """
    rows = []
    for n in range(3, EXACT + 1):
        total = 0
        for s, ways in enumerate(rank_sum_ways(n)[: n * (n + 1) // 4 + 2]):
            total += ways
            rows.append((n, s, min(1.0, 2 * total / 2**n)))
    table = ranks.sparkSession.createDataFrame(rows, "n long, s long, exact double")
    j = ranks.withColumn("s", F.floor("w")).join(F.broadcast(table), ["n", "s"], "left")
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.abs(F.col("w") - n * (n + 1) / 4) / F.sqrt(var)
    p = F.when(F.col("pairs") < 3, float("nan")).when(F.col("n") < 3, 1.0).when(F.col("n") == F.col("pairs"), F.coalesce("exact", 2 * normal_tail(z))).otherwise(2 * normal_tail(z))
    return j.withColumn("p", F.when(F.isnan(p), p).otherwise(F.least(p, F.lit(1.0)))).drop("s", "exact")


def significance(scores: DataFrame, reference: str | None = None) -> DataFrame:
    """``a, b`` with signed-rank p-value, its correction for all pairs, and effect size, from ``model, seed, metric``.

    Every two models are compared once, or the reference with every other; scores pair by seed.
    """
    side = lambda m, x: scores.select(F.col("model").alias(m), "seed", F.col("metric").alias(x))
    which = (F.col("a") == reference) & (F.col("b") != reference) if reference else F.col("a") < F.col("b")
    pairs = side("a", "x").join(side("b", "y"), "seed").where(which)
    keyed = pairs.withColumn("comparison", F.struct("a", "b"))
    p = with_wilcoxon_p(wilcoxon_ranks(keyed)).select("comparison", "pairs", "w", "p")
    n = p.agg(F.count("*").alias("comparisons"))
    var = lambda c: F.coalesce(F.var_samp(c), F.lit(0.0))
    e = pairs.groupBy("a", "b").agg(F.avg("x").alias("mx"), var("x").alias("vx"), F.avg("y").alias("my"), var("y").alias("vy"))
    d = cohens_d(F.col("mx"), F.col("vx"), F.col("my"), F.col("vy"))
    out = p.select("comparison.a", "comparison.b", "pairs", "w", "p").join(F.broadcast(n)).join(e, ["a", "b"])
    adjusted = F.when(F.isnan("p"), F.col("p")).otherwise(F.least(F.col("p") * F.col("comparisons"), F.lit(1.0)))
    return out.select("a", "b", "pairs", "w", "p", adjusted.alias("p_adjusted"), d.alias("d"), magnitude(d).alias("magnitude"))


def seed_metrics(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Seeds, rows, and mean and sample deviation (0 for one row) of several metrics."""
    std = lambda m: F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std")
    return runs.groupBy(*by).agg(F.count_distinct("seed").alias("seeds"), F.count("*").alias("n"), *[f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), std(m))])


def select_runs(matrix: DataFrame, wanted: dict[str, list] | None = None, rerun_failed: bool = False, most: int | None = None) -> DataFrame:
    """The runs to do now: pending ones, and failed ones if asked, that pass every filter (column: allowed values).

    ``most`` is the size of one session, in order of ``run_id``; the rest stays pending.
    """
    todo = matrix.where(F.col("status").isin("pending", *["failed"] * rerun_failed))
    for column, values in (wanted or {}).items():
        todo = todo.where(F.col(column).isin(list(values)))
    return todo if most is None else todo.orderBy("run_id").limit(most)


def variant_faults(members: DataFrame, expected: DataFrame) -> DataFrame:
    """Splits whose members (``variant, split``) are not as many as a manifest (``variant, split, n``) says, or none at all."""
    n = members.groupBy("variant", "split").agg(F.count("*").alias("observed"))
    j = expected.join(n, ["variant", "split"], "full").select("variant", "split", F.coalesce("n", F.lit(0)).alias("expected"), F.coalesce("observed", F.lit(0)).alias("observed"))
    return j.where("expected <> observed OR observed = 0").withColumn("fault", F.when(F.col("expected") != F.col("observed"), "count_mismatch").otherwise("empty_split"))


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("n"))


def completeness(matrix: DataFrame, results: DataFrame) -> DataFrame:
    """Runs, runs with a result, and runs without one, by variant."""
    j = matrix.join(results.select("run_id").distinct().withColumn("done", F.lit(True)), "run_id", "left")
    return j.groupBy("variant").agg(F.count("*").alias("runs"), F.count_if("done").alias("completed"), F.count_if(F.col("done").isNull()).alias("missing"))
