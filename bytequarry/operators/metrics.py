"""Masked multilabel metrics over long prediction tables (``id, label_id, prob, target``, target null where unassessed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = tuple(round(0.1 + 0.05 * i, 2) for i in range(17))


def counts(threshold: Column) -> dict[str, Column]:
    """Confusion counts over assessed rows."""
    hit, y = F.col("prob") >= threshold, F.col("target")
    return {"tp": F.count_if(hit & (y == 1)), "fp": F.count_if(hit & (y == 0)), "fn": F.count_if(~hit & (y == 1)), "tn": F.count_if(~hit & (y == 0))}


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = over(tp, tp + fp), over(tp, tp + fn)
    den = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return {
        "precision": p, "recall": r, "f1": over(2 * tp, 2 * tp + fp + fn), "accuracy": over(tp + tn, tp + fp + fn + tn),
        "mcc": F.when(den > 0, (tp.cast("double") * tn - fp.cast("double") * fn) / den).otherwise(0.0),
    }


def per_label(pred: DataFrame, threshold: Column) -> DataFrame:
    n = pred.groupBy("label_id").agg(*[v.alias(k) for k, v in counts(threshold).items()], F.count("target").alias("assessed"))
    return n.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def average_precision(pred: DataFrame, bins: int = 4096) -> DataFrame:
    """Step-wise average precision of each label; null where only one class is assessed. Equal scores are one step.

    Scores (0 to 1) fall into bins; bins' sums give each bin its start, and running sums go
    within a bin, so no task orders all scores of a label.
    """
    steps = pred.where("target IS NOT NULL").groupBy("label_id", "prob").agg(F.sum("target").alias("p"), F.count("*").alias("n"))
    steps = steps.withColumn("bin", F.least(F.floor(F.col("prob") * bins), F.lit(bins)))
    sums = steps.groupBy("label_id", "bin").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    above = Window.partitionBy("label_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("label_id")
    first = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    sums = sums.select("label_id", "bin", first("bp").alias("ap"), first("bn").alias("an"), F.sum("bp").over(all_).alias("tp"), F.sum("bn").over(all_).alias("tn"))
    w = Window.partitionBy("label_id", "bin").orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"cp": F.sum("p").over(w), "cn": F.sum("n").over(w)}).join(sums, ["label_id", "bin"])
    part = F.when(F.col("tp") > 0, F.col("p") / F.col("tp") * ((F.col("cp") + F.col("ap")) / (F.col("cn") + F.col("an"))))
    return steps.groupBy("label_id").agg(F.when((F.max("tp") > 0) & (F.max("tp") < F.max("tn")), F.sum(part)).alias("ap"))


def masked_bce(pred: DataFrame) -> DataFrame:
    """Mean cross entropy over assessed rows, from probabilities and from their logits."""
    p = F.least(F.greatest(F.col("prob"), F.lit(1e-8)), F.lit(1 - 1e-8))
    y, x = F.col("target"), F.log(p / (1 - p))
    from_logit = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return pred.where("target IS NOT NULL").agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("bce"), F.avg(from_logit).alias("bce_logits"))


def masked_focal(pred: DataFrame, gamma: float = 2.0) -> DataFrame:
    p = F.least(F.greatest(F.col("prob"), F.lit(1e-8)), F.lit(1 - 1e-8))
    pt = F.when(F.col("target") == 1, p).otherwise(1 - p)
    return pred.where("target IS NOT NULL").agg(F.avg(-F.pow(1 - pt, F.lit(gamma)) * F.log(pt)).alias("focal"))


def sweep(pred: DataFrame, grid, *by: str) -> DataFrame:
    """Confusion counts of each group at every threshold of an ascending ``grid``.

    A row counts once, in the bin of thresholds that its score reaches; only the bins'
    counts, at most one more than thresholds for each group, meet the grid.
    """
    grid = [float(t) for t in grid]
    reached = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("prob")))
    y = F.col("target")
    bins = pred.groupBy(*by, reached.alias("bin")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"), F.count("target").alias("known"))
    rows = bins.withColumn("g", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(grid)])))
    hit = F.col("bin") >= F.col("g.i")
    count = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    return rows.groupBy(*by, F.col("g.threshold").alias("threshold")).agg(
        count("pos", hit).alias("tp"), count("neg", hit).alias("fp"), count("pos", ~hit).alias("fn"), count("neg", ~hit).alias("tn"), F.sum("known").alias("assessed")
    )


def threshold_sweep(pred: DataFrame, grid=GRID) -> DataFrame:
    """The lowest threshold with the best F1 of each label; 0.5 where nothing is assessed."""
    n = sweep(pred, grid, "label_id").withColumn("f1", rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])["f1"])
    best = n.groupBy("label_id").agg(F.max("assessed").alias("assessed"), F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("t"), F.max("f1").alias("f1"))
    return best.select("label_id", F.when(F.col("assessed") > 0, F.col("t")).otherwise(0.5).alias("threshold"), F.when(F.col("assessed") > 0, F.col("f1")).otherwise(0.0).alias("f1"))


#: The grid of cross-validation, as unrounded sums.
FOLD_GRID = tuple(0.1 + 0.05 * i for i in range(17))


def fold_thresholds(val: DataFrame, grid=FOLD_GRID) -> DataFrame:
    """``fold, label_id, threshold``: the lowest best threshold by F1 on validation rows; none with fewer than two assessed rows or no positive."""
    n = sweep(val, grid, "fold", "label_id").where("assessed >= 2 AND tp + fn > 0").withColumn("f1", rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])["f1"])
    return n.groupBy("fold", "label_id").agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"))


def cv_tuned(val: DataFrame, test: DataFrame) -> DataFrame:
    """``fold, label_id, threshold`` and rates on ``test`` at thresholds tuned on ``val`` (0.5 where none could be); labels without positives have zeros."""
    t = test.join(fold_thresholds(val), ["fold", "label_id"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    n = t.groupBy("fold", "label_id", "threshold").agg(*[v.alias(k) for k, v in counts(F.col("threshold")).items()])
    r = rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return n.withColumns({k: F.when(F.col("tp") + F.col("fn") > 0, r[k]).otherwise(0.0) for k in ("f1", "precision", "recall")})


def cv_summary(tuned: DataFrame) -> DataFrame:
    """Mean and population deviation over folds of macro F1 (all labels) and micro F1."""
    micro = lambda tp, fp, fn: F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    f = tuned.groupBy("fold").agg(F.avg("f1").alias("macro"), micro(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro"))
    return f.agg(*[g(c).alias(f"{c}_f1_{k}") for c in ("macro", "micro") for k, g in (("mean", F.avg), ("std", F.stddev_pop))])


def summary(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Macro over labels with assessed rows, micro over all, macro average precision, and exact-match accuracy."""
    labels = per_label(pred, F.lit(threshold)).where("assessed > 0")
    macro = labels.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1", "mcc")], *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    micro = rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    macro = macro.select(*[f"macro_{c}" for c in ("precision", "recall", "f1", "mcc")], *[micro[c].alias(f"micro_{c}") for c in ("precision", "recall", "f1")])
    ap = average_precision(pred).agg(F.avg("ap").alias("macro_ap"))
    return macro.join(ap).join(subset_accuracy(pred, threshold))


def subset_accuracy(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    right = pred.where("target IS NOT NULL").groupBy("id").agg(F.bool_and((F.col("prob") >= threshold) == (F.col("target") == 1)).alias("ok"))
    return right.agg(F.avg(F.col("ok").cast("double")).alias("subset_accuracy"))


def cv_macro(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per-fold macro F1 in which labels without positives count as 0, then mean and population deviation."""
    n = pred.groupBy("fold", "label_id").agg(*[v.alias(k) for k, v in counts(F.lit(threshold)).items()])
    f1 = F.when(F.col("tp") + F.col("fn") > 0, rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])["f1"]).otherwise(0.0)
    return n.groupBy("fold").agg(F.avg(f1).alias("f")).agg(F.avg("f").alias("macro_f1_mean"), F.stddev_pop("f").alias("macro_f1_std"))


def positive_weights(pred: DataFrame, low: float = 1.0, high: float = 100.0) -> DataFrame:
    """Negatives over positives of each label, held within bounds."""
    n = pred.groupBy("label_id").agg(F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("neg"))
    return n.withColumn("weight", F.least(F.greatest(F.col("neg") / F.greatest("pos", F.lit(1)), F.lit(low)), F.lit(high)))


def sample_weights(pred: DataFrame, cap: float = 20.0) -> DataFrame:
    """Each row's largest class weight over its positive labels, 1 without any."""
    n = pred.groupBy("label_id").agg(F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("neg"))
    w = n.where("pos > 0").select("label_id", F.least(F.col("neg") / F.col("pos"), F.lit(cap)).alias("w"))
    return pred.join(F.broadcast(w), "label_id", "left").groupBy("id").agg(F.greatest(F.coalesce(F.max(F.when(F.col("target") == 1, F.col("w"))), F.lit(1.0)), F.lit(1.0)).alias("weight"))


def batch_metrics(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit = F.col("prob") >= threshold
    return pred.where("target IS NOT NULL").agg(F.avg((hit == (F.col("target") == 1)).cast("double")).alias("accuracy"), F.avg(hit.cast("double")).alias("pred_rate"), F.avg(F.col("target").cast("double")).alias("target_rate"))
