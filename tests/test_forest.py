"""Forests whose trees are grown in tasks."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from bytequarry.operators import forest, learn


def noisy(spark, n):
    """Three features of a dozen values, and a target that they tell apart in part only."""
    value = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(12)).cast("double")
    table = spark.range(0, n, 1, 3).select("id", *[value(k).alias(f"f{k}") for k in (1, 2, 3)])
    features = table.select("id", array_to_vector(F.array("f1", "f2", "f3")).alias("x"))
    target = (F.col("f1") + F.col("f2") + F.pmod(F.xxhash64("id", F.lit(9)), F.lit(9)) > 16).cast("int")
    return features, table.select("id", F.lit(1).alias("label_id"), F.when(F.col("id") % 7 > 0, target).alias("target"))


def probs(df):
    return {(r["id"], r["label_id"]): r["prob"] for r in df.collect()}


def test_forest_leaves_no_nodes_on_the_driver(spark, monkeypatch):
    """The driver gets neither trees nor models: nodes below its limit are only in the written table."""
    from pyspark.ml.classification import RandomForestClassifier

    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *a: pytest.fail("Spark's forest keeps all nodes on the driver"))
    made, fit_each = [], forest.fit_each
    monkeypatch.setattr(forest, "fit_each", lambda *a: made.append(fit_each(*a)) or made[-1])
    features, targets = noisy(spark, 3000)
    got = probs(learn.one_vs_rest(features, targets, "forest", numTrees=4, rows=600))
    assert len(got) == 3000
    held = [len(top.feature) for of in made[0].tops for top, _ in of]
    assert made[0].trees.count() > 8 and max(held) < 32
    grown = made[0].trees.agg(F.sum(F.length("grown"))).first()[0]
    assert grown > 100 * sum(held)


def test_forest_does_not_depend_on_what_the_driver_splits(spark):
    features, targets = noisy(spark, 2000)
    both = targets.union(targets.withColumns({"label_id": F.lit(2), "target": 1 - F.col("target")}))
    one, many = (probs(learn.one_vs_rest(features, both, "forest", numTrees=13, rows=n)) for n in (1 << 18, 100))
    assert one == many and len(one) == 4000


def test_forest_of_one_tree_is_sparks(spark):
    """Without draws and with all features nothing is left to chance."""
    features, targets = noisy(spark, 4000)
    for depth in (3, 30):
        got = probs(learn.one_vs_rest(features, targets, "forest", numTrees=1, bootstrap=False, maxDepth=depth, rows=900))
        y = targets.where("target IS NOT NULL")
        pos, n = y.where("target = 1").count(), y.count()
        train = features.join(y, "id").select("x", F.col("target").cast("double").alias("y"), F.when(F.col("target") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))).alias("w"))
        model = learn._estimator("forest", numTrees=1, bootstrap=False, maxDepth=depth).fit(train)
        want = {r["id"]: r["probability"][1] for r in model.transform(features).select("id", "probability").collect()}
        assert sum(abs(got[i, 1] - p) > 1e-9 for i, p in want.items()) <= 0.002 * len(want)


def test_forest_is_as_good_as_sparks(spark):
    features, targets = noisy(spark, 3000)
    train = targets.where("id % 3 > 0")
    y = {r["id"]: r["target"] for r in targets.where("id % 3 = 0 AND target IS NOT NULL").collect()}
    got = probs(learn.one_vs_rest(features, train, "forest", numTrees=40))
    rows = train.where("target IS NOT NULL").select("id", F.col("target").cast("double").alias("y"), F.lit(1.0).alias("w"))
    model = learn._estimator("forest", numTrees=40).fit(features.join(rows, "id"))
    want = {r["id"]: r["probability"][1] for r in model.transform(features).select("id", "probability").collect()}
    loss = lambda p: np.mean([(p(i) - t) ** 2 for i, t in y.items()])
    assert loss(lambda i: got[i, 1]) < loss(want.get) + 0.01


def test_forest_draws_are_poisson():
    rows = forest.mixed(np.arange(20000, dtype=np.uint64))
    c = np.stack([forest.draws(rows, forest.Settings(), t) for t in (0, 1)])
    assert np.all(abs(np.stack([(c == k).mean(axis=1) for k in range(4)]) - np.array([0.3679, 0.3679, 0.1839, 0.0613])[:, None]) < 0.012)
    assert abs(np.corrcoef(c)[0, 1]) < 0.03
    looked = forest.looked_at(rows, 6, forest.Settings())
    assert looked.shape == (20000, 3) and np.all(np.diff(looked, axis=1) > 0)
    assert np.all(abs(np.bincount(looked.reshape(-1)) / 20000 - 0.5) < 0.02)


def test_forest_of_few_rows(spark):
    """Labels with one class, none at all, and so few rows that some trees draw none; ids of any type, repeated ones too."""
    features = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), (None, 4.0)], "id string, v double").select("id", array_to_vector(F.array("v")).alias("x"))
    targets = spark.createDataFrame([("a", "p", 0), ("b", "p", 1), ("a", "q", 1), ("b", "r", None)], "id string, label_id string, target int")
    got = sorted((r["label_id"], r["id"] or "", r["prob"]) for r in learn.one_vs_rest(features, targets, "forest", numTrees=30).collect())
    assert [r[:2] for r in got] == [(k, i) for k in "pqr" for i in ("", "a", "b", "b")]
    p, q, r = ([v for k, _, v in got if k == label] for label in "pqr")
    assert q == [1.0] * 4 and r == [0.0] * 4 and p[1] < 0.5 < min(p[0], p[2], p[3]) and max(p) <= 1
