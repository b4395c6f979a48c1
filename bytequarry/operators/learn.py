"""Masked one-vs-rest learners over Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.operators import boost, forest, network
from bytequarry.operators.metrics import per_label
from bytequarry.operators.steps import written


def text_features(docs: DataFrame) -> DataFrame:
    """``id, x``: a few numbers about each text as a vector."""
    from pyspark.ml.functions import array_to_vector

    t = F.coalesce("text", F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    share = lambda p: F.regexp_count(t, F.lit(p)) / n
    x = F.array(F.log1p(F.length(t)), share(r"[#*$%&|<>]"), share(r"[A-Z]"), share(r"\s"), share(r"[.!?]"), share(r"\n"))
    return docs.select(F.col("doc_id").alias("id"), array_to_vector(x).alias("x"))


def line_features(docs: DataFrame) -> DataFrame:
    """``id, x``: a few numbers about the lines and words of each text as a vector."""
    from pyspark.ml.functions import array_to_vector

    t = F.coalesce("text", F.lit(""))
    lines, words = F.split(t, "\n", -1), F.regexp_count(t, F.lit(r"\S+"))
    n = F.size(lines)
    x = F.array(F.log1p(n), F.size(F.array_distinct(lines)) / n, F.log1p(words), F.length(t) / F.greatest(words, F.lit(1)), F.regexp_count(t, F.lit(r"[0-9]")) / F.greatest(F.length(t), F.lit(1)))
    return docs.select(F.col("doc_id").alias("id"), array_to_vector(x).alias("x"))


#: What a network may see of two tables of features.
MODES = ("first_only", "second_only", "both")


def by_mode(first: DataFrame, second: DataFrame, mode: str) -> DataFrame:
    """``id, x``: one of two tables of features, or for rows of the first both beside each other (zeros where the second has none)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if mode not in MODES:
        raise ValueError(f"mode is not one of {', '.join(MODES)}: {mode}")
    if mode != "both":
        return first if mode == "first_only" else second
    row = second.select("x").first()
    none = F.array_repeat(F.lit(0.0), len(row["x"]) if row else 0)
    side = lambda df, c: df.select("id", vector_to_array("x").alias(c))
    j = side(first, "a").join(side(second, "b"), "id", "left")
    return j.select("id", array_to_vector(F.concat("a", F.coalesce("b", none))).alias("x"))


#: Sizes of the learners, those of the reference; its forest has no depth limit, and 30 is Spark's largest.
LOGISTIC = {"maxIter": 200, "regParam": 0.01}
FOREST = {"numTrees": 300, "maxDepth": 30, "seed": 7}
#: What :mod:`forest`, which grows the trees of Spark's RandomForestClassifier, calls its parameters.
FOREST_NAMES = {"numTrees": "trees", "maxDepth": "depth", "maxBins": "bins", "seed": "seed", "bootstrap": "bootstrap", "rows": "rows"}
BOOSTED = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.1, "seed": 7}


#: Leaf-wise boosting by histograms; it ends early on a fifth of the rows, by the hash of their id.
LEAFWISE = {"rounds": 300, "leaves": 31, "rate": 0.1, "patience": 15}


#: What Spark's GBTClassifier does with :data:`BOOSTED`, by :mod:`boost`: levels to a depth of 6, 32 bins, no least size of a leaf.
RESIDUALS = {"rounds": BOOSTED["maxIter"], "rate": BOOSTED["stepSize"], "depth": BOOSTED["maxDepth"], "leaves": 1 << BOOSTED["maxDepth"], "bins": 32, "least_rows": 1, "least_hessian": 0.0, "residuals": True}


#: Two hidden layers of logistic units, fitted by :mod:`network`, which takes row weights.
NETWORK = {"maxIter": 200, "seed": 7}
HIDDEN = (64, 64)


def _estimator(kind: str, **other):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    common = {"featuresCol": "x", "labelCol": "y", "weightCol": "w"}
    if kind == "logistic":
        return LogisticRegression(**(LOGISTIC | other), **common)
    if kind == "forest":
        # rows keep the node that they are in for each tree; else all trees so far travel with every pass
        return RandomForestClassifier(**(FOREST | other), cacheNodeIds=True, **common)
    return GBTClassifier(**(BOOSTED | other), **common)


def one_vs_rest(features: DataFrame, targets: DataFrame, kind: str = "logistic", **other) -> DataFrame:
    """``id, label_id, prob`` of one model for each label, fitted on its assessed rows with balanced weights.

    A label without assessed rows gets 0, one with a single class that class, for every row.
    ``other`` replaces parameters of the learner.
    """
    from pyspark.ml.functions import vector_to_array

    sizes = targets.groupBy("label_id").agg(F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("neg")).orderBy("label_id").collect()
    out = []
    # every label's fit reads the features again and again
    features = written(features, "features")
    if kind in ("forest", "leafwise", "boosted", "network"):
        return _in_step(features, targets, sizes, kind, **other)
    for r in sizes:  # a few dozen labels
        if not r["pos"] or not r["neg"]:
            out.append(features.select("id", F.lit(r["label_id"]).alias("label_id"), F.lit(float(r["pos"] > 0)).alias("prob")))
            continue
        n = r["pos"] + r["neg"]
        rows = targets.where((F.col("label_id") == r["label_id"]) & F.col("target").isNotNull()).select("id", F.col("target").cast("double").alias("y"))
        rows = rows.withColumn("w", F.when(F.col("y") == 1, n / (2 * r["pos"])).otherwise(n / (2 * r["neg"])))
        train = features.join(rows, "id")
        model = _estimator(kind, **other).fit(train)
        scored = model.transform(features)
        out.append(scored.select("id", F.lit(r["label_id"]).alias("label_id"), F.get(vector_to_array("probability"), 1).alias("prob")))
    return reduce(DataFrame.unionByName, out)


def _in_step(features: DataFrame, targets: DataFrame, sizes: list, kind: str, **other) -> DataFrame:
    """:func:`one_vs_rest` by forests, boosting or networks: the models of all labels with both classes are fitted in step."""
    from pyspark.ml.functions import vector_to_array

    both = [r for r in sizes if r["pos"] and r["neg"]]
    arrays = features.select("id", vector_to_array("x").alias("x"))
    models = {}
    if both:
        # the rarer class weighs as much as the other one; or both are balanced around 1
        size = (lambda a, b: max(1.0, a / b)) if kind == "leafwise" else (lambda a, b: (a + b) / (2 * b))
        weight = F.coalesce(*[F.when((F.col("label") == r["label_id"]) & (F.col("y") == y), size(a, b)) for r in both for y, a, b in ((1, r["neg"], r["pos"]), (0, r["pos"], r["neg"]))])
        rows = targets.where(F.col("label_id").isin(*[r["label_id"] for r in both]) & F.col("target").isNotNull()).select("id", F.col("label_id").alias("label"), F.col("target").cast("double").alias("y"))
        held = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) == 0
        rows = arrays.join(rows, "id").withColumn("w", weight)
    if both and kind == "forest":
        weights = {r["label_id"]: (size(r["pos"], r["neg"]), size(r["neg"], r["pos"])) for r in both}
        found = forest.fit_each(rows, weights, forest.Settings(**{FOREST_NAMES[k]: v for k, v in (FOREST | other).items()})).scores(arrays)
        single = [features.select("id", F.lit(r["label_id"]).alias("label_id"), F.lit(float(r["pos"] > 0)).alias("prob")) for r in sizes if r not in both]
        return reduce(DataFrame.unionByName, single, found.select("id", F.col("label").alias("label_id"), "prob"))
    if both and kind == "network":
        first, sizes_of = arrays.first(), NETWORK | other
        # balanced weights of a label add up to its rows
        sums = {r["label_id"]: float(r["pos"] + r["neg"]) for r in both}
        models = network.fit_each(rows, len(first["x"]) if first else 0, sums, HIDDEN, sizes_of["maxIter"], sizes_of["seed"])
    elif both:
        models = boost.fit_each(rows.withColumn("held", held), boost.Settings(**(LEAFWISE | other))) if kind == "leafwise" else boost.fit_each(rows, boost.Settings(**(RESIDUALS | other)))
    constant = lambda r: F.lit(float(r["pos"] > 0))
    prob = lambda r: models[r["label_id"]].probability(F.col("x")) if r["label_id"] in models else constant(r)
    return reduce(DataFrame.unionByName, [arrays.select("id", F.lit(r["label_id"]).alias("label_id"), prob(r).alias("prob")) for r in sizes])


def tune(features: DataFrame, train: DataFrame, val: DataFrame, grid: list[dict], kind: str = "logistic") -> DataFrame:
    """``setting, macro_f1, best``: each setting's macro F1 on validation targets after fitting on training ones (ties: the first)."""
    rows = []
    # every setting reads them
    features = written(features, "features")
    for setting in grid:
        scored = one_vs_rest(features, train, kind, **setting).join(val.select("id", "label_id", "target"), ["id", "label_id"])
        rows.append(per_label(scored, F.lit(0.5)).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f")).first()["f"])
    best = max(range(len(rows)), key=lambda i: (rows[i], -i))
    table = [(", ".join(f"{k}={v}" for k, v in g.items()), float(f), i == best) for i, (g, f) in enumerate(zip(grid, rows, strict=True))]
    return features.sparkSession.createDataFrame(table, "setting string, macro_f1 double, best boolean")
