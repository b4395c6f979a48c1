"""What only larger tables or odd times showed."""

import math

import duckdb
from pyspark.sql import functions as F

from bytequarry.functions import evm
from bytequarry.operators import boost, graphs, layers, learn, network, order
from bytequarry.plans import catalog


def test_quantile_ranges_do_not_depend_on_the_order_of_rows(spark):
    df = spark.range(0, 40000, 1, 7).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("double").alias("x"))
    got = order.exact_quantiles(df, F.col("x"), {"a": 0.5, "b": 0.99}, "g")
    assert "percentile_approx" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = df.groupBy("g").agg(F.expr("percentile(x, 0.5)").alias("a"), F.expr("percentile(x, 0.99)").alias("b"))
    near = lambda rows: sorted((r["g"], round(r["a"], 4), round(r["b"], 4)) for r in rows.collect())
    assert near(got) == near(want)


def test_stale_runs_count_fractions_of_seconds(spark, tmp_path):
    duckdb.sql("""COPY (SELECT * FROM (VALUES (0, TIMESTAMP '2024-01-01 00:03:00.900000'), (3, TIMESTAMP '2024-01-01 00:00:00.500000'),
      (6, TIMESTAMP '2024-01-01 00:00:00.900000'), (9, TIMESTAMP '2024-01-01 00:00:00.899999'), (1, TIMESTAMP '2023-01-01 00:00:00')) t(event_id, ts)) TO '""" + str(tmp_path / "events.parquet") + "'")
    want = duckdb.sql(catalog.ORACLES["stale_runs"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["stale_runs"](spark, str(tmp_path)).collect())) == sorted(want) == [("completed", 1, 0), ("running", 4, 2)]


def test_few_broadcasts(spark):
    from bytequarry.session import few_broadcasts

    key = "spark.sql.autoBroadcastJoinThreshold"
    before, big = spark.conf.get(key), spark.range(200_000)
    plan = lambda: big.join(big, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    with few_broadcasts(spark):
        assert "BroadcastHashJoin" not in plan()
    assert spark.conf.get(key) == before


def test_jumps_are_carried_without_unasked_broadcasts(spark, monkeypatch):
    from bytequarry.operators import jumps

    seen = []
    monkeypatch.setattr(jumps, "_carried", lambda ins, cfg: seen.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")))
    jumps.stack_facts(spark.range(1), None)
    assert seen == ["-1"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_blocks_are_cut_without_a_shuffle_and_summed_up_without_a_sort(spark):
    codes = spark.createDataFrame([(1, "5b600160025b00" + "5b56" * 3), (2, ""), (3, "61"), (4, "6001565b")], "fp long, code string")
    ins = evm.disassemble(codes, blocks=True)
    assert "Exchange" not in _plan(ins)
    assert "Sort" not in _plan(graphs.block_summary(ins))
    want = graphs.with_blocks(evm.disassemble(codes)).withColumn("fp", F.col("fp").cast("long"))
    assert sorted(map(tuple, ins.collect())) == sorted(map(tuple, want.collect())) and want.count() > 8


def test_attention_takes_one_shuffle_of_its_edges(spark):
    scored = spark.createDataFrame([(1, t, [float(i), -1.0], [float(i + k) for k in range(4)]) for t in range(3) for i in range(3)], "fp long, t int, score array<double>, v array<double>")
    got = layers.attend(scored, 2, 4)
    assert _plan(got).count("Exchange hashpartitioning") == 1 and "Join" not in _plan(got)
    weights = [math.exp(i) for i in range(3)]
    want = [sum(w * (i + k) for i, w in enumerate(weights)) / sum(weights) for k in range(2)] + [sum(i + k for i in range(3)) / 3 for k in (2, 3)]
    assert len(got.collect()) == 3 and all(abs(a - b) < 1e-12 for r in got.collect() for a, b in zip(r["m"], want, strict=True))


def test_labels_are_boosted_in_the_same_passes(spark, monkeypatch):
    rows = [(label, [float(i % 7), float(i % 3)], float((i % 7 + label) % 3 == 0), 1.0, i % 5 == 0) for label in (1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "label int, x array<double>, y double, w double, held boolean").coalesce(1)
    s, passes, count = boost.Settings(rounds=2, leaves=3), [], boost.counted
    monkeypatch.setattr(boost, "counted", lambda *a: passes.append(len(a[1])) or count(*a))
    both = boost.fit_each(df, s)
    together, alone = len(passes), []
    for k in (1, 2):
        passes.clear()
        one = boost.fit(df.where(F.col("label") == k), s)
        alone.append(len(passes))
        assert both[k].trees == one.trees and both[k].history == one.history and one.trees
    assert together == max(alone)


def test_settings_are_tuned_on_written_features(spark, monkeypatch):
    seen = []

    def scored(features, targets, kind, **setting):
        seen.append(features.inputFiles())
        return targets.select("id", "label_id", F.lit(0.5).alias("prob"))

    monkeypatch.setattr(learn, "one_vs_rest", scored)
    features = spark.range(4).select("id", F.lit(1.0).alias("x"))
    targets = spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "id long, label_id int, target int")
    assert learn.tune(features, targets, targets, [{"a": 1}, {"a": 2}]).count() == 2
    assert seen[0] and seen[0] == seen[1]


def test_tokens_of_programs_are_not_gathered_again(spark, tables):
    codes = spark.createDataFrame([(1, "5b600160025b00"), (2, ""), (3, "61"), (4, None)], "fp long, code string")
    assert {r["fp"]: r["ids"] for r in evm.opcode_ids(codes).collect()} == {1: [0x5B, 0x60, 0x60, 0x5B, 0], 2: [], 3: [0x61], 4: []}
    # events are gathered by user, instructions are not gathered by their places
    plan = _plan(catalog.QUERIES["window_embeddings"](spark, tables))
    assert "collect_list(struct(event_id" in plan and "collect_list(struct(pc" not in plan


def test_boosting_of_residuals_equals_sparks_learner(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = [(i, [float(i % 7), float(i % 5), float(i * i % 11)], float((i % 7 + i % 5 + i * i % 11) % 4 == 0), 1.0 + i % 3) for i in range(385)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, w double").coalesce(1)
    settings = boost.Settings(**(learn.RESIDUALS | {"rounds": 4, "depth": 3}))
    got = {r["id"]: r["p"] for r in df.select("id", boost.fit(df, settings).probability(F.col("x")).alias("p")).collect()}
    vectors = df.withColumn("x", array_to_vector("x"))
    model = learn._estimator("boosted", maxIter=4, maxDepth=3).fit(vectors)
    want = {r["id"]: r["p"] for r in model.transform(vectors).select("id", F.get(vector_to_array("probability"), 1).alias("p")).collect()}
    assert len(set(want.values())) > 8 and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    # all labels in the same passes, without Spark's learner
    monkeypatch.setattr(learn, "_estimator", lambda *a, **k: 1 / 0)
    targets = df.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("label_id"), F.col("y").cast("int").alias("target"))
    assert learn.one_vs_rest(vectors.select("id", "x"), targets, "boosted", rounds=1).count() == 2 * 385


def test_networks_are_fitted_in_step_as_well_as_by_spark(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(int)
    df = spark.createDataFrame([(i, [float(c) for c in r], int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y int").withColumn("x", array_to_vector("x")).coalesce(2)
    targets = df.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("label_id"), F.col("y").alias("target"))
    passes, count = [], network.counted
    monkeypatch.setattr(network, "counted", lambda *a: passes.append(len(a[1])) or count(*a))
    got = learn.one_vs_rest(df.select("id", "x"), targets, "network", maxIter=60).toPandas().pivot(index="id", columns="label_id", values="prob")
    assert len(passes) <= 2 * 60 and passes[0] == 2 and np.abs(got[1] - got[2]).max() < 1e-6
    model = MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[3, *learn.HIDDEN, 2], maxIter=60, seed=7).fit(df)
    theirs = model.transform(df).select("id", F.get(vector_to_array("probability"), 1).alias("p")).toPandas().set_index("id")["p"]
    loss = lambda p: float(-np.log(np.clip(np.where(y == 1, p.sort_index(), 1 - p.sort_index()), 1e-9, 1)).mean())
    assert loss(got[1]) <= loss(theirs) * 1.1 + 0.02


def test_gradients_of_networks():
    import numpy as np

    rng = np.random.default_rng(0)
    net, x, y, w = network.Network.new((3, 4, 4, 2), 1), rng.normal(size=(9, 3)), rng.integers(0, 2, 9), rng.uniform(1, 2, 9)
    g = net.gradient(x, y, w)
    for i in range(0, len(net.flat), 5):
        up, down = net.flat.copy(), net.flat.copy()
        up[i], down[i] = up[i] + 1e-6, down[i] - 1e-6
        near = (network.Network(net.sizes, up).gradient(x, y, w)[0] - network.Network(net.sizes, down).gradient(x, y, w)[0]) / 2e-6
        assert abs(near - g[1 + i]) < 1e-5


def test_words_are_cut_out_of_texts_once(spark, monkeypatch):
    from bytequarry.operators import features

    cut, words = [], features._words
    monkeypatch.setattr(features, "_words", lambda text: cut.append(1) or words(text))
    df = spark.createDataFrame([(1, "ab cd ab"), (2, "ab  x cd"), (3, None)], "id int, text string")
    got = features.tfidf(df, F.col("id") < 2, top=3)
    assert "regexp_extract_all" not in _plan(got) and len(cut) == 1
    assert {(r["id"], r["term"]) for r in got.collect()} == {(1, "ab"), (1, "ab cd"), (1, "cd"), (2, "ab"), (2, "ab cd"), (2, "cd")}


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    from bytequarry.llm import ngram_join
    from bytequarry.session import BATCH_BYTES, small_batches

    def sizes(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    texts = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 1000000) AS text")
    with small_batches(spark):
        assert max(r["n"] for r in texts.mapInPandas(sizes, "n long").collect()) <= BATCH_BYTES // 1_000_000 + 1

    key, seen, cut = "spark.sql.execution.arrow.maxBytesPerBatch", [], ngram_join.cut
    before = spark.conf.get(key)
    monkeypatch.setattr(ngram_join, "cut", lambda df, *a, **b: seen.append(spark.conf.get(key)) or cut(df, *a, **b))
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(20 + i % 2))) for i in range(6)], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.near_duplicates(docs).collect()} == {0}
    assert seen and set(seen) == {f"{BATCH_BYTES}b"} and spark.conf.get(key) == before


def test_forest_sends_no_trees_and_ignores_how_rows_lie(spark):
    from pyspark.ml.functions import array_to_vector

    assert learn._estimator("forest").getCacheNodeIds()
    noise = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100)).cast("double")
    table = spark.range(0, 400, 1, 1).select("id", noise(1).alias("a"), noise(2).alias("b"))
    features = table.select("id", array_to_vector(F.array("a", "b")).alias("x"))
    targets = table.select("id", F.lit(1).alias("label_id"), (F.col("a") + F.col("b") > 100).cast("int").alias("target"))
    got = [{r["id"]: r["prob"] for r in learn.one_vs_rest(features.repartition(n), targets.repartition(n), "forest", numTrees=5, maxDepth=6).collect()} for n in (1, 7)]
    assert got[0] == got[1]
    right = {r["id"]: r["target"] for r in targets.collect()}
    assert sum((p > 0.5) == right[i] for i, p in got[0].items()) > 360
