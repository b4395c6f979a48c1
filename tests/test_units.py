"""Hand-derived cases and properties of what SQL cannot express."""

import math
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bytequarry.functions import bytecode as B
from bytequarry.functions import evm
from bytequarry.functions import text as T
from bytequarry.operators import checks, corpus, features, graphs, labels, learn, metrics, runs, splits
from bytequarry.sources import io
from bytequarry.streaming import ingest


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


@pytest.mark.parametrize(("raw", "why", "code"), [(" 0x60 01\n", "", "6001"), ("abc", "odd_length_hex", None), ("zz", "invalid_hex", None), ("zzz", "odd_length_hex", None), ("", "missing_runtime_bytecode", None)])
def test_hex_normal(spark, raw, why, code):
    r = one(spark, f=B.failure(F.lit(raw)), c=B.normal(F.lit(raw)))
    assert (r["f"], r["c"]) == (why, code)


def test_sweep():
    assert evm.sweep("6001600255") == [(0, 0x60, "01", 2), (2, 0x60, "02", 2), (4, 0x55, "", 1)]
    assert evm.sweep("61ff") == [(0, 0x61, "ff", 2)]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_sweep_covers_every_byte(code):
    rows = evm.sweep(code.hex())
    assert sum(r[3] for r in rows) == len(code)
    assert b"".join(bytes([op]) + bytes.fromhex(d) for _, op, d, _ in rows) == code


@pytest.mark.parametrize("code", ["", "61ff", "7f00", "5f5b60", "60016002" * 40 + "7f" + "aa" * 31])
def test_disassembly_equals_sweep(spark, code):
    got = evm.disassemble(spark.createDataFrame([("a", code)], "fp string, code string")).orderBy("pc").collect()
    assert [(r["pc"], r["opcode_id"], r["push_data"], r["size"]) for r in got] == evm.sweep(code)


def instructions(spark, code):
    return graphs.with_blocks(evm.disassemble(spark.createDataFrame([("a", code)], "fp string, code string")))


def test_blocks_and_cfg(spark):
    ins = instructions(spark, "600456005b00")
    blocks = {r["basic_block_id"]: (r["start_pc"], r["end_pc"], r["end_opcode"], r["starts_with_jumpdest"]) for r in graphs.block_summary(ins).collect()}
    assert blocks == {0: (0, 2, "JUMP", False), 1: (3, 3, "STOP", False), 2: (4, 5, "STOP", True)}
    assert [(r["src"], r["dst"], r["edge_type"]) for r in graphs.fallback_cfg(ins).collect()] == [(0, 4, "jump")]
    edges = graphs.fallback_cfg(instructions(spark, "6001600657005b00")).collect()
    assert sorted((r["src"], r["dst"], r["edge_type"]) for r in edges) == [(0, 5, "jumpi_false"), (0, 6, "jumpi_true")]


def test_data_flow(spark):
    ins = instructions(spark, "6007600155600154")
    edges = graphs.data_flow(ins, graphs.fallback_cfg(ins)).collect()
    assert sorted((r["src"], r["dst"], r["edge_type"], r["storage_slot"]) for r in edges) == [(0, 4, "stack_flow", None), (2, 4, "stack_flow", None), (4, 7, "storage_flow", "1"), (5, 7, "stack_flow", None)]


def test_minimal_proxy(spark):
    h = F.lit(B.PROXY_HEAD + "ab" * 20 + B.PROXY_TAIL)
    r = one(spark, p=B.is_minimal_proxy(h), s=B.is_stub_like(h), n=F.length(h) / 2)
    assert (r["p"], r["s"], r["n"]) == (True, True, 45)


def test_metadata(spark):
    h = F.lit("00" + "a1" + b"solc".hex() + "0005")
    r = one(spark, k=B.strip_metadata(h), z=B.strip_metadata(h, True), n=B.metadata_bytes(h), other=B.metadata_bytes(F.lit("00" + "61" + b"solc".hex() + "0005")))
    assert tuple(r) == ("00", "00" * 8, 7, 0)


def test_votes(spark):
    v = spark.createDataFrame([("a", "107.0", "t"), ("a", "107", "t"), ("a", " 107 ", "f"), ("b", "101", "t"), ("b", "101", "f"), ("c", "999", "t"), ("c", "101", "x")], "fp string, swc_id string, vote string")
    got = {r["fp"]: (r["label"], r["has_conflict"], r["is_tie"]) for r in labels.vote_pairs(labels.valid_votes(v)).collect()}
    assert got == {"a": (1, True, False), "b": (None, True, True)}


@pytest.mark.parametrize(("a", "b", "pos", "action"), [(0, 25, 25, "keep_pu_only"), (40, 0, 0, "keep_cgt_only"), (10, 5, 5, "drop_low_count"), (40, 3, 3, "keep")])
def test_decision(spark, a, b, pos, action):
    assert one(spark, x=labels.decision(F.lit(a), F.lit(b), F.lit(pos)))["x"] == action


def test_patterns(spark):
    tokens = "STATICCALL POP CALL POP SSTORE".split()
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(tokens)], "fp string, pc int, opcode string")
    r = features.pattern_features(df).first()
    assert (r["pat_call_then_pop"], r["pat_call_then_sstore"]) == (1, 1)
    assert len(r) == 49  # 48 features and fp


def predictions(spark):
    rows = [(i, 1, p, y) for i, (p, y) in enumerate([(0.9, 1), (0.4, 1), (0.6, 0), (0.1, 0), (0.5, None)])]
    return spark.createDataFrame(rows, "id int, label_id int, prob double, target int")


def test_confusion_and_sweep(spark):
    r = metrics.per_label(predictions(spark), F.lit(0.5)).first()
    assert [r[c] for c in ("tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy", "mcc")] == [1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5, 0.0]
    best = metrics.threshold_sweep(predictions(spark)).first()
    assert (best["threshold"], round(best["f1"], 6)) == (0.15, 0.8)


def test_trace_operand_order():
    assert evm._binary("SUB", 10, 3) == (3 - 10) % evm.WORD
    code = "6005600c60003960056000f3" + "aabbccddee"
    assert evm.trace_initcode(code)["runtime"] == "aabbccddee"
    assert [evm.trace_initcode(c)["failure_mode"] for c in ("", "abc", "zz", "00")] == ["empty_initcode", "invalid_hex_odd_length", "invalid_hex", "no_return_linked_codecopy"]


def test_significance(spark):
    p = spark.createDataFrame([(0.01,), (0.03,), (0.5,)], "p double")
    assert [round(r["p_adjusted"], 6) for r in runs.bonferroni(p).orderBy("p").collect()] == [0.03, 0.09, 1.0]
    even = runs.wilcoxon_ranks(spark.createDataFrame([("same", 1.0, 1.0)] * 5 + [("all", float(i), 0.0) for i in range(1, 6)], "comparison string, x double, y double"))
    assert {r["comparison"]: r["p"] for r in runs.with_wilcoxon_p(even).collect()} == {"same": 1.0, "all": 2 / 32}


def test_sample_weights(spark):
    t = {"A": [1, 0, 0, 0, 0], "B": [1, 1, 0, 0, None]}
    df = spark.createDataFrame([(i, k, y) for k, ys in t.items() for i, y in enumerate(ys)], "id int, label_id string, target int")
    assert {r["id"]: r["weight"] for r in metrics.sample_weights(df).collect()} == {0: 4.0, 1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0}


def test_learners_have_the_references_sizes(spark):
    logistic, forest, boosted = (learn._estimator(k) for k in ("logistic", "forest", "boosted"))
    assert logistic.getMaxIter() == 200
    assert (forest.getNumTrees(), forest.getMaxDepth()) == (300, 30)
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize()) == (300, 6, 0.1)


def test_weighted_draws_number_as_the_rows(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, 5.0).otherwise(1.0).alias("weight"))
    got = {r["id"]: r["draws"] for r in splits.weighted_draws(df).collect()}
    assert sum(got.values()) == 2000
    assert abs(sum(n for i, n in got.items() if i % 10 == 0) - 2000 * 5 / 14) < 150
    assert splits.weighted_draws(df, 100).agg(F.sum("draws")).first()[0] == 100


def test_stratified_split(spark):
    rows = [(i, k, int(i % (k * 7) == 0)) for i in range(1000) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "id int, label_id int, target int")
    out = splits.stratified(df)
    assert out.count() == 1000 and out.select("id").distinct().count() == 1000
    of = {r["id"]: r["fold"] for r in out.collect()}
    for k in (1, 2, 3):
        per = [sum(t for i, j, t in rows if j == k and of[i] == f) for f in range(10)]
        assert max(per) - min(per) <= 2
    sizes = [sum(f == v for v in of.values()) for f in range(10)]
    assert max(sizes) - min(sizes) <= 2
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}.keys() == {"train", "val", "test"}
    assert out.exceptAll(splits.stratified(df)).isEmpty()
    assert splits.stratified(df.where("false")).isEmpty()


def test_quotas_balance_every_label():
    import random

    r = random.Random(3)
    for _ in range(30):
        counts = {}
        for _ in range(r.randint(1, 400)):
            c = tuple(sorted(x for x in range(5) if r.random() < (0.5, 0.3, 0.2, 0.05, 0.02)[x]))
            counts[c] = counts.get(c, 0) + 1
        q = splits.quotas(counts, 10)
        assert {c: sum(v) for c, v in q.items()} == counts
        for x in range(5):
            per = [sum(v[f] for c, v in q.items() if x in c) for f in range(10)]
            assert max(per) - min(per) <= 4
        sizes = [sum(v[f] for v in q.values()) for f in range(10)]
        assert max(sizes) - min(sizes) <= 4


def test_text_functions(spark):
    r = one(spark, c=T.clean(F.lit("\t a \n")), n=T.to_int(F.lit(" 107.0 ")), m=T.to_int(F.lit("1.5")), s=T.slug(F.lit("--Ab c!")), e=T.slug(F.lit(None)), w=T.class_id(F.lit("SWC-107-x")), j=T.json_list(F.lit("no json")))
    assert tuple(r) == ("a", 107, None, "ab_c", "dataset", 107, [])


def test_windows():
    assert features.windows(10, 4, 3) == [(0, 4), (3, 7), (6, 10)]
    assert features.windows(3, 4, 2) == [(0, 3)]


def test_checks(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError, match="missing columns: x"):
        checks.require_columns(df, ["k", "x"])
    with pytest.raises(ValueError, match="repeated keys"):
        checks.assert_unique(df, ["k"])
    assert checks.one_to_one(df.distinct(), df.distinct(), "k").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "codes" / "d1").mkdir(parents=True)
    (tmp_path / "codes" / "d1" / "a.json").write_text('{"contracts": {"x.sol:C": {"bin": "6001", "bin-runtime": "00"}}}')
    (tmp_path / "codes" / "d1" / "bad.json").write_text("{")
    rows = {r["path"].rpartition("/")[2]: r for r in io.scan_compiler_json(spark, str(tmp_path / "codes")).collect()}
    assert (rows["a.json"]["dapp"], rows["a.json"]["contract_key"], rows["a.json"]["initcode"]) == ("d1", "x.sol:C", "6001")
    assert rows["bad.json"]["failed"]
    (tmp_path / "v.csv").write_text("fp;swc\na;\nb;7\n")
    assert [tuple(r) for r in io.scan_delimited(spark, str(tmp_path / "v.csv")).orderBy("fp").collect()] == [("a", ""), ("b", "7")]
    (tmp_path / "hex").mkdir()
    (tmp_path / "hex" / "f1.rt.hex").write_text("0x6001\n")
    assert [tuple(r) for r in io.scan_hex_files(spark, str(tmp_path / "hex")).collect()] == [("f1", "6001", "")]
    assert [r["stem"] for r in io.list_stems(spark, str(tmp_path / "hex")).collect()] == ["f1"]
    (tmp_path / "ids").mkdir()
    (tmp_path / "ids" / "train_ids.txt").write_text("a\n\nb\n")
    (tmp_path / "ids" / "test_ids.txt").write_text("b\n")
    ids = io.scan_id_lists(spark, str(tmp_path / "ids"))
    assert sorted(map(tuple, ids.collect())) == [("test", "b"), ("train", "a"), ("train", "b")]
    assert [r["id"] for r in io.id_list_faults(ids).collect()] == ["b"]
    (tmp_path / "v.md").write_text("# x\nVerdict: `allowed`\n")
    assert io.scan_verdict(spark, str(tmp_path / "v.md"), ("allowed",)) == "allowed"
    (tmp_path / "c.yaml").write_text("a: 1\n")
    assert io.scan_mapping(spark, str(tmp_path / "c.yaml")) == {"a": 1}
    out = str(tmp_path / "out.parquet")
    df = spark.range(3)
    assert io.write_parquet(df, out, keep=True) == out
    other = io.write_parquet(df, out, keep=True)
    assert other != out and spark.read.parquet(other).count() == 3
    taken, _ = io.free_path(spark, out, datetime(2020, 1, 1, tzinfo=timezone.utc))
    assert taken.endswith("out_20200101T000000Z.parquet")
    io.write_ids(df, str(tmp_path / "w"))
    assert "| id |" in io.markdown(df) and '"id": 0' in io.report(df)
    assert io.match_headers(["Audit Company", "DApp"], {"team": ["auditor", "audit company"], "dapp": ["dapp"]}) == {"team": "Audit Company", "dapp": "DApp"}


def test_ingest_is_idempotent(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([("0x6001",), ("6001",), ("zz",)], "code string").write.parquet(source)
    for k in range(2):
        ingest.ingest(spark, source, table, str(tmp_path / f"c{k}")).awaitTermination()
    assert [r["code"] for r in spark.read.parquet(table).collect()] == ["6001"]


def test_empty_tables(spark):
    votes = spark.createDataFrame([], "fp string, swc_id string, vote string")
    assert labels.vote_pairs(labels.valid_votes(votes)).isEmpty()
    empty = predictions(spark).where("false")
    assert metrics.per_label(empty, F.lit(0.5)).isEmpty() and metrics.average_precision(empty).isEmpty()
    assert corpus.overlap(spark.createDataFrame([], "k int"), spark.createDataFrame([], "k int"), "k").first()["coverage"] == 0


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from bytequarry.operators import reports

    rows = spark.range(40).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("x"), (F.col("id") % 3 == 0).cast("double").alias("y"))
    model = Pipeline(stages=[LogisticRegression(featuresCol="x", labelCol="y", maxIter=5)]).fit(rows)
    reports.save_model(model, str(tmp_path / "m"))
    p = lambda m: [r[0] for r in m.transform(rows).select(F.get(vector_to_array("probability"), 1)).collect()]
    assert all(abs(a - b) < 1e-6 for a, b in zip(p(model), p(reports.load_model(str(tmp_path / "m"))), strict=True))


def test_data_flow_of_a_block():
    """Duplicates use their source, copies forget memory, control needs both branches, unknown places forget their kind."""
    from bytequarry.operators.graphs import simulate_block

    kinds = lambda rows, *to: {(a, b, k) for a, b, k, _, _ in simulate_block(rows, *(to or ([], [])))}
    push = lambda pc, v: (pc, "PUSH1", v)
    assert kinds([push(0, "01"), (2, "DUP1", ""), (3, "ADD", "")]) == {(0, 2, "stack_flow"), (0, 3, "stack_flow")}
    store = [push(0, "aa"), push(2, "20"), (4, "MSTORE", "")]
    load = [push(20, "20"), (22, "MLOAD", "")]
    flows = {(0, 4, "stack_flow"), (2, 4, "stack_flow"), (20, 22, "stack_flow")}
    assert kinds(store + load) == flows | {(4, 22, "memory_flow")}
    for op, n in (("CALLDATACOPY", 3), ("CODECOPY", 3), ("EXTCODECOPY", 4), ("RETURNDATACOPY", 3), ("MCOPY", 3), ("CREATE", 3)):
        assert (4, 22, "memory_flow") not in kinds([*store, *[push(5 + 2 * i, "00") for i in range(n)], (19, op, ""), *load])
    assert (4, 22, "memory_flow") in kinds([*store, (5, "CALLER", ""), push(6, "00"), (8, "SSTORE", ""), *load])
    jump = [push(0, "01"), push(2, "09"), (4, "JUMPI", "")]
    both = {(0, 4, "stack_flow"), (2, 4, "stack_flow")}
    assert kinds(jump, [9], []) == kinds(jump, [], [5]) == both
    assert kinds(jump, [9], [5]) == both | {(0, 9, "control_dependency"), (0, 5, "control_dependency")}
    # a truncated push has no value, so the store forgets all places
    assert kinds([push(0, "01"), push(2, "05"), (4, "SSTORE", ""), push(5, "01"), push(7, ""), (8, "SSTORE", ""), push(9, "05"), (11, "SLOAD", "")]) == {(0, 4, "stack_flow"), (2, 4, "stack_flow"), (5, 8, "stack_flow"), (7, 8, "stack_flow"), (9, 11, "stack_flow")}
    assert kinds([push(0, "01"), (2, "UNKNOWN_0C", ""), (3, "POP", "")]) == set()


def test_places_need_no_single_task(spark):
    from bytequarry.operators.order import positions

    df = spark.createDataFrame([(f"k{(i * 7919) % 5000:05d}", i % 3) for i in range(5000)], "k string, s int")
    got = [(r["k"], r["i"]) for r in positions(df, ["k"], 8).orderBy("i").collect()]
    assert got == [(f"k{i:05d}", i) for i in range(5000)]
    got = [(r["s"], r["k"]) for r in positions(df, ["s", "k"], 8).orderBy("i").collect()]
    assert got == sorted(got)
    assert positions(df.where("false"), ["k"]).isEmpty()


def test_exact_quantiles(spark):
    import random

    import numpy as np

    from bytequarry.operators.order import exact_quantiles

    r = random.Random(2)
    groups = {"a": [r.random() for _ in range(3000)], "b": [r.randrange(5) for _ in range(2000)], "c": [7.0], None: [1.0, 2.0], "d": [r.choice([0.0, 1e9]) for _ in range(999)]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: x for x in exact_quantiles(df, F.col("v"), {"median": 0.5, "p95": 0.95, "p99": 0.99}, "g").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert abs(got[g][name] - np.quantile(vs, p)) < 1e-9, (g, name)
    assert exact_quantiles(df.where("g = 'c'"), F.col("v"), {"m": 0.5}).first()["m"] == 7.0
    assert exact_quantiles(df.where("false"), F.col("v"), {"m": 0.5}).isEmpty()


def test_signed_rank_p_values(spark):
    """Exact tails by listing all signs; the normal form with equal sizes and tied pairs."""
    import itertools
    import random

    r = random.Random(8)
    rows = []
    for n in (2, 3, 5, 8, 12):
        rows += [(f"exact{n}", r.random(), r.random()) for _ in range(n)]
    rows += [("ties", float(x), 0.0) for x in (1, 1, -1, 2, 2, 3, -3, 4, 5, 0, 0)] + [("big", i + 0.5 * (-1) ** (i % 3), float(i - (i % 7))) for i in range(80)]
    ranks = runs.wilcoxon_ranks(spark.createDataFrame(rows, "comparison string, x double, y double"))
    got = {x["comparison"]: x for x in runs.with_wilcoxon_p(ranks).collect()}
    assert math.isnan(got["exact2"]["p"])
    for n in (3, 5, 8, 12):
        w = got[f"exact{n}"]["w"]
        ways = sum(sum(i + 1 for i, s in enumerate(signs) if s) <= w for signs in itertools.product((0, 1), repeat=n))
        assert abs(got[f"exact{n}"]["p"] - min(1, 2 * ways / 2**n)) < 1e-12
    for name in ("ties", "big"):
        x = got[name]
        var = x["n"] * (x["n"] + 1) * (2 * x["n"] + 1) / 24 - x["ties"] / 48
        z = abs(x["w"] - x["n"] * (x["n"] + 1) / 4) / math.sqrt(var)
        assert abs(x["p"] - min(1, math.erfc(z / math.sqrt(2)))) < 1e-6
    assert got["ties"]["ties"] == 24 + 6 + 6 and got["ties"]["n"] == 9


def test_tasks(tmp_path, capsys):
    from bytequarry.__main__ import groups, main

    assert set(groups()) == {"label", "corpus", "graph", "jump", "layer", "metric", "report", "training"}
    assert main(["--list"]) == 0 and "merge_dedup" in capsys.readouterr().out
    assert main(["hash_split", "/root/testdata/sf0.001", str(tmp_path / "o")]) == 0
    assert (tmp_path / "o" / "_SUCCESS").exists()


def test_findings_that_cannot_be_read_are_counted(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"node name": "n", "SWCs": [{"category": "SWC-107"}, {"category": "SWC-101"}]}')
    (tmp_path / "b.json").write_text('{"node name": "m", "SWCs": []}')
    (tmp_path / "c.json").write_text("{broken")
    rows = io.scan_findings(spark, str(tmp_path))
    assert rows.count() == 4 and rows.where("failed").count() == 1
    assert tuple(io.scan_counts(rows).first()) == (2, 1, 2)


def test_stems_do_not_read_contents(spark, tmp_path):
    (tmp_path / "x.rt.hex").write_text("00")
    plan = io.list_stems(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan or "content" not in plan
