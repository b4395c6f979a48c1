"""Boosting, early stopping, search, executor, layers, jumps across blocks, workbooks: against plain loops and hand-made cases."""

import io as bytes_io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytequarry.functions import evm
from bytequarry.operators import boost, corpus, executor, features, graphs, jumps, layers, runs, training
from bytequarry.plans import catalog
from bytequarry.sources import io, workbook


def boosted_by_loop(x, y, w, held, model, s):
    """Scores of all rows after ``s.rounds`` trees, by searching every split of every leaf."""
    bins, train = model.binned(x), np.flatnonzero(~held)
    score = np.full(len(x), model.start)
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * p * (1 - p)
        leaves = [np.arange(len(x))]

        def best(rows, g=g, h=h):
            rows = rows[~held[rows]]
            found = None
            for j in range(x.shape[1]):
                for b in range(s.bins):
                    left, right = rows[bins[rows, j] <= b], rows[bins[rows, j] > b]
                    if min(len(left), len(right)) < s.least_rows or min(h[left].sum(), h[right].sum()) < s.least_hessian:
                        continue
                    gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[rows].sum() ** 2 / h[rows].sum()
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                        found = gain, j, b
            return found

        splits = [best(leaves[0])]
        while len(leaves) < s.leaves and any(splits):
            k = max((k for k, f in enumerate(splits) if f), key=lambda k: splits[k][0])
            _, j, b = splits[k]
            rows = leaves[k]
            leaves[k : k + 1] = [rows[bins[rows, j] <= b], rows[bins[rows, j] > b]]
            splits[k : k + 1] = [best(leaves[k]), best(leaves[k + 1])]
        for rows in leaves:
            own = np.intersect1d(rows, train)
            score[rows] -= s.rate * g[own].sum() / h[own].sum()
    return score


@pytest.mark.parametrize("leaves", [2, 6, 31])
def test_leafwise_boosting_equals_a_loop(spark, leaves):
    r = random.Random(leaves)
    rows = []
    for i in range(500):
        x = [r.random() for _ in range(3)] + [float(r.randrange(3))]
        rows.append((x, float((x[0] + x[1] * x[3] > 0.9) ^ (r.random() < 0.1)), r.choice((1.0, 2.5)), i % 5 == 0))
    df = spark.createDataFrame(rows, "x array<double>, y double, w double, held boolean").repartition(3)
    s = boost.Settings(rounds=6, leaves=leaves, bins=24, rate=0.3)
    model = boost.fit(df, s)
    x, y, w, held = (np.array(v) for v in zip(*rows, strict=True))
    want = boosted_by_loop(x, y, w, held, model, boost.Settings(rounds=len(model.trees), leaves=leaves, bins=24, rate=0.3))
    got = df.select("x", model.probability(F.col("x")).alias("p")).collect()
    by_x = {tuple(a): 1 / (1 + math.exp(-b)) for a, b in zip(x.tolist(), want.tolist(), strict=True)}
    assert max(abs(row["p"] - by_x[tuple(row["x"])]) for row in got) < 1e-9
    # the trees after the best loss on held rows are left out
    losses = [h[2] for h in model.history]
    assert len(model.history) == 6 and len(model.trees) == losses.index(min(losses)) + 1
    loss = np.mean([-math.log(p if t else 1 - p) * v for p, t, v in [(by_x[tuple(a)], b, c) for a, b, c, d in rows if d]]) / np.mean([c for *_, c, d in rows if d])
    assert abs(loss - min(losses)) < 1e-9


def test_leafwise_boosting_learns_and_stops(spark):
    r = random.Random(2)
    rows = [([r.gauss(0, 1) for _ in range(3)], i % 4 == 0) for i in range(1200)]
    rows = [(x, float((x[0] * x[1] > 0) ^ (r.random() < 0.05)), 1.0, held) for x, held in rows]
    df = spark.createDataFrame(rows, "x array<double>, y double, w double, held boolean")
    model = boost.fit(df, boost.Settings(rounds=120, leaves=8, patience=5))
    assert len(model.history) < 120 and len(model.history) == len(model.trees) + 5
    scored = df.where("held").select("y", (model.probability(F.col("x")) > 0.5).cast("double").alias("p")).collect()
    hit = sum(a["y"] == a["p"] == 1 for a in scored)
    assert 2 * hit / (sum(a["y"] for a in scored) + sum(a["p"] for a in scored)) > 0.88  # F1; noise alone costs 0.05


def test_boosting_of_one_class_and_no_rows(spark):
    kind = "x array<double>, y double, w double"
    none = boost.fit(spark.createDataFrame([], kind))
    assert none.trees == [] and none.start == 0.0
    one = boost.fit(spark.createDataFrame([([1.0], 1.0, 1.0), ([float("nan")], 1.0, 1.0)], kind))
    assert one.trees == [] and 1 / (1 + math.exp(-one.start)) > 0.999


def stopped_by_loop(scores, patience, largest):
    best, best_step, waited, seen = None, None, 0, 0
    for step, s in scores:
        seen += 1
        if best is None or (s > best if largest else s < best):
            best, best_step, waited = s, step, 0
        else:
            waited += 1
        if waited >= patience:
            break
    return seen, best_step


@pytest.mark.parametrize("largest", [True, False])
def test_early_stopping_by_loop(spark, largest):
    r = random.Random(4)
    made = {k: [(10 * i, r.choice((r.random(), 0.5, float("nan")))) for i in range(1, r.randint(2, 30))] for k in range(40)}
    made[98] = [(10, float("nan")), (20, 0.7), (30, 0.1)]
    made[99] = [(10, 0.5)]
    df = spark.createDataFrame([(k, s, v) for k, x in made.items() for s, v in x], "run long, step long, score double")
    got = {x["run"]: (x["evaluations"], x["best_step"]) for x in training.stopped_runs(df, 4, largest).collect()}
    assert got == {k: stopped_by_loop(x, 4, largest) for k, x in made.items()}
    kept = training.evaluations(df, 4, largest).where("kept").groupBy("run").agg(F.max("step").alias("s")).collect()
    assert {x["run"]: x["s"] for x in kept} == {k: b for k, (_, b) in got.items()}


def test_survivors():
    reports = [(t, s, v) for t, x in enumerate([(5, 5, 5), (1, 9, 1), (2, 2, 2), (3, 3, 3), (4, None, 4)]) for s, v in enumerate(x)]
    # at step 0 the median is 3; then it is that of 5, 3 and one missing value, and 5, 3, 4
    assert training.survivors(reports, startup=3, warmup=0) == {0: None, 1: 0, 2: 0, 3: 2, 4: None}
    assert training.survivors(reports, startup=6, warmup=0) == dict.fromkeys(range(5))
    assert training.survivors(reports, startup=3, warmup=1) == {0: None, 1: None, 2: 1, 3: 2, 4: None}


def test_a_search_goes_on_where_it_was(spark, tmp_path):
    space = {"a": ("float", 0.0, 1.0), "b": ("log", 1e-3, 1.0), "c": ("int", 1, 5), "d": ("choice", ["x", "y"])}
    asked = []

    def objective(setting, step):
        asked.append((setting["a"], step))
        return 1 - (setting["a"] - 0.3) ** 2 + step / 1000 + (setting["d"] == "x") / 10

    def broken(setting, step):
        if len(asked) == 9:
            raise KeyboardInterrupt
        return objective(setting, step)

    whole = sorted(map(tuple, training.search(spark, str(tmp_path / "whole"), space, objective, [1, 2, 3], trials=16, cohort=4).collect()))
    asked.clear()
    with pytest.raises(KeyboardInterrupt):
        training.search(spark, str(tmp_path / "parts"), space, broken, [1, 2, 3], trials=16, cohort=4)
    parts = sorted(map(tuple, training.search(spark, str(tmp_path / "parts"), space, objective, [1, 2, 3], trials=16, cohort=4).collect()))
    assert parts == whole and len(asked) == len(whole) < 16 * 3
    late = [float(v) for t, _, s, v in whole if t >= 8]
    assert max(late) >= max(float(v) for t, _, s, v in whole if t < 8) - 0.01


def test_executor_resumes_to_the_same_table(spark, tmp_path):
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "x string")
    matrix = runs.run_matrix(one("v1", "v2").toDF("variant"), one("m1", "m2", "m3").toDF("model"), spark.createDataFrame([(1,)], "seed int"))
    done = []

    def work(run):
        done.append(run["run_id"])
        if run["model"] == "m2":
            raise executor.Unavailable("no artifact")
        if run["model"] == "m3" and run["variant"] == "v1":
            raise ValueError("bad")
        return {"score": len(run["variant"] + run["model"])}

    def killed(run):
        if len(done) == 3:
            raise KeyboardInterrupt
        return work(run)

    final = lambda store: sorted((r["run_id"], r["status"], r["error"], r["summary"]) for r in executor.states(spark, store).collect())
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    assert executor.execute(spark, whole, matrix, work) == {"completed": 3, "unavailable": 2, "failed": 1}
    done.clear()
    with pytest.raises(KeyboardInterrupt):
        executor.execute(spark, parts, matrix, killed)
    assert [r["status"] for r in executor.states(spark, parts).collect()].count("running") == 1
    executor.execute(spark, parts, matrix, work)
    assert final(parts) == final(whole) and len(done) == 6
    # nothing is left to do, unless failed runs are wanted again
    assert executor.execute(spark, parts, matrix, work) == {"completed": 0, "unavailable": 0, "failed": 0}
    assert executor.execute(spark, parts, matrix, work, rerun_failed=True) == {"completed": 0, "unavailable": 2, "failed": 1}
    assert executor.states(spark, parts).where("status = 'failed'").select("attempt", F.col("trace").contains("ValueError")).first()[:] == (2, True)
    with pytest.raises(ValueError, match="bad"):
        executor.execute(spark, str(tmp_path / "fast"), matrix, work, fail_fast=True)
    assert executor.states(spark, str(tmp_path / "fast")).where("status = 'failed'").count() == 1
    assert executor.execute(spark, str(tmp_path / "some"), matrix, work, wanted={"model": ["m1"]}, most=1) == {"completed": 1, "unavailable": 0, "failed": 0}


def workbook_bytes():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f'<workbook {ns} {rel}><sheets><sheet name="first" sheetId="1" r:id="a"/><sheet name="second" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>File Name</t></si><si><r><t>Audit </t></r><r><t>Company</t></r></si><si><t>alpha</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>7.5</v></c><c r="C3" t="inlineStr"><is><t>team é</t></is></c></row><row r="4"><c r="A4" t="b"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="AA1" t="str"><v>far</v></c></row></sheetData></worksheet>',
    }
    out = bytes_io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_workbook_of_two_sheets(spark, tmp_path):
    (tmp_path / "book.xlsx").write_bytes(workbook_bytes())
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    rows = workbook.scan_workbook(spark, str(tmp_path / "*.xlsx")).orderBy("path", "sheet", "row").collect()
    assert [(r["sheet"], r["name"], r["row"], r["cells"]) for r in rows[:4]] == [(0, "first", 0, ["File Name", "", "Audit Company"]), (0, "first", 2, ["alpha", "7.5", "team é"]), (0, "first", 3, ["True"]), (1, "second", 0, [""] * 26 + ["far"])]
    assert len(rows) == 5 and rows[4]["fault"].startswith("BadZipFile")
    got = io.scan_sheet(spark, str(tmp_path / "book.xlsx"), {"file": ["file name"], "team": ["audit company"], "none": ["no such"]}).collect()
    assert [tuple(r) for r in got] == [("alpha", "team é"), ("True", "")]
    with pytest.raises(ValueError, match="BadZipFile"):
        workbook.scan_table(spark, str(tmp_path / "broken.xlsx"))
    assert workbook.column_number("AA7") == 26 and workbook.column_number("Z1") == 25


def test_existence(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "f.txt").write_text("x")
    assert io.exists(spark, str(tmp_path / "f.txt")) and io.exists(spark, str(tmp_path / "d")) and not io.exists(spark, str(tmp_path / "no"))


def test_key_counts_of_odd_values(spark):
    texts = ["not json", None, "", "[]", "{}", "[[[]]]", '{"a": "{\\"b\\": 1}"}', '[{"a": [1, {"b": null}]}]', '{"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": 1}}}}}}}}']
    got = {(r["level"], r["key"]): r["n"] for r in corpus.key_counts(spark.createDataFrame([(t,) for t in texts], "json string")).collect()}
    # a text that holds an object counts as one
    assert got == {(0, "a"): 3, (1, "b"): 3, **{(k, "abcdefgh"[k]): 1 for k in range(2, 8)}}
    assert corpus.key_counts(spark.createDataFrame([], "json string")).isEmpty()


def instructions(spark, *codes):
    return graphs.with_blocks(evm.disassemble(spark.createDataFrame(list(enumerate(codes)), "fp long, code string"))).withColumn("fp", F.col("fp").cast("long"))


def test_jumps_across_blocks(spark):
    codes = [
        "600660045600" + "5b565b00",  # ret 6, call 4?, see below
        "6008600556" + "5b905600" + "00",  # a swap of one known entry and one unknown
        "60035b80600357",  # a loop that keeps its own target
        "600556" + "0c" + "5b56",  # unknown instruction; nothing comes behind a jump
        "56",  # nothing on the stack
    ]
    codes[0] = "6007" + "6005" + "56" + "5b56" + "5b00"  # push 7, push 5, jump; at 5: jump to what is below; at 7: stop
    got = {(r["fp"], r["src"], r["dst"], r["edge_type"]) for r in jumps.resolved_jumps(instructions(spark, *codes)).collect()}
    assert (0, 5, 7, "jump") in got
    assert {x for x in got if x[0] in (3, 4)} == set()


def facts_by_loop(rows):
    """Targets of each block of one code, by walking all facts to a fixpoint with sets."""
    blocks = {}
    for r in rows:
        blocks.setdefault(r["basic_block_id"], []).append(r)
    starts, moves = {}, {}
    for k, b in sorted(blocks.items()):
        b.sort(key=lambda r: r["pc"])
        starts[k] = b[0]["pc"]
        moves[starts[k]] = jumps.transfer([(r["opcode"], r["push_data"]) for r in b]), b[-1]["opcode"]
    order = sorted(moves)
    marks = {r["pc"] for r in rows if r["opcode"] == "JUMPDEST"}
    facts, targets = {s: set() for s in order}, {s: set() for s in order}
    while True:
        before = sum(map(len, facts.values())) + sum(map(len, targets.values()))
        for s, after in zip(order, [*order[1:], None], strict=True):
            (dead, takes, net, slot, value, slots), last = moves[s]
            if dead:
                continue
            if value in marks:
                targets[s].add(value)
            targets[s] |= {v for k, v in facts[s] if k == slot}
            left = {(k, v) for k, e, v in slots if v in marks} | {(k, v) for k, e, _ in slots for f, v in facts[s] if e == f and e is not None}
            left |= {(k + net, v) for k, v in facts[s] if k >= takes}
            on = [after] if after is not None and last not in ("JUMP", *evm.HALTING) else []
            for t in [*on, *targets[s]]:
                if t in facts:
                    facts[t] |= {(k, v) for k, v in left if k < jumps.DEPTH}
        if before == sum(map(len, facts.values())) + sum(map(len, targets.values())):
            return {(s, t) for s, x in targets.items() for t in x}


def test_jump_targets_equal_a_loop(spark):
    r = random.Random(6)
    parts = ["5b", "80", "81", "90", "91", "50", "56", "57", "6001", "01", "600256", "600457", "60086004", "6006", "0c", "00", "54"]
    codes = ["5b5b5b5b5b5b5b5b5b" + "".join(r.choice(parts) for _ in range(14)) for _ in range(8)]
    ins = instructions(spark, *codes).persist()
    _, edges = jumps.stack_facts(ins, graphs.fallback_cfg(ins))
    got = {(x["fp"], x["src"], x["dst"]) for x in edges.collect()}
    want = {(k, *e) for k in range(8) for e in facts_by_loop([x for x in ins.where(F.col("fp") == k).collect()])}
    ins.unpersist()
    assert got == want and want


def test_layers_of_nodes_without_edges(spark):
    nodes = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, -1.0]), (2, 0, [0.5, 0.5])], "fp long, node int, h array<double>")
    edges = spark.createDataFrame([(1, 0, 1, 0), (1, 0, 1, 1), (1, 1, 1, 0), (1, 0, 7, 0)], "fp long, s int, t int, type_id int")
    same = layers.Linear([[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0])
    got = {(r["fp"], r["node"]): r["h"] for r in layers.convolve(nodes, edges.where("t < 7"), same).collect()}
    # node 1 has two edges from node 0 and its own loop (a loop in the table is the same one)
    want = {(1, 0): [1.0, 2.0], (1, 1): [2 * 1 / math.sqrt(3) + 1.0, 2 * 2 / math.sqrt(3) - 1 / 3], (2, 0): [0.5, 0.5]}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    layer = layers.TypedAttention([same] * 2, [same] * 2, [same] * 2, same, layers.Linear([[0.0, 0.0]] * 8), layers.Linear([[0.0] * 8] * 2), heads=2)
    out = {(r["fp"], r["node"]): r["h"] for r in layers.typed_attention(nodes, edges, layer).collect()}
    assert set(out) == set(want) and np.allclose(out[2, 0], [0.0, 0.0], atol=1e-6)
    biased = layers.typed_attention(nodes, edges, layer, spark.createDataFrame([(1, 1, 5.0)], "fp long, node int, bias double"))
    # one number for all edges of a node does not change their softmax
    assert all(np.allclose(r["h"], out[r["fp"], r["node"]]) for r in biased.collect())
    assert layers.convolve(nodes.where("false"), edges, same).isEmpty()


def test_window_embeddings_by_loop(spark):
    r = random.Random(3)
    vectors = [[r.random(), r.random()] for _ in range(12)]
    texts = [(i, [r.randrange(12) for _ in range(n)]) for i, n in enumerate([0, 1, 6, 7, 8, 20, 33, 64])] + [(50, [1, 2] * 9), (51, [0] * 9)]
    size, stride, first, last = 8, 3, 1, 2

    def mean(rows):
        rows = [t for t in rows if t != 0]
        return np.mean([vectors[t] for t in rows], axis=0)

    got = {x["id"]: (x["windows"], x["h"]) for x in features.window_embeddings(spark.createDataFrame(texts, "id int, tokens array<int>"), spark.createDataFrame(list(enumerate(vectors)), "token int, v array<double>"), 2, size, stride).collect()}
    for i, tokens in texts:
        if len(tokens) <= size - 2:
            windows = [tokens]
        else:
            bare = [t for t in tokens if t not in (first, last)]
            windows = [bare[k : k + size - 2] for k in range(0, len(bare), stride)] or [[]]
        want = np.mean([mean([first, *w, last]) for w in windows], axis=0)
        assert got[i][0] == len(windows) and np.allclose(got[i][1], want), i


@pytest.mark.parametrize("name", ["graph_counts", "graph_features", "graph_edge_types", "dfg_edges", "cfg_fallback"])
def test_graph_plans_run_code_once(spark, tables, name):
    """Instructions come from a written step; at most one pass through Python is left in the plan."""
    plan = catalog.QUERIES[name](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") <= 1


def test_vocabulary_by_loop(spark):
    """Ties at the last place, words that repeat within a text and pairs of them count as they should."""
    import re
    from collections import Counter

    r = random.Random(5)
    texts = [" ".join(r.choice("alpha beta gamma delta x yy zz_1 Alpha".split()) for _ in range(r.randint(0, 12))) for _ in range(40)] + [None, "", "solo", "a b c"]
    total, df = Counter(), Counter()
    for t in texts:
        w = re.findall(r"\b[a-z0-9_]{2,}\b", (t or "").lower())
        terms = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        total.update(terms)
        df.update(set(terms))
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for top in (1, 3, 5, 8, 20, 500):
        best = sorted(sorted(total), key=lambda t: -total[t])[:top]
        want = {t: (i, round(math.log((1 + len(texts)) / (1 + df[t])) + 1, 9)) for i, t in enumerate(sorted(best))}
        assert {x["term"]: (x["idx"], round(x["idf"], 9)) for x in features.vocabulary(frame, top).collect()} == want
