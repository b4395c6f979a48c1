"""Queries over predictions, runs, splits and learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytequarry.functions import text as T
from bytequarry.operators import checks, learn, metrics, runs, splits
from bytequarry.plans import proxies as P
from bytequarry.plans.registry import query
from bytequarry.session import read_table

_R = 6


def _round(df, *cols):
    return df.withColumns({c: F.round(c, _R) for c in cols})


_COUNT = "count(*) FILTER (WHERE prob >= {0} AND target = 1) AS tp, count(*) FILTER (WHERE prob >= {0} AND target = 0) AS fp, count(*) FILTER (WHERE prob < {0} AND target = 1) AS fn, count(*) FILTER (WHERE prob < {0} AND target = 0) AS tn"
_RATES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END AS accuracy,
CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc"""
_LABEL = P.PRED_SQL + f", cn AS (SELECT label_id, {_COUNT.format('0.5')}, count(target) AS assessed FROM pred GROUP BY label_id), pl AS (SELECT *, {_RATES} FROM cn)"
_AP = """st AS (SELECT label_id, prob, sum(target) AS p, count(*) AS n FROM pred WHERE target IS NOT NULL GROUP BY label_id, prob),
cu AS (SELECT *, sum(p) OVER (PARTITION BY label_id ORDER BY prob DESC) AS cp, sum(n) OVER (PARTITION BY label_id ORDER BY prob DESC) AS c, sum(p) OVER (PARTITION BY label_id) AS tp, sum(n) OVER (PARTITION BY label_id) AS tn FROM st),
ap AS (SELECT label_id, CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN sum(p / tp * (cp / c)) END AS ap FROM cu GROUP BY label_id)"""


@query("confusion", f"WITH {_LABEL} SELECT label_id, tp, fp, fn, tn, assessed, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, round(mcc, 6) AS mcc FROM pl")
def confusion(s, d):
    return _round(metrics.per_label(P.predictions(s, d), F.lit(0.5)), "precision", "recall", "f1", "accuracy", "mcc")


@query("average_precision", f"WITH {P.PRED_SQL}, {_AP} SELECT label_id, round(ap, 6) AS ap FROM ap")
def average_precision(s, d):
    return _round(metrics.average_precision(P.predictions(s, d)), "ap")


@query("masked_metrics", f"""WITH {_LABEL}, {_AP}, mi AS (SELECT sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn FROM pl WHERE assessed > 0)
SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(avg(mcc), 6) AS macro_mcc,
(SELECT round(tp / (tp + fp), 6) FROM mi) AS micro_precision, (SELECT round(tp / (tp + fn), 6) FROM mi) AS micro_recall, (SELECT round(2 * tp / (2 * tp + fp + fn), 6) FROM mi) AS micro_f1,
(SELECT round(avg(ap), 6) FROM ap) AS macro_ap,
(SELECT round(avg(ok::INT), 6) FROM (SELECT bool_and((prob >= 0.5) = (target = 1)) AS ok FROM pred WHERE target IS NOT NULL GROUP BY id)) AS subset_accuracy FROM pl WHERE assessed > 0""")
def masked_metrics(s, d):
    m = metrics.summary(P.predictions(s, d))
    return _round(m, *m.columns)


@query("subset_accuracy", f"WITH {P.PRED_SQL} SELECT round(avg(ok::INT), 6) AS subset_accuracy FROM (SELECT bool_and((prob >= 0.5) = (target = 1)) AS ok FROM pred WHERE target IS NOT NULL GROUP BY id)")
def subset_accuracy(s, d):
    return _round(metrics.subset_accuracy(P.predictions(s, d)), "subset_accuracy")


_CLIP = "least(greatest(prob, 1e-8), 1 - 1e-8)"


@query("masked_bce", f"WITH {P.PRED_SQL}, q AS (SELECT target AS y, {_CLIP} AS p, ln({_CLIP} / (1 - {_CLIP})) AS x FROM pred WHERE target IS NOT NULL) SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS bce, round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 6) AS bce_logits FROM q")
def masked_bce(s, d):
    return _round(metrics.masked_bce(P.predictions(s, d)), "bce", "bce_logits")


@query("masked_focal", f"WITH {P.PRED_SQL}, q AS (SELECT CASE WHEN target = 1 THEN {_CLIP} ELSE 1 - {_CLIP} END AS pt FROM pred WHERE target IS NOT NULL) SELECT round(avg(-pow(1 - pt, 2) * ln(pt)), 6) AS focal FROM q")
def masked_focal(s, d):
    return _round(metrics.masked_focal(P.predictions(s, d)), "focal")


@query("sigmoid", f"WITH {P.PRED_SQL} SELECT id, label_id, round(1 / (1 + exp(-(prob * 8 - 4))), 6) AS p, round(ln(least(greatest(prob, 1e-6), 1 - 1e-6) / (1 - least(greatest(prob, 1e-6), 1 - 1e-6))), 6) AS logit FROM pred")
def sigmoid(s, d):
    return P.predictions(s, d).select("id", "label_id", F.round(T.sigmoid(F.col("prob") * 8 - 4), _R).alias("p"), F.round(T.logit(F.col("prob")), _R).alias("logit"))


_GRID = ", ".join(f"({t})" for t in metrics.GRID)


@query("threshold_sweep", f"""WITH {P.PRED_SQL}, g(t) AS (SELECT x::DOUBLE FROM (VALUES {_GRID}) v(x)), c AS (SELECT label_id, t, {_COUNT.format('t')}, count(target) AS assessed FROM pred, g GROUP BY label_id, t),
f AS (SELECT label_id, t, assessed, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c)
SELECT label_id, CASE WHEN assessed > 0 THEN t ELSE 0.5::DOUBLE END AS threshold, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY f1 DESC, t) = 1""")
def threshold_sweep(s, d):
    return _round(metrics.threshold_sweep(P.predictions(s, d)), "f1")


@query("cv_metrics", f"""WITH {P.PRED_SQL}, c AS (SELECT fold, label_id, {_COUNT.format('0.5')} FROM pred GROUP BY ALL), f AS (SELECT fold, avg(CASE WHEN tp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS f FROM c GROUP BY fold)
SELECT round(avg(f), 6) AS macro_f1_mean, round(stddev_pop(f), 6) AS macro_f1_std FROM f""")
def cv_metrics(s, d):
    return _round(metrics.cv_macro(P.predictions(s, d)), "macro_f1_mean", "macro_f1_std")


@query("positive_weights", f"WITH {P.PRED_SQL}, n AS (SELECT label_id, count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target = 0) AS neg FROM pred GROUP BY label_id) SELECT *, round(least(greatest(neg / greatest(pos, 1), 1.0::DOUBLE), 100.0::DOUBLE), 6) AS weight FROM n")
def positive_weights(s, d):
    return _round(metrics.positive_weights(P.predictions(s, d)), "weight")


@query("batch_metrics", f"WITH {P.PRED_SQL} SELECT round(avg(((prob >= 0.5) = (target = 1))::INT), 6) AS accuracy, round(avg((prob >= 0.5)::INT), 6) AS pred_rate, round(avg(target), 6) AS target_rate FROM pred WHERE target IS NOT NULL")
def batch_metrics(s, d):
    return _round(metrics.batch_metrics(P.predictions(s, d)), "accuracy", "pred_rate", "target_rate")


_SEED = P.RUNS_SQL + ", ag AS (SELECT variant, model, count(DISTINCT seed) AS seeds, count(*) AS n, avg(metric) AS mean, coalesce(stddev_samp(metric), 0) AS std FROM runs GROUP BY variant, model)"


def _agg(s, d):
    return runs.seed_aggregate(P.runs(s, d), ["variant", "model"])


@query("seed_aggregate", f"WITH {_SEED} SELECT variant, model, seeds, n, round(mean, 6) AS mean, round(std, 6) AS std FROM ag")
def seed_aggregate(s, d):
    return _round(_agg(s, d), "mean", "std")


@query("leaderboard", f"WITH {_SEED} SELECT variant, model, round(mean, 6) AS mean, row_number() OVER (PARTITION BY variant ORDER BY mean DESC, model)::INT AS rank FROM ag")
def leaderboard(s, d):
    return runs.leaderboard(_agg(s, d)).select("variant", "model", F.round("mean", _R).alias("mean"), "rank")


@query("ablation_delta", f"WITH {_SEED} SELECT a.model, round(a.mean, 6) AS base, round(b.mean, 6) AS compare, round(b.mean - a.mean, 6) AS delta FROM ag a JOIN ag b USING (model) WHERE a.variant = 'v0' AND b.variant = 'v1'")
def ablation_delta(s, d):
    return _round(runs.ablation_delta(_agg(s, d), "v0", "v1"), "base", "compare", "delta")


@query("ablation_pivot", f"WITH {P.RUNS_SQL} SELECT model, round(coalesce(avg(metric) FILTER (WHERE variant = 'v0'), 0), 6) AS v0, round(coalesce(avg(metric) FILTER (WHERE variant = 'v1'), 0), 6) AS v1, 0.0::DOUBLE AS v2 FROM runs GROUP BY model")
def ablation_pivot(s, d):
    return _round(runs.ablation_pivot(P.runs(s, d), ["v0", "v1", "v2"]), "v0", "v1", "v2")


@query("cohens_d", f"""WITH {P.RUNS_SQL}, st AS (SELECT model, avg(metric) AS m, var_samp(metric) AS v FROM runs GROUP BY model), e AS (SELECT a.model AS a, b.model AS b, (a.m - b.m) / sqrt((a.v + b.v) / 2) AS d FROM st a JOIN st b ON a.model < b.model)
SELECT a, b, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude FROM e""")
def cohens_d(s, d):
    return _round(runs.pairwise_effects(P.runs(s, d)), "d")


_PAIRED = P.RUNS_SQL + """, me AS (SELECT model, variant, seed, avg(metric) AS m FROM runs GROUP BY ALL), pr AS (SELECT a.model AS comparison, a.m AS x, b.m AS y FROM me a JOIN me b ON a.model = b.model AND b.variant = 'v1' AND b.seed = (a.seed + 1) % 5 WHERE a.variant = 'v0'),
df AS (SELECT comparison, x - y AS d, round(abs(x - y), 9) AS size FROM pr WHERE abs(x - y) > 1e-12), rk AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY size) AS i FROM df),
ra AS (SELECT comparison, d, avg(i) OVER (PARTITION BY comparison, size) AS rank FROM rk),
wx AS (SELECT comparison, coalesce(sum(rank) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(rank) FILTER (WHERE d < 0), 0) AS w_minus, count(*) AS n FROM ra GROUP BY comparison)"""


def _wilcoxon(s, d):
    m = P.runs(s, d).groupBy("model", "variant", "seed").agg(F.avg("metric").alias("m"))
    a = m.where("variant = 'v0'").select("model", "seed", F.col("m").alias("x"))
    b = m.where("variant = 'v1'").select("model", ((F.col("seed") + 4) % 5).alias("seed"), F.col("m").alias("y"))
    return runs.wilcoxon_ranks(a.join(b, ["model", "seed"]).withColumnRenamed("model", "comparison"))


@query("wilcoxon_w", f"WITH {_PAIRED} SELECT comparison, w_plus, w_minus, n, (SELECT count(*) FROM pr WHERE pr.comparison = wx.comparison) AS pairs, least(w_plus, w_minus) AS w FROM wx")
def wilcoxon_w(s, d):
    return _wilcoxon(s, d).select("comparison", "w_plus", "w_minus", "n", "pairs", "w")


#: Sets of ranks 1 to n whose sum is at most w, by listing all.
_EXACT = "(SELECT count(*) FROM range((1 << n)::BIGINT) m(m) WHERE coalesce(list_sum([i for i in range(1, n + 1) if (m >> (i - 1)) & 1 = 1]), 0) <= floor({0}))"
_P = "CASE WHEN pairs < 3 THEN 'nan'::DOUBLE WHEN n < 3 THEN 1.0::DOUBLE ELSE least(1.0, 2.0 * " + _EXACT.format("w") + " / (1 << n)) END"
_WP = f", pc AS (SELECT comparison, count(*) AS pairs FROM pr GROUP BY comparison), wz AS (SELECT pc.comparison, pairs, coalesce(n, 0)::INT AS n, least(coalesce(w_plus, 0), coalesce(w_minus, 0)) AS w FROM pc LEFT JOIN wx USING (comparison)), pv AS (SELECT *, {_P} AS p FROM wz)"


@query("wilcoxon_p", f"WITH {_PAIRED}{_WP} SELECT comparison, round(p, 6) AS p, round(least(1.0, p * (SELECT count(*) FROM pv)), 6) AS p_adjusted FROM pv")
def wilcoxon_p(s, d):
    """Exact p-values of paired comparisons and their correction."""
    p = runs.with_wilcoxon_p(_wilcoxon(s, d)).select("comparison", "p")
    return _round(runs.bonferroni(p), "p", "p_adjusted")


def _significance_sql(which: str) -> str:
    return f"""{P.RUNS_SQL}, sm AS (SELECT model, seed, avg(metric) AS m FROM runs GROUP BY ALL), pr AS (SELECT a.model || ' ' || b.model AS comparison, a.model AS a, b.model AS b, a.m AS x, b.m AS y FROM sm a JOIN sm b ON a.seed = b.seed AND {which}),
df AS (SELECT comparison, x - y AS d, round(abs(x - y), 9) AS size FROM pr WHERE abs(x - y) > 1e-12), rk AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY size) AS i FROM df), ra AS (SELECT comparison, d, avg(i) OVER (PARTITION BY comparison, size) AS rank FROM rk),
wx AS (SELECT comparison, coalesce(sum(rank) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(rank) FILTER (WHERE d < 0), 0) AS w_minus, count(*) AS n FROM ra GROUP BY comparison){_WP},
ef AS (SELECT comparison, a, b, avg(x) - avg(y) AS diff, sqrt((var_samp(x) + var_samp(y)) / 2) AS sd FROM pr GROUP BY ALL), ed AS (SELECT *, diff / sd AS d FROM ef)
SELECT a, b, pairs, w, round(p, 6) AS p, round(least(1.0, p * (SELECT count(*) FROM pv)), 6) AS p_adjusted, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude FROM pv JOIN ed USING (comparison)"""


def _scores(s, d):
    return P.runs(s, d).groupBy("model", "seed").agg(F.avg("metric").alias("metric"))


@query("significance", f"WITH {_significance_sql('a.model < b.model')}")
def significance(s, d):
    return _round(runs.significance(_scores(s, d)), "p", "p_adjusted", "d")


@query("significance_reference", "WITH " + _significance_sql("a.model = 'click' AND b.model <> 'click'"))
def significance_reference(s, d):
    return _round(runs.significance(_scores(s, d), "click"), "p", "p_adjusted", "d")


@query("seed_metrics", "SELECT event_type AS model, count(DISTINCT user_id % 5) AS seeds, count(*) AS n, " + ", ".join(f"round(avg({e}), 6) AS {m}_mean, round(coalesce(stddev_samp({e}), 0), 6) AS {m}_std" for m, e in (("f1", "value"), ("mcc", "value - 1"), ("ap", "abs(value)"), ("precision", "value / 2"), ("recall", "value * value"))) + " FROM events GROUP BY 1")
def seed_metrics(s, d):
    v = F.col("metric")
    r = P.runs(s, d).select("model", "seed", v.alias("f1"), (v - 1).alias("mcc"), F.abs(v).alias("ap"), (v / 2).alias("precision"), (v * v).alias("recall"))
    m = runs.seed_metrics(r, ["model"], ["f1", "mcc", "ap", "precision", "recall"])
    return _round(m, *[c for c in m.columns if c.endswith(("_mean", "_std"))])


@query("bonferroni", "WITH p AS (SELECT s_suppkey AS k, (s_suppkey % 97) / 97.0::DOUBLE AS p FROM supplier) SELECT k, round(p, 6) AS p, round(least(p * (SELECT count(*) FROM p), 1.0), 6)::DOUBLE AS p_adjusted FROM p")
def bonferroni(s, d):
    p = read_table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") % 97) / F.lit(97.0)).alias("p"))
    return _round(runs.bonferroni(p), "p", "p_adjusted")


_MATRIX = P.RUNS_SQL + ", mx AS (SELECT variant, model, seed, variant || '__' || regexp_replace(model, '[^A-Za-z0-9_-]', '_', 'g') || '__seed' || seed AS run_id, 'pending' AS status FROM (SELECT DISTINCT variant FROM runs), (SELECT DISTINCT model FROM runs), (SELECT DISTINCT seed FROM runs))"


def _matrix(s, d):
    r = P.runs(s, d)
    return runs.run_matrix(*[r.select(c).distinct() for c in ("variant", "model", "seed")])


@query("run_matrix", f"WITH {_MATRIX} SELECT * FROM mx")
def run_matrix(s, d):
    return _matrix(s, d)


_PRIOR = _MATRIX + ", prior AS (SELECT run_id, CASE seed WHEN 0 THEN 'completed' WHEN 1 THEN 'running' ELSE 'failed' END AS status FROM mx WHERE seed < 3), rs AS (SELECT mx.* EXCLUDE (status), CASE WHEN p.status IS NULL OR p.status = 'running' THEN 'pending' ELSE p.status END AS status FROM mx LEFT JOIN prior p USING (run_id))"


def _resumed(s, d):
    m = _matrix(s, d)
    prior = m.where("seed < 3").withColumn("status", F.when(F.col("seed") == 0, "completed").when(F.col("seed") == 1, "running").otherwise("failed"))
    return runs.resume(m, prior)


@query("resume_merge", f"WITH {_PRIOR} SELECT * FROM rs")
def resume_merge(s, d):
    return _resumed(s, d).select("variant", "model", "seed", "run_id", "status")


@query("status_counts", f"WITH {_PRIOR} SELECT status, count(*) AS n FROM rs GROUP BY status")
def status_counts(s, d):
    return runs.status_counts(_resumed(s, d))


@query("select_runs", f"WITH {_PRIOR} SELECT variant, model, seed, run_id, status FROM rs WHERE status IN ('pending', 'failed') AND variant = 'v0' AND seed IN (1, 2, 4) ORDER BY run_id LIMIT 4")
def select_runs(s, d):
    return runs.select_runs(_resumed(s, d), {"variant": ["v0"], "seed": [1, 2, 4]}, rerun_failed=True, most=4).select("variant", "model", "seed", "run_id", "status")


@query("variant_faults", """WITH o AS (SELECT l_linestatus AS variant, l_returnflag AS split, count(*) AS observed FROM lineitem GROUP BY ALL), e AS (SELECT variant, split, observed + CASE split WHEN 'A' THEN 1 ELSE 0 END AS n FROM o UNION ALL SELECT 'none', 'train', 0),
j AS (SELECT coalesce(e.variant, o.variant) AS variant, coalesce(e.split, o.split) AS split, coalesce(n, 0)::BIGINT AS expected, coalesce(observed, 0) AS observed FROM e FULL JOIN o ON e.variant = o.variant AND e.split = o.split)
SELECT *, CASE WHEN expected <> observed THEN 'count_mismatch' ELSE 'empty_split' END AS fault FROM j WHERE expected <> observed OR observed = 0""")
def variant_faults(s, d):
    members = read_table(s, d, "lineitem").select(F.col("l_linestatus").alias("variant"), F.col("l_returnflag").alias("split"))
    n = members.groupBy("variant", "split").agg(F.count("*").alias("n")).withColumn("n", F.col("n") + (F.col("split") == "A").cast("long"))
    return runs.variant_faults(members, n.unionByName(s.createDataFrame([("none", "train", 0)], "variant string, split string, n long")))


_FOLD = ", ".join(f"({t!r})" for t in metrics.FOLD_GRID)
_TUNED = P.PRED_SQL + f""", vg(t) AS (SELECT x::DOUBLE FROM (VALUES {_FOLD}) v(x)), vc AS (SELECT fold, label_id, t, {_COUNT.format('t')}, count(target) AS assessed FROM pred, vg WHERE id % 2 = 0 GROUP BY ALL),
vt AS (SELECT fold, label_id, t FROM vc WHERE assessed >= 2 AND tp + fn > 0 QUALIFY row_number() OVER (PARTITION BY fold, label_id ORDER BY CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END DESC, t) = 1),
tj AS (SELECT pred.*, coalesce(t, 0.5) AS t FROM pred LEFT JOIN vt USING (fold, label_id) WHERE id % 2 = 1), tc AS (SELECT fold, label_id, t AS threshold, {_COUNT.format('t')} FROM tj GROUP BY ALL),
tu AS (SELECT *, CASE WHEN tp + fn > 0 AND 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tp + fn > 0 AND tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM tc)"""


def _tuned(s, d):
    p = P.predictions(s, d)
    return metrics.cv_tuned(p.where("id % 2 = 0"), p.where("id % 2 = 1"))


@query("cv_tuned", f"WITH {_TUNED} SELECT fold, label_id, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM tu")
def cv_tuned(s, d):
    return _round(_tuned(s, d), "threshold", "f1", "precision", "recall").select("fold", "label_id", "threshold", "tp", "fp", "fn", "tn", "f1", "precision", "recall")


@query("cv_summary", f"WITH {_TUNED}, sf AS (SELECT fold, avg(f1) AS ma, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn FROM tu GROUP BY fold), sg AS (SELECT ma, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS mi FROM sf) SELECT round(avg(ma), 6) AS macro_f1_mean, round(stddev_pop(ma), 6) AS macro_f1_std, round(avg(mi), 6) AS micro_f1_mean, round(stddev_pop(mi), 6) AS micro_f1_std FROM sg")
def cv_summary(s, d):
    m = metrics.cv_summary(_tuned(s, d))
    return _round(m, *m.columns)


@query("completeness", f"WITH {_PRIOR} SELECT variant, count(*) AS runs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status <> 'completed') AS missing FROM rs GROUP BY variant")
def completeness(s, d):
    r = _resumed(s, d)
    return runs.completeness(r, r.where("status = 'completed'"))


@query("validation_issues", "SELECT 'lineitem' AS relation, 'duplicate_key' AS issue, count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT 'labels', 'missing_parent', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) HAVING count(*) > 0")
def validation_issues(s, d):
    line, lab, docs = read_table(s, d, "lineitem"), read_table(s, d, "labels"), read_table(s, d, "documents")
    return checks.issues([
        checks.duplicate_keys(line, "lineitem", "l_orderkey"), checks.duplicate_keys(docs, "documents", "doc_id"),
        checks.missing_parent(lab, "labels", docs.where("doc_id % 2 = 0"), "doc_id"),
    ])


@query("metadata_summary", f"WITH sp AS (SELECT doc_id, {P.SPLIT_SQL} AS split FROM (SELECT doc_id, {P.split_hash_sql('doc_id')} AS h FROM documents)) SELECT split, count(*) AS n, count(*) FILTER (WHERE n_chars < 300) AS stubs, count(*) FILTER (WHERE doc_id % 11 = 0) AS proxies, count(*) FILTER (WHERE doc_id % 13 = 0) AS unavailable, (SELECT string_agg(source || ':' || n, ',' ORDER BY source) FROM (SELECT s2.split, d2.source, count(*) AS n FROM sp s2 JOIN documents d2 USING (doc_id) GROUP BY ALL) m WHERE m.split = sp.split) AS sources FROM sp JOIN documents USING (doc_id) GROUP BY split")
def metadata_summary(s, d):
    from bytequarry.operators.corpus import hash_split

    x = read_table(s, d, "documents").withColumn("split", hash_split(F.col("doc_id")))
    n = x.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 300).alias("stubs"), F.count_if(F.col("doc_id") % 11 == 0).alias("proxies"), F.count_if(F.col("doc_id") % 13 == 0).alias("unavailable"))
    per = x.groupBy("split", "source").agg(F.count("*").alias("m")).groupBy("split").agg(F.array_sort(F.collect_list(F.struct("source", "m"))).alias("s"))
    return n.join(per, "split").select("split", "n", "stubs", "proxies", "unavailable", F.array_join(F.transform("s", lambda y: F.concat(y["source"], F.lit(":"), y["m"].cast("string"))), ",").alias("sources"))


@query("iterative_split")
def iterative_split(s, d):
    """A stratified 80/10/10 split of the labelled documents."""
    return splits.stratified(P.predictions(s, d).where("target IS NOT NULL"))


_DRAWS = f"""WITH {P.PRED_SQL}, nn AS (SELECT label_id, count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target = 0) AS neg FROM pred GROUP BY label_id), ww AS (SELECT label_id, least(neg / pos, 20.0) AS w FROM nn WHERE pos > 0),
sw AS (SELECT id, greatest(coalesce(max(CASE WHEN target = 1 THEN w END), 1.0), 1.0)::DOUBLE AS weight FROM pred LEFT JOIN ww USING (label_id) GROUP BY id),
bu AS (SELECT *, ('0x' || substr(sha256('0|' || id), 1, 12))::BIGINT % 256 AS b FROM sw), cu AS (SELECT id, weight, sum(weight) OVER (ORDER BY b, id) AS upto, sum(weight) OVER () AS total, count(*) OVER () AS n FROM bu),
dr AS (SELECT id, (floor(round(upto / total * n, 6) + 0.5) - floor(round((upto - weight) / total * n, 6) + 0.5))::INT AS draws FROM cu) SELECT * FROM dr WHERE draws > 0"""


@query("weighted_sample", _DRAWS)
def weighted_sample(s, d):
    """As many draws with replacement as there are rows, in proportion to the rows' weights."""
    return splits.weighted_draws(metrics.sample_weights(P.predictions(s, d)))


@query("ovr_logistic")
def ovr_logistic(s, d):
    """Class probabilities of a one-vs-rest logistic model over simple text features."""
    return learn.one_vs_rest(learn.text_features(read_table(s, d, "documents")), P.predictions(s, d), "logistic")


@query("ovr_forest")
def ovr_forest(s, d):
    return learn.one_vs_rest(learn.text_features(read_table(s, d, "documents")), P.predictions(s, d), "forest")


@query("ovr_boosted")
def ovr_boosted(s, d):
    return learn.one_vs_rest(learn.text_features(read_table(s, d, "documents")), P.predictions(s, d), "boosted")


@query("ovr_network")
def ovr_network(s, d):
    """Class probabilities of a network with two hidden layers over characters."""
    return learn.one_vs_rest(learn.text_features(read_table(s, d, "documents")), P.predictions(s, d), "network")


@query("ovr_network_lines")
def ovr_network_lines(s, d):
    """The same over lines and words."""
    docs = read_table(s, d, "documents")
    return learn.one_vs_rest(learn.by_mode(learn.text_features(docs), learn.line_features(docs), "second_only"), P.predictions(s, d), "network")


@query("ovr_network_both")
def ovr_network_both(s, d):
    """The same over both."""
    docs = read_table(s, d, "documents")
    return learn.one_vs_rest(learn.by_mode(learn.text_features(docs), learn.line_features(docs), "both"), P.predictions(s, d), "network")


@query("tuned_logistic")
def tuned_logistic(s, d):
    """Three strengths of regularisation by macro F1 on a fifth of the labelled documents."""
    p = P.predictions(s, d).where("target IS NOT NULL")
    x = learn.text_features(read_table(s, d, "documents"))
    return learn.tune(x, p.where("fold <> 0"), p.where("fold = 0"), [{"regParam": r} for r in (0.001, 0.01, 0.1)])


@query("preserved_rows", "WITH a AS (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 10 = 1 UNION ALL SELECT -1), j AS (SELECT b.n AS b, a.n AS a FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1) b FULL JOIN (SELECT doc_id, count(*) AS n FROM a GROUP BY 1) a USING (doc_id)) SELECT sum(b)::BIGINT AS rows_before, sum(a)::BIGINT AS rows_after, count(*) FILTER (WHERE a IS NULL) AS lost, count(*) FILTER (WHERE b IS NULL) AS added, count(*) FILTER (WHERE a > 1) AS repeated, false AS ok FROM j")
def preserved_rows(s, d):
    docs = read_table(s, d, "documents").select("doc_id")
    after = docs.where("doc_id % 10 <> 0").unionByName(docs.where("doc_id % 10 = 1")).unionByName(s.range(1).select(F.lit(-1).cast("long").alias("doc_id")))
    return checks.preserved(docs, after, "doc_id")
