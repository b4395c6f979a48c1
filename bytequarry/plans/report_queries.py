"""Queries over cascades, published tables and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytequarry.operators import figures, metrics, reports, runs
from bytequarry.plans import proxies as P
from bytequarry.plans.registry import query
from bytequarry.session import read_table


@query("failure_cause", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN event_type WHEN event_id % 4 = 2 THEN 'artifact' ELSE 'graph_unavailable' END AS cause FROM events")
def failure_cause(s, d):
    m = F.col("event_id") % 4
    c = reports.failure_cause(m == 0, F.when(m == 1, F.col("event_type")).otherwise("  "), F.when(m == 2, "artifact"))
    return read_table(s, d, "events").select("event_id", c.alias("cause"))


@query("backend_counts", "SELECT event_type AS split, CASE WHEN event_id % 5 = 0 THEN 'external' WHEN event_id % 5 < 4 THEN 'fallback' ELSE 'none' END AS backend, count(*) AS n FROM events GROUP BY ALL")
def backend_counts(s, d):
    m = F.col("event_id") % 5
    b = reports.backend(("external", m == 0), ("fallback", m < 4))
    return read_table(s, d, "events").groupBy(F.col("event_type").alias("split"), b.alias("backend")).agg(F.count("*").alias("n"))


@query("observed_classes", f"WITH {P.VOTES_SQL} SELECT DISTINCT swc_id FROM votes WHERE swc_id BETWEEN 100 AND 104")
def observed_classes(s, d):
    return reports.parse_classes(None, P.votes(s, d), 100, 104)


@query("listed_classes", "SELECT x::INT AS swc_id FROM (VALUES (101), (107), (115)) v(x)")
def listed_classes(s, d):
    return reports.parse_classes("115, 101 107,101", P.votes(s, d))


@query("enriched_features", "WITH a AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) SELECT n_nationkey AS k, coalesce(suppliers, 0) AS suppliers, coalesce(customers, 0) AS customers FROM nation LEFT JOIN a ON a.k = n_nationkey LEFT JOIN b ON b.k = n_nationkey")
def enriched_features(s, d):
    a = read_table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = read_table(s, d, "customer").where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return reports.enrich(read_table(s, d, "nation").select(F.col("n_nationkey").alias("k")), [a, b], "k")


@query("nested_sample", "WITH g AS (SELECT DISTINCT source FROM documents ORDER BY sha256('0|' || source), source LIMIT 4) SELECT source, doc_id FROM documents WHERE source IN (SELECT source FROM g) QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('0|' || doc_id), doc_id) <= 5")
def nested_sample(s, d):
    return reports.nested_sample(read_table(s, d, "documents").select("source", "doc_id"), "source", "doc_id", 4, 5)


_SEED = P.RUNS_SQL + ", ag AS (SELECT variant, model, count(DISTINCT seed) AS seeds, count(*) AS n, avg(metric) AS mean, coalesce(stddev_samp(metric), 0) AS std FROM runs GROUP BY variant, model)"


def _agg(s, d):
    return runs.seed_aggregate(P.runs(s, d), ["variant", "model"])


@query("external_baselines", f"WITH {_SEED} SELECT variant, model, seeds, n, round(mean, 6) AS mean, round(std, 6) AS std FROM (SELECT variant, model, seeds, n, mean, std FROM ag UNION ALL SELECT 'v0', 'published', 1, 1, 0.5, 0)")
def external_baselines(s, d):
    t = reports.with_baselines(_agg(s, d), [("v0", "published", 0.5)])
    return t.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("results_table", f"WITH {_SEED} SELECT model, printf('%.4f', mean) || ' ± ' || printf('%.4f', std) AS score FROM ag WHERE variant = 'v1' ORDER BY mean DESC, model LIMIT 3")
def results_table(s, d):
    return reports.results_table(_agg(s, d), "v1", 3)


@query("seed_mean_by_class", f"WITH {P.PRED_SQL}, c AS (SELECT fold, label_id, count(*) FILTER (WHERE prob >= 0.5 AND target = 1) AS tp, count(*) FILTER (WHERE prob >= 0.5 AND target = 0) AS fp, count(*) FILTER (WHERE prob < 0.5 AND target = 1) AS fn FROM pred GROUP BY ALL) SELECT label_id, round(avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END), 6) AS precision, round(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END), 6) AS recall, round(avg(tp + fn), 6) AS support FROM c GROUP BY label_id")
def seed_mean_by_class(s, d):
    n = P.predictions(s, d).groupBy("fold", "label_id").agg(*[v.alias(k) for k, v in metrics.counts(F.lit(0.5)).items()])
    r = metrics.rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return n.groupBy("label_id").agg(F.round(F.avg(r["precision"]), 6).alias("precision"), F.round(F.avg(r["recall"]), 6).alias("recall"), F.round(F.avg(F.col("tp") + F.col("fn")), 6).alias("support"))


@query("quantiles", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.95), 6) AS p95 FROM lineitem GROUP BY 1")
def quantiles(s, d):
    q = reports.quantiles(read_table(s, d, "lineitem"), F.col("l_quantity"), "l_returnflag")
    return q.select("l_returnflag", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@query("stale_runs", "WITH r AS (SELECT CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'failed' END AS status, ts FROM events) SELECT status, count(*) AS n, count(*) FILTER (WHERE status = 'running' AND epoch((SELECT max(ts) FROM events)) - epoch(ts) > 180) AS stale FROM r GROUP BY 1")
def stale_runs(s, d):
    e = read_table(s, d, "events")
    m = F.col("event_id") % 3
    status = F.when(m == 0, "running").when(m == 1, "completed").otherwise("failed")
    now = e.agg(F.max("ts").alias("now"))
    r = e.join(F.broadcast(now)).select(status.alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("updated"), "now")
    return reports.stale_runs(r, F.col("now"))


@query("strict_threshold_sweep", f"WITH {P.PRED_SQL}, g AS (SELECT round(0.05 * i, 2)::DOUBLE AS t FROM range(1, 19) x(i)), c AS (SELECT label_id, t, count(*) FILTER (WHERE prob >= t AND target = 1) AS tp, count(*) FILTER (WHERE prob >= t AND target = 0) AS fp, count(*) FILTER (WHERE prob < t AND target = 1) AS fn FROM pred, g WHERE target IS NOT NULL GROUP BY ALL), f AS (SELECT label_id, t, round(2 * tp / (2 * tp + fp + fn + 1e-9), 9) AS f1 FROM c) SELECT label_id, t AS threshold, f1 FROM f QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY f1 DESC, t) = 1")
def strict_threshold_sweep(s, d):
    return reports.strict_threshold_sweep(P.predictions(s, d))


@query("split_overlap_issues", "SELECT 'documents' AS relation, 'split_overlap' AS issue, count(*) AS n FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1) HAVING count(*) > 0")
def split_overlap_issues(s, d):
    from bytequarry.operators import checks

    return checks.overlapping_splits(read_table(s, d, "events"), "documents", "user_id", "event_type")


_METRICS = {"f1": "value", "mcc": "value - 1", "ap": "abs(value)"}
_TABLE = "tb AS (SELECT event_type AS model, " + ", ".join(f"avg({e}) AS {m}_mean, coalesce(stddev_samp({e}), 0) AS {m}_std" for m, e in _METRICS.items()) + " FROM events GROUP BY 1)"


def _table(s, d):
    v = F.col("metric")
    r = P.runs(s, d).select("model", "seed", v.alias("f1"), (v - 1).alias("mcc"), F.abs(v).alias("ap"))
    return runs.seed_metrics(r, ["model"], list(_METRICS))


@query("table_main", f"WITH {_TABLE} SELECT row_number() OVER (ORDER BY f1_mean DESC, model)::INT AS place, model, " + ", ".join(f"printf('%.4f', {m}_mean) || ' ± ' || printf('%.4f', {m}_std) AS {m}" for m in _METRICS) + " FROM tb")
def table_main(s, d):
    return reports.metric_table(_table(s, d), list(_METRICS))


@query("table_ablation", f"WITH {_TABLE} SELECT model, printf('%.4f', f1_mean) AS f1, CASE WHEN model = 'click' THEN '-' ELSE printf('%+.4f', f1_mean - (SELECT f1_mean FROM tb WHERE model = 'click')) END AS delta FROM tb")
def table_ablation(s, d):
    return reports.ablation_table(_table(s, d), "click", "f1")


@query("table_classes", """WITH c AS (SELECT event_type AS model, user_id % 3 AS label_id, value AS f1 FROM events), m AS (SELECT model FROM c GROUP BY model ORDER BY avg(f1) DESC, model LIMIT 3),
g AS (SELECT model, label_id, avg(f1) AS f1 FROM c WHERE model IN (SELECT model FROM m) GROUP BY ALL) SELECT model, label_id, round(f1, 6) AS f1, f1 = max(f1) OVER (PARTITION BY label_id) AS best FROM g""")
def table_classes(s, d):
    e = read_table(s, d, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 3).alias("label_id"), F.col("value").alias("f1"))
    return reports.class_table(e, 3).withColumn("f1", F.round("f1", 6))


@query("table_efficiency", "WITH n AS (SELECT event_type AS model, count(*) AS runs, avg(1 + event_id % 17) AS seconds FROM events GROUP BY 1) SELECT model, runs, round(seconds, 6) AS seconds, round(seconds / (SELECT min(seconds) FROM n), 6) AS relative FROM n")
def table_efficiency(s, d):
    t = reports.efficiency_table(read_table(s, d, "events").select(F.col("event_type").alias("model"), (1 + F.col("event_id") % 17).alias("seconds")))
    return t.withColumns({c: F.round(c, 6) for c in ("seconds", "relative")})


@query("inner_features", "SELECT k, suppliers, customers FROM (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) USING (k)")
def inner_features(s, d):
    a = read_table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = read_table(s, d, "customer").where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return reports.inner_features([a, b], "k")


@query("run_snapshot", "WITH r AS (SELECT CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'pending' END AS status, epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', ts)) AS age FROM events) SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'running' AND age > 180) AS stale, round(count(*) FILTER (WHERE status IN ('completed', 'failed')) / count(*), 6) AS done_share, min(age)::BIGINT AS latest_age FROM r")
def run_snapshot(s, d):
    e = read_table(s, d, "events")
    m = F.col("event_id") % 4
    status = F.when(m == 0, "running").when(m == 1, "completed").when(m == 2, "failed").otherwise("pending")
    now = e.agg(F.date_trunc("second", F.max("ts")).alias("now"))
    r = e.join(F.broadcast(now)).select(status.alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("updated"), "now")
    return reports.snapshot(r, F.col("now"))


@query("figure_bars", f"WITH {_TABLE} SELECT row_number() OVER (ORDER BY f1_mean DESC, model)::INT AS place, model, round(f1_mean, 6) AS mean, round(f1_std, 6) AS std FROM tb")
def figure_bars(s, d):
    return figures.bars(_table(s, d), "f1_mean", "f1_std").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("figure_metrics", f"WITH {_TABLE}, p AS (SELECT *, row_number() OVER (ORDER BY f1_mean DESC, model)::INT AS place FROM tb) " + " UNION ALL ".join(f"SELECT place, model, '{m}' AS metric, {i} AS at, round({m}_mean, 6) AS mean, round({m}_std, 6) AS std FROM p WHERE place <= 3" for i, m in enumerate(_METRICS)))
def figure_metrics(s, d):
    """Several metrics of the three best models."""
    return figures.grouped_bars(_table(s, d), list(_METRICS), "f1", 3).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("figure_heatmap", """WITH c AS (SELECT event_type AS model, user_id % 7 AS label_id, value / 400 AS f1 FROM events WHERE NOT (event_type = 'view' AND user_id % 7 = 3)),
o AS (SELECT model, label_id, avg(f1) AS v FROM c WHERE model IN ('view', 'click') GROUP BY ALL), l AS (SELECT label_id, row_number() OVER (ORDER BY label_id) - 1 AS col FROM (SELECT DISTINCT label_id FROM o)),
g AS (SELECT m.r AS "row", col::INT AS col, m.model, l.label_id, round(coalesce(v, 0), 6) AS value FROM l CROSS JOIN (VALUES (0, 'view'), (1, 'click'), (2, 'nobody')) m(r, model) LEFT JOIN o ON o.model = m.model AND o.label_id = l.label_id)
SELECT *, CASE WHEN value <= 0.2 OR value >= 0.75 THEN 'white' ELSE 'black' END AS ink FROM g""")
def figure_heatmap(s, d):
    """Classes of three models, one of which has no scores at all."""
    e = read_table(s, d, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 7).alias("label_id"), (F.col("value") / 400).alias("f1"))
    h = figures.heatmap(e.where("NOT (model = 'view' AND label_id = 3)"), ["view", "click", "nobody"]).withColumn("value", F.round("value", 6))
    return h.withColumn("ink", figures.shade(F.col("value")))


@query("figure_deltas", """WITH x AS (SELECT event_type AS model, 'c' || (user_id % 3) AS comparison, value - 50 AS delta FROM events WHERE NOT (event_type = 'view' AND user_id % 3 = 1)), n AS (SELECT model, comparison, avg(delta) AS v FROM x GROUP BY ALL),
k AS (SELECT comparison, row_number() OVER (ORDER BY comparison) - 1 AS k, count(*) OVER () AS w FROM (SELECT DISTINCT comparison FROM n))
SELECT m.model, k.comparison, round(coalesce(v, 0), 6) AS value, round((k - (w - 1) / 2) * 0.4, 6) AS "offset" FROM (SELECT DISTINCT model FROM n) m CROSS JOIN k LEFT JOIN n ON n.model = m.model AND n.comparison = k.comparison""")
def figure_deltas(s, d):
    x = read_table(s, d, "events").select(F.col("event_type").alias("model"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("comparison"), (F.col("value") - 50).alias("delta"))
    f = figures.delta_bars(x.where("NOT (model = 'view' AND comparison = 'c1')"))
    return f.withColumns({c: F.round(c, 6) for c in ("value", "offset")})
