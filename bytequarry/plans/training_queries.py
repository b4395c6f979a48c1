"""Queries over training: early stopping, schedules, pruned trials, leaf-wise boosting and a search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bytequarry.operators import learn, steps, training
from bytequarry.operators.metrics import per_label
from bytequarry.plans import proxies as P
from bytequarry.plans.registry import query
from bytequarry.session import read_table

#: Each user's events as a run that is evaluated every 50 steps.
_SCORES = "scores AS (SELECT user_id AS run, 50 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, value AS score FROM events)"
_EVALUATED = f"""{_SCORES}, e1 AS (SELECT *, coalesce(score > max(score) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM scores),
e2 AS (SELECT *, sum(improved::INT) OVER (PARTITION BY run ORDER BY step) AS r FROM e1),
e3 AS (SELECT *, row_number() OVER (PARTITION BY run, r ORDER BY step) - 1 AS waited FROM e2),
e4 AS (SELECT *, step <= coalesce(min(step) FILTER (WHERE waited >= 15) OVER (PARTITION BY run), step) AS seen FROM e3),
ev AS (SELECT *, step <= max(step) FILTER (WHERE seen AND improved) OVER (PARTITION BY run) AS kept FROM e4)"""


def _scores(s, d):
    step = 50 * F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return read_table(s, d, "events").select(F.col("user_id").alias("run"), step.cast("long").alias("step"), F.col("value").alias("score"))


@query("kept_evaluations", f"WITH {_EVALUATED} SELECT run, step, round(score, 6) AS score, improved, waited::INT AS waited, seen, kept FROM ev")
def kept_evaluations(s, d):
    """Every evaluation, whether training comes that far, and whether the model that is kept has seen it."""
    return training.evaluations(_scores(s, d), 15).withColumn("score", F.round("score", 6))


@query("stopped_runs", f"WITH {_EVALUATED} SELECT run, count(*) FILTER (WHERE seen) AS evaluations, max(step) FILTER (WHERE seen) AS last_step, bool_or(seen AND waited >= 15) AS stopped_early, max(step) FILTER (WHERE seen AND improved) AS best_step, round(arg_max(score, step) FILTER (WHERE seen AND improved), 6) AS best_score FROM ev GROUP BY run")
def stopped_runs(s, d):
    return training.stopped_runs(_scores(s, d), 15).withColumn("best_score", F.round("best_score", 6))


@query("rate_schedule", f"WITH {_SCORES} SELECT run, step, round(0.000001 + (0.001 - 0.000001) * (1 + cos(pi() * step / 5000)) / 2, 10) AS rate FROM scores")
def rate_schedule(s, d):
    """The learning rate at each evaluation, for 5000 steps."""
    return _scores(s, d).select("run", "step", F.round(training.cosine_rate(F.col("step"), 5000, 1e-3), 10).alias("rate"))


#: Reports of trials (users) of five studies, at every 50 steps.
_REPORTS = "rp AS MATERIALIZED (SELECT user_id % 5 AS study, user_id AS trial, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value FROM events)"


@query("pruned_trials", f"""WITH RECURSIVE {_REPORTS}, rb AS MATERIALIZED (SELECT *, max(value) OVER (PARTITION BY study, trial ORDER BY k) AS best FROM rp),
al AS (
  SELECT study, trial, k, NULL::BIGINT AS ended_at FROM rb WHERE k = 1
  UNION ALL
  SELECT m.study, m.trial, m.k + 1, CASE WHEN m.k >= 4 AND n >= 5 AND best < middle THEN 50 * m.k END
  FROM (SELECT rb.*, median(value) OVER (PARTITION BY study) AS middle, count(*) OVER (PARTITION BY study) AS n FROM al JOIN rb USING (study, trial, k) WHERE ended_at IS NULL) m)
SELECT study, trial, max(ended_at) AS ended_at FROM al GROUP BY study, trial""")
def pruned_trials(s, d):
    """Where each trial is given up for falling behind the median of its study."""
    x = _scores(s, d).select((F.col("run") % 5).alias("study"), F.col("run").alias("trial"), "step", F.col("score").alias("value"))
    return training.pruned_trials(x, startup=5, warmup=200)


@query("ovr_leafwise")
def ovr_leafwise(s, d):
    """Class probabilities of leaf-wise boosting with early stopping, over simple text features."""
    return learn.one_vs_rest(learn.text_features(read_table(s, d, "documents")), P.predictions(s, d), "leafwise")


@query("searched_logistic")
def searched_logistic(s, d):
    """Six settings of a logistic model in cohorts of three, with more and more iterations, by macro F1 on a fifth of the labelled documents."""
    p = P.predictions(s, d).where("target IS NOT NULL")
    x = steps.written(learn.text_features(read_table(s, d, "documents")), "features")
    train, val = p.where("fold <> 0"), p.where("fold = 0").select("id", "label_id", "target")

    def score(setting: dict, iterations: int) -> float:
        scored = learn.one_vs_rest(x, train, "logistic", maxIter=iterations, **setting).join(val, ["id", "label_id"])
        return per_label(scored, F.lit(0.5)).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f")).first()["f"]

    space = {"regParam": ("log", 1e-4, 1.0), "elasticNetParam": ("float", 0.0, 1.0)}
    return training.search(s, steps.path(s, "search"), space, score, [2, 8], trials=6, cohort=3, startup=3)
