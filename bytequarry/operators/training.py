"""Training as tables: when to stop, how fast to learn, which trials to give up, what to try next."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytequarry.sources.io import exists


def evaluations(scores: DataFrame, patience: int, largest: bool = True) -> DataFrame:
    """``scores`` (``run, step, score``) with ``improved, waited, seen, kept``.

    A score improves on the run's best so far (the first always does; NaN never does, and
    nothing improves on a first NaN). ``waited`` counts evaluations since the last
    improvement; the run ends with the first that has waited ``patience`` times, ``seen`` up to
    that one. ``kept`` are the evaluations up to the best one seen, whose state is restored.
    A run's evaluations are ordered in one task: their number is that of its checkpoints.
    """
    order = Window.partitionBy("run").orderBy("step")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    score = F.when(~F.isnan("score"), F.col("score") if largest else -F.col("score"))
    first = F.row_number().over(order) == 1
    better = score > F.max(score).over(before)
    improved = first | F.coalesce(better, F.lit(False)) & ~F.coalesce(F.first("bad").over(before), F.lit(False))
    x = scores.withColumn("bad", F.isnan("score")).withColumn("improved", improved)
    since = Window.partitionBy("run", "round").orderBy("step")
    x = x.withColumn("round", F.sum(F.col("improved").cast("int")).over(order)).withColumn("waited", F.row_number().over(since) - 1)
    end = F.min(F.when(F.col("waited") >= patience, F.col("step"))).over(Window.partitionBy("run"))
    x = x.withColumn("seen", F.col("step") <= F.coalesce(end, F.col("step")))
    best = F.max(F.when(F.col("seen") & F.col("improved"), F.col("step"))).over(Window.partitionBy("run"))
    return x.withColumn("kept", F.col("step") <= best).select("run", "step", "score", "improved", "waited", "seen", "kept")


def stopped_runs(scores: DataFrame, patience: int, largest: bool = True) -> DataFrame:
    """``run, evaluations, last_step, stopped_early, best_step, best_score`` of each run under early stopping."""
    x = evaluations(scores, patience, largest)
    best = F.max(F.when(F.col("seen") & F.col("improved"), F.struct("step", "score")))
    out = x.groupBy("run").agg(F.count_if("seen").alias("evaluations"), F.max(F.when(F.col("seen"), F.col("step"))).alias("last_step"), F.bool_or(F.col("seen") & (F.col("waited") >= patience)).alias("stopped_early"), best.alias("b"))
    return out.select("run", "evaluations", "last_step", "stopped_early", F.col("b.step").alias("best_step"), F.col("b.score").alias("best_score"))


def cosine_rate(step: Column, steps: int, rate: float, least: float = 1e-6) -> Column:
    """The learning rate after ``step`` of ``steps``: half a cosine from ``rate`` down to ``least``."""
    return least + (rate - least) * (1 + F.cos(math.pi * step / steps)) / 2


def survivors(reports: list[tuple[int, int, float]], startup: int, warmup: int) -> dict[int, int | None]:
    """For each trial the step at which it is given up, or None, from (trial, step, value).

    At each step from ``warmup`` on, the trials that have come that far and are still in
    are compared if there are at least ``startup``: those whose best value so far is below
    the median of all values at that step are given up there. Missing values count as the
    worst.
    """
    low = float("-inf")
    by_step: dict[int, dict[int, float]] = {}
    for trial, step, value in reports:
        by_step.setdefault(step, {})[trial] = low if value is None or value != value else value
    ended: dict[int, int | None] = {t: None for t, _, _ in reports}
    best: dict[int, float] = {}
    for step in sorted(by_step):
        here = {t: v for t, v in by_step[step].items() if ended[t] is None}
        for t, v in here.items():
            best[t] = max(best.get(t, low), v)
        if step >= warmup and len(here) >= startup:
            middle = median(here.values())
            for t in here:
                if best[t] < middle:
                    ended[t] = step
    return ended


def pruned_trials(reports: DataFrame, startup: int = 5, warmup: int = 200) -> DataFrame:
    """``study, trial, ended_at`` (null for trials that go on) from ``study, trial, step, value``, see :func:`survivors`.

    A study is one group: its rows are its trials times its steps, both parameters of a search.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ended = survivors(list(zip(pdf["trial"].tolist(), pdf["step"].tolist(), pdf["value"].tolist(), strict=True)), startup, warmup)
        return pd.DataFrame({"study": [pdf["study"].iloc[0]] * len(ended), "trial": list(ended), "ended_at": pd.array(list(ended.values()), dtype="Int64")})

    kind = {f.name: f.dataType.simpleString() for f in reports.schema}
    rows = reports.select("study", "trial", "step", F.col("value").cast("double").alias("value"))
    return rows.groupBy("study").applyInPandas(run, f"study {kind['study']}, trial {kind['trial']}, ended_at long")


#: What a search may vary: ("float", low, high), ("log", low, high), ("int", low, high) or ("choice", values).
Space = dict[str, tuple]


def _draw(kind: tuple, rng: random.Random):
    if kind[0] == "choice":
        return rng.choice(kind[1])
    if kind[0] == "int":
        return rng.randint(kind[1], kind[2])
    return math.exp(rng.uniform(math.log(kind[1]), math.log(kind[2]))) if kind[0] == "log" else rng.uniform(kind[1], kind[2])


def _density(kind: tuple, seen: list, x) -> float:
    """Log density at ``x`` of a mixture around the values seen, and the whole range once."""
    if kind[0] == "choice":
        return math.log((seen.count(x) + 1) / (len(seen) + len(kind[1])))
    place = math.log if kind[0] == "log" else float
    low, high = place(kind[1]), place(kind[2])
    width = (high - low or 1.0) / max(1.0, math.sqrt(len(seen)))
    parts = [math.exp(-(((place(x) - place(v)) / width) ** 2) / 2) / (width * math.sqrt(2 * math.pi)) for v in seen]
    return math.log((sum(parts) + 1 / (high - low or 1.0)) / (len(seen) + 1))


def propose(space: Space, done: list[tuple[dict, float]], rng: random.Random, least: int = 5, tries: int = 24) -> dict:
    """The next setting: by chance for the first ``least`` ones, then of ``tries`` draws the one that is likeliest under the best quarter of all settings against the rest."""
    drawn = [{name: _draw(kind, rng) for name, kind in space.items()} for _ in range(tries)]
    if len(done) < least:
        return drawn[0]
    ranked = sorted(done, key=lambda x: -x[1])
    cut = max(1, len(ranked) // 4)
    good, bad = [s for s, _ in ranked[:cut]], [s for s, _ in ranked[cut:]]
    ratio = lambda s: sum(_density(kind, [g[name] for g in good], s[name]) - _density(kind, [b[name] for b in bad], s[name]) for name, kind in space.items())
    return max(drawn, key=ratio)


TRIALS = "trial long, setting string, step long, value double"


def search(spark: SparkSession, store: str, space: Space, objective: Callable[[dict, int], float], steps: list[int], trials: int, cohort: int = 4, startup: int = 4, warmup: int = 0, seed: int = 0) -> DataFrame:
    """``trial, setting, step, value`` of all trials, in a Parquet table at ``store`` that grows as they go on.

    Trials are proposed in cohorts; at each step those of a cohort that are still in are
    evaluated (``objective(setting, step)``), and those that fall behind all trials recorded
    are given up. What the table has already is not evaluated again, so a search that was
    cut off goes on where it was. The table has trials times steps rows at most.
    """
    recorded: dict[tuple[int, int], float] = {}
    settings: dict[int, dict] = {}
    if exists(spark, store):
        for r in spark.read.schema(TRIALS).parquet(store).collect():
            recorded[r["trial"], r["step"]] = r["value"]
            settings[r["trial"]] = json.loads(r["setting"])
    for first in range(0, trials, cohort):
        members = range(first, min(first + cohort, trials))
        done = [(settings[t], max(v for (k, _), v in recorded.items() if k == t)) for t in sorted(settings) if t < first]
        for t in members:  # a trial's own seed, so that a search that goes on proposes the same
            settings.setdefault(t, propose(space, done, random.Random(f"{seed}/{t}")))
        for step in steps:
            ended = survivors([(t, s, v) for (t, s), v in recorded.items()], startup, warmup)
            for t in members:
                if ended.get(t) is None and (t, step) not in recorded:
                    recorded[t, step] = float(objective(settings[t], step))
                    row = [(t, json.dumps(settings[t], sort_keys=True), step, recorded[t, step])]
                    spark.createDataFrame(row, TRIALS).coalesce(1).write.mode("append").parquet(store)
    return spark.read.schema(TRIALS).parquet(store).dropDuplicates(["trial", "step"])
