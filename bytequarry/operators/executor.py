"""Running the runs of a matrix, with their states in a table that outlives the session.

Each change of a run's state is one appended row of a Parquet table, so nothing is ever
rewritten; a run's state is its last row. A session that is cut off leaves its run in state
``running``, which the next one takes as pending, so doing the rest gives the same table of
results as one session without a break. States are ``running``, ``completed``, ``unavailable`` (what
it needs is missing) and ``failed``.
"""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.operators.runs import resume, select_runs
from bytequarry.sources.io import exists

STATES = "run_id string, attempt int, status string, at timestamp, error string, trace string, summary string"


class Unavailable(Exception):
    """What a run needs is not there; it is not a failure of the run."""


def states(spark: SparkSession, store: str) -> DataFrame:
    """The last state of every run that has one: ``run_id, attempt, status, at, error, trace, summary``."""
    if not exists(spark, store):
        return spark.createDataFrame([], STATES)
    rows = spark.read.schema(STATES).parquet(store)
    place = F.struct("attempt", F.when(F.col("status") == "running", 0).otherwise(1))
    last = rows.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "run_id"]), place).alias("s"))
    return last.select("run_id", "s.*")


def execute(spark: SparkSession, store: str, matrix: DataFrame, run: Callable[[dict], dict], wanted: dict[str, list] | None = None, rerun_failed: bool = False, most: int | None = None, fail_fast: bool = False) -> dict[str, int]:
    """Does the runs of ``matrix`` (``run_id`` and what ``run`` needs) that are not done yet; how many ended in which state.

    ``run`` takes a run's row and returns its summary; its own work is Spark's. Failures are
    kept with their trace and the rest goes on, unless ``fail_fast``, which ends the session
    after the state is written. ``rerun_failed`` does failed and unavailable runs again.
    The matrix comes to the driver: one row a run.
    """
    before = states(spark, store)
    known = resume(matrix.withColumn("status", F.lit("pending")) if "status" not in matrix.columns else matrix, before)
    again = F.when(F.col("status") == "unavailable", "failed" if rerun_failed else "unavailable").otherwise(F.col("status"))
    todo = [r.asDict() for r in select_runs(known.withColumn("status", again), wanted, rerun_failed, most).orderBy("run_id").collect()]
    attempts = {r["run_id"]: r["attempt"] for r in before.select("run_id", "attempt").collect()}
    counts = {"completed": 0, "unavailable": 0, "failed": 0}

    def write(run_id: str, status: str, error: str = "", trace: str = "", summary: dict | None = None) -> None:
        row = (run_id, attempts.get(run_id, 0), status, datetime.now(timezone.utc).replace(tzinfo=None), error, trace, json.dumps(summary or {}, sort_keys=True))
        spark.createDataFrame([row], STATES).coalesce(1).write.mode("append").parquet(store)

    for r in todo:
        name = r["run_id"]
        attempts[name] = attempts.get(name, 0) + 1
        write(name, "running")
        try:
            summary = run({k: v for k, v in r.items() if k != "status"})
        except Unavailable as e:
            write(name, "unavailable", str(e))
            counts["unavailable"] += 1
        except Exception as e:  # the run's failure is its result
            write(name, "failed", f"{type(e).__name__}: {e}", traceback.format_exc())
            counts["failed"] += 1
            if fail_fast:
                raise
        else:
            write(name, "completed", summary=summary)
            counts["completed"] += 1
    return counts
