"""Runtime invariants as queries that return issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks; further columns are fine."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, or an error with the first repeated keys."""
    bad = df.groupBy(*keys).count().where("count > 1").limit(10).collect()
    if bad:
        raise ValueError(f"repeated keys: {[tuple(r)[:-1] for r in bad]}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join of two tables whose keys are unique; the row count stays."""
    return assert_unique(left, [key]).join(assert_unique(right, [key]), key, "left")


def _issue(df: DataFrame, relation: str, issue: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(relation).alias("relation"), F.lit(issue).alias("issue"), "n")


def duplicate_keys(df: DataFrame, relation: str, *keys: str) -> DataFrame:
    return _issue(df.groupBy(*keys).count().where("count > 1"), relation, "duplicate_key")


def missing_parent(df: DataFrame, relation: str, parent: DataFrame, key: str) -> DataFrame:
    return _issue(df.join(parent.select(key).distinct(), key, "left_anti"), relation, "missing_parent")


def null_values(df: DataFrame, relation: str, column: str) -> DataFrame:
    return _issue(df.where(F.col(column).isNull()), relation, f"null_{column}")


def overlapping_splits(df: DataFrame, relation: str, key: str, split: str = "split") -> DataFrame:
    return _issue(df.groupBy(key).agg(F.count_distinct(split).alias("k")).where("k > 1"), relation, "split_overlap")


def issues(found: list[DataFrame]) -> DataFrame:
    """All issues in one table; empty when every check holds."""
    return reduce(DataFrame.unionByName, found)


def preserved(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: rows of both tables, keys that only one of them has, repeated keys afterwards, and whether all is as it was."""
    n = before.groupBy(key).agg(F.count("*").alias("b")).join(after.groupBy(key).agg(F.count("*").alias("a")), key, "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = n.agg(total("b").alias("rows_before"), total("a").alias("rows_after"), F.count_if(F.col("a").isNull()).alias("lost"), F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a") > 1).alias("repeated"))
    return out.withColumn("ok", (F.col("rows_before") == F.col("rows_after")) & (F.col("lost") == 0) & (F.col("added") == 0) & (F.col("repeated") == 0))
