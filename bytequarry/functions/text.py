"""Scalar expressions over text and numbers, all built-in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Null becomes empty; white space of any kind is stripped at both ends."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(clean(c), F.lit(""))


def to_int(c: Column) -> Column:
    """Integer value of a number written in text, or null ("107.0" counts, "1.5" does not)."""
    d = clean(c).try_cast("double")
    return F.when(d == F.floor(d), d.try_cast("bigint"))


def contract_id(group: Column, name: Column) -> Column:
    """``group/name`` without slashes at the ends."""
    return F.regexp_replace(F.concat_ws("/", clean(group), clean(name)), "^/+|/+$", "")


def contract_name(key: Column, fallback: Column) -> Column:
    """What follows the last colon of a compiler key, or ``fallback``."""
    return F.coalesce(F.nullif(clean(F.substring_index(key, ":", -1)), F.lit("")), fallback)


def class_id(category: Column) -> Column:
    """The number in ``SWC-<number>``, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(category, F.lit("")), r"SWC-(\d+)", 1), F.lit("")).try_cast("int")


def drop_json_suffix(name: Column, stem: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(clean(name), r"(?i)\.json$", ""), F.lit("")), stem)


def slug(c: Column, default: str = "dataset") -> Column:
    s = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(s == "", default).otherwise(s)


def token(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_-]", "_")


def run_id(variant: Column, model: Column, seed: Column) -> Column:
    return F.format_string("%s__%s__seed%d", token(variant), token(model), seed)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def json_list(c: Column) -> Column:
    """A JSON list of strings, or an empty array where it cannot be read."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def sorted_set(c: Column) -> Column:
    """Aggregate: distinct non-blank values in order."""
    return F.array_sort(F.collect_set(blank_to_null(c)))


def first_filled(c: Column, order: Column) -> Column:
    """Aggregate: the first non-blank value in ``order``, or empty."""
    return F.coalesce(F.min_by(clean(c), F.when(clean(c) != "", order)), F.lit(""))


def age_seconds(stamp: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(stamp))
