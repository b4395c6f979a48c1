"""Profiles, fingerprint statistics, merging sources, splits and variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.functions.text import blank_to_null, first_filled, json_list, sorted_set
from bytequarry.operators.order import exact_quantiles
from bytequarry.operators.steps import dropped, written


def field_profile(df: DataFrame) -> DataFrame:
    """Type, filled, empty and distinct filled values of every column, in one pass over an unpivoted projection."""
    cols, types = df.columns, F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    long = df.select([F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "field", "v").withColumn("v", blank_to_null(F.col("v")))
    return long.groupBy("field").agg(F.count("v").alias("non_empty"), F.count_if(F.col("v").isNull()).alias("empty"), F.count_distinct("v").alias("unique_non_empty")).withColumn("dtype", F.element_at(types, F.col("field")))


def distribution(df: DataFrame, c: str) -> DataFrame:
    """Counts and percentages of a column's values, with a bucket for missing ones."""
    v = F.coalesce(blank_to_null(F.col(c)), F.lit("<MISSING>"))
    n = df.groupBy(v.alias("value")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(df.agg(F.count("*").alias("all")))).select("value", "n", F.round(F.col("n") * 100.0 / F.col("all"), 4).alias("pct"))


def length_stats(df: DataFrame, x: Column, *by: str) -> DataFrame:
    """Count, extremes, mean and exact quantiles of each group."""
    n = df.groupBy(*by).agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.avg(x), 4).alias("mean"))
    q = exact_quantiles(df, x, {"median": 0.5, "p95": 0.95, "p99": 0.99}, *by)
    same = F.expr(" AND ".join(f"n.`{c}` <=> q.`{c}`" for c in by) or "true")
    return n.alias("n").join(q.alias("q"), same, "left").select("n.*", *[F.round(f"q.{c}", 4).alias(c) for c in ("median", "p95", "p99")])


def histogram(df: DataFrame, x: Column, bins: int = 40) -> DataFrame:
    """Equal-width bins from least to largest value, the last one closed, empty ones included."""
    v = df.select(x.cast("double").alias("x")).where("x IS NOT NULL")
    edges = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    counted = v.join(F.broadcast(edges)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = v.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(edges))
    lo, step = F.col("lo"), (F.col("hi") - F.col("lo")) / bins
    return grid.join(counted, "bin", "left").select("bin", F.floor(lo + F.col("bin") * step).cast("long").alias("left"), F.floor(lo + (F.col("bin") + 1) * step).cast("long").alias("right"), F.coalesce("n", F.lit(0)).alias("n"))


def failure_summary(df: DataFrame, group: str) -> DataFrame:
    """Successes, failures and the most frequent failure (ties: first in order) of each group."""
    modes = df.where("failure_mode <> ''").groupBy(group, "failure_mode").agg(F.count("*").alias("c"))
    top = modes.groupBy(group).agg(F.min_by("failure_mode", F.struct(-F.col("c"), F.col("failure_mode"))).alias("top_failure"))
    n = df.groupBy(group).agg(F.count("*").alias("processed"), F.count_if(F.col("failure_mode") == "").alias("succeeded"))
    out = n.join(top, group, "left")
    return out.withColumns({"failed": F.col("processed") - F.col("succeeded"), "success_rate": F.round(F.col("succeeded") / F.col("processed"), 6), "top_failure": F.coalesce("top_failure", F.lit(""))})


def collisions(df: DataFrame) -> DataFrame:
    """Duplicates by fingerprint: rows in groups of more than one, such groups, and fingerprints with several bodies."""
    g = df.where("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("n"), F.count_distinct("body").alias("bodies"))
    return g.agg(F.count("*").alias("unique_fps"), F.count_if(F.col("n") > 1).alias("dup_groups"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rows_in_dups"), F.count_if(F.col("bodies") > 1).alias("conflicting_fps"))


def source_aggregate(df: DataFrame, order: Column) -> DataFrame:
    """One row per fingerprint: names in order, first body, largest sizes, any flags."""
    return df.where("fp IS NOT NULL").groupBy("fp").agg(
        sorted_set(F.col("name")).alias("names"), first_filled(F.col("body"), order).alias("body"), F.coalesce(F.max("size"), F.lit(0)).alias("size"),
        F.coalesce(F.bool_or("flag"), F.lit(False)).alias("flag"), F.count("*").alias("rows"),
    )


def merge_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two source aggregates with provenance; the first source's body is preferred."""
    side = lambda d, p: d.select("fp", *[F.col(c).alias(f"{p}_{c}") for c in ("names", "body", "size", "flag", "rows")])
    j = side(a, "a").join(side(b, "b"), "fp", "full")
    empty = F.array().cast("array<string>")
    return j.select(
        "fp",
        F.array_compact(F.array(F.when(F.col("a_rows").isNotNull(), "a"), F.when(F.col("b_rows").isNotNull(), "b"))).alias("sources"),
        F.coalesce(blank_to_null(F.col("a_body")), blank_to_null(F.col("b_body")), F.lit("")).alias("body"),
        F.greatest(F.coalesce("a_size", F.lit(0)), F.coalesce("b_size", F.lit(0))).alias("size"),
        (F.coalesce("a_flag", F.lit(False)) | F.coalesce("b_flag", F.lit(False))).alias("flag"),
        F.coalesce("a_names", empty).alias("a_names"), F.coalesce("b_names", empty).alias("b_names"),
        (F.coalesce("a_rows", F.lit(0)) + F.coalesce("b_rows", F.lit(0))).alias("rows"),
    )


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sizes of intersection, union and differences, and the share of a that b covers."""
    j = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    n = j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count("*").alias("either"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
    return n.withColumn("coverage", F.round(F.when(F.col("both") + F.col("only_a") > 0, F.col("both") / (F.col("both") + F.col("only_a"))).otherwise(0.0), 6))


def source_group(a: Column, b: Column) -> Column:
    return F.when(a & b, "both").when(a, "cgt_only").when(b, "dappscan_only").otherwise("unknown")


def split_label_stats(labels: DataFrame, splits: DataFrame) -> DataFrame:
    """Known, positive and negative labels of each class in each split and (split ``all``) over them."""
    j = labels.join(splits, "fp")
    g = j.rollup("swc_id", "split").agg(F.count("label").alias("known"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"), F.grouping_id().alias("g"))
    return g.where("g <= 1").select("swc_id", F.when(F.col("g") == 1, "all").otherwise(F.col("split")).alias("split"), "known", "positive", "negative")


def hash_split(c: Column, buckets: int = 10) -> Column:
    """train, val or test (8:1:1) by a hash of the id."""
    h = F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 4), 16, 10).cast("int") % buckets
    return F.when(h < buckets - 2, "train").when(h == buckets - 2, "val").otherwise("test")


def leave_one_out(members: DataFrame, held: str) -> DataFrame:
    """Ids of one dataset as test, ids in no held dataset as train; an id of both is test."""
    test = members.where(F.col("dataset") == held).select("id").distinct()
    train = members.select("id").distinct().join(test, "id", "left_anti")
    return test.withColumn("part", F.lit("test")).unionByName(train.withColumn("part", F.lit("train")))


def variants(index: DataFrame) -> DataFrame:
    """Contracts of each variant by split, as counts."""
    rules = {"clean_default": "NOT is_stub", "no_proxy": "NOT is_stub AND NOT is_proxy", "cgt_only": "NOT is_stub AND has_a", "combined_posaug": "NOT is_stub AND (has_a OR has_positive)"}
    names = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()]))
    return index.select("split", F.explode(names).alias("variant")).groupBy("variant", "split").agg(F.count("*").alias("n"))


def set_difference(a: DataFrame, b: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The first few keys on one side only, from either side: empty when both sets are equal."""
    one = lambda x, y, name: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").orderBy(key).limit(limit).withColumn("side", F.lit(name))
    return one(a, b, "left_only").unionByName(one(b, a, "right_only"))


def stable_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A deterministic sample of ``n`` rows, the feature itself being a bound."""
    return df.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def instruction_status(rows: DataFrame) -> DataFrame:
    """``fp, parsed, failure_mode``: whether any of a contract's rows was parsed, and its first failure that is filled.

    ``rows`` has ``row`` (the order), ``parse_success`` and ``failure_mode``; rows without an id go.
    """
    known = rows.withColumn("fp", blank_to_null(F.col("fp").cast("string"))).where("fp IS NOT NULL")
    return known.groupBy("fp").agg(F.bool_or(F.coalesce("parse_success", F.lit(False))).alias("parsed"), F.coalesce(first_filled(F.col("failure_mode"), F.col("row")), F.lit("")).alias("failure_mode"))


def with_status(contracts: DataFrame, status: DataFrame) -> DataFrame:
    """Contracts with their instruction status; those without rows failed for that reason."""
    j = contracts.join(status, "fp", "left")
    return j.withColumns({"parsed": F.coalesce("parsed", F.lit(False)), "failure_mode": F.coalesce("failure_mode", F.lit("missing_instruction_rows"))})


def key_counts(json: DataFrame, column: str = "json", depth: int | None = None) -> DataFrame:
    """``level, key, n``: how often each key stands in JSON objects and in those nested in them or in their lists, at any depth.

    Each level's values are written before the next is read from them, until no object is
    left; a value is shorter than the text that it stands in, so that comes to pass. ``depth``
    stops earlier.
    """
    inner = F.coalesce(F.from_json("value", "array<string>"), F.array("value"))
    objects = lambda df: df.where(F.col("value").rlike(r"^\s*[\[{]"))
    level, out, k = json.select(F.col(column).alias("value")), [], 0
    while depth is None or k < depth:
        # lists in lists come apart one by one
        found = written(objects(level), "json_level")
        while not (lists := found.where(F.col("value").rlike(r"^\s*\["))).isEmpty():
            apart = written(found.where(~F.col("value").rlike(r"^\s*\[")).unionByName(objects(lists.select(F.explode(inner).alias("value")))), "json_level")
            dropped(found)
            found = apart
        entries = found.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
        n = written(entries.groupBy("key").agg(F.count("*").alias("n")).select(F.lit(k).alias("level"), "key", "n"), "json_keys")
        level, k = written(objects(entries).select("value"), "json_level"), k + 1
        dropped(found)
        out.append(n)
        if n.isEmpty():
            break
    dropped(level)
    return reduce(DataFrame.unionByName, out)


def failure_rates(df: DataFrame, group: str, top: int = 20) -> DataFrame:
    """The most frequent failure modes of each group, with their share of the group's rows and of its failures."""
    n = df.groupBy(group, "failure_mode").agg(F.count("*").alias("n"))
    total = n.groupBy(group).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("failure_mode") != "", F.col("n")).otherwise(0)).alias("failed"))
    # one row for each failure mode of a group
    best = n.where("failure_mode <> ''").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "failure_mode"))).where(F.col("rank") <= top)
    return best.join(total, group).select(group, "failure_mode", "n", (F.col("n") / F.col("rows")).alias("rate_of_rows"), (F.col("n") / F.col("failed")).alias("rate_of_failures"))


def member_datasets(contracts: DataFrame, datasets: DataFrame) -> DataFrame:
    """``fp, dataset``: the datasets of the ids in each contract's JSON list (``fp, ids``), each once; ids without one have none."""
    ids = contracts.select("fp", F.explode(json_list(F.col("ids"))).alias("id")).select("fp", F.trim("id").alias("id")).where("id <> ''").distinct()
    return ids.join(datasets.select(F.col("id").cast("string").alias("id"), "dataset"), "id").where("trim(coalesce(dataset, '')) <> ''").select("fp", "dataset").distinct()
