"""Votes, three-valued labels, harmonising two sources, class selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.functions.text import to_int


def label_of(yes: Column, no: Column) -> Column:
    """1 where only ``yes`` holds, 0 where only ``no`` does, else null."""
    return F.when(yes & ~no, 1).when(no & ~yes, 0)


def valid_votes(votes: DataFrame, low: int = 100, high: int = 136) -> DataFrame:
    """Votes t or f on classes in range; ``fp, swc_id, vote``."""
    if dict(votes.dtypes)["swc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        votes = votes.withColumn("swc_id", to_int(F.col("swc_id")).cast("int"))
    return votes.where(F.col("swc_id").between(low, high) & F.col("vote").isin("t", "f"))


def vote_pairs(votes: DataFrame) -> DataFrame:
    """One row per (fp, class): vote counts, conflict, tie and the majority's label (null on a tie)."""
    pairs = votes.groupBy("fp", "swc_id").agg(
        F.count_if(F.col("vote") == "t").alias("vote_true"), F.count_if(F.col("vote") == "f").alias("vote_false"), F.count("*").alias("n_votes")
    )
    t, f = F.col("vote_true"), F.col("vote_false")
    return pairs.withColumns({
        "has_conflict": (t > 0) & (f > 0), "is_tie": (t == f) & (F.col("n_votes") > 0), "label": F.when(t > f, 1).when(f > t, 0),
    })


#: Classes of a grid at most.
MOST_CLASSES = 1000


def label_grid(contracts: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every contract with every class; what nobody voted on is unassessed.

    Classes are a dimension of at most ``MOST_CLASSES`` ids, which is checked; they go along
    with each contract as one array, without a join.
    """
    ids = [r["swc_id"] for r in classes.select("swc_id").distinct().limit(MOST_CLASSES + 1).collect()]
    if len(ids) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    listed = F.array(*[F.lit(i) for i in sorted(ids)]).cast(f"array<{dict(classes.dtypes)['swc_id']}>")
    grid = contracts.withColumn("swc_id", F.explode(listed)).join(pairs, ["fp", "swc_id"], "left")
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("vote_true", "vote_false", "n_votes")}
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("has_conflict", "is_tie")}
    return grid.withColumns(filled | flags).withColumn("is_assessed", F.col("n_votes") > 0)


def balance(grid: DataFrame) -> DataFrame:
    """Counts of labels, conflicts and ties of each class."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    return grid.groupBy("swc_id").agg(
        F.count("*").alias("total"), n(F.col("is_assessed"), "assessed"), n(F.col("label") == 1, "positive"), n(F.col("label") == 0, "negative"),
        n(F.col("label").isNull(), "unknown"), n(F.col("has_conflict"), "conflicts"), n(F.col("is_tie"), "ties"),
    )


def evidence_labels(rows: DataFrame, negatives_allowed: bool) -> DataFrame:
    """Adds ``label`` from label, flags and counts that may be missing; a negative counts only where the policy allows it."""
    has = set(rows.columns)

    def any_of(value: int, flag: str, count: str) -> Column:
        out = F.lit(False)
        if "raw_label" in has:
            out = out | F.coalesce(F.col("raw_label") == value, F.lit(False))
        if flag in has:
            out = out | F.coalesce(F.col(flag), F.lit(False))
        if count in has:
            out = out | (F.coalesce(F.col(count), F.lit(0)) > 0)
        return out

    yes, no = any_of(1, "is_positive_evidence", "positive_findings"), any_of(0, "is_negative_evidence", "negative_findings")
    label = label_of(yes, no)
    return rows.withColumn("label", label if negatives_allowed else F.when(label == 1, 1))


def confidence(source: Column, label: Column) -> Column:
    return F.when(source == "cgt", "hard_cgt").when((source == "dappscan") & (label == 1), "pos_dappscan").when((source == "dappscan") & (label == 0), "explicit_neg_dappscan")


def harmonize(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sources' known labels in one long table with a confidence tag; rows without a fingerprint go."""
    both = a.select("fp", "swc_id", "label", F.lit("cgt").alias("source")).unionByName(b.select("fp", "swc_id", "label", F.lit("dappscan").alias("source")))
    return both.where("fp IS NOT NULL AND label IN (0, 1)").withColumn("label_confidence", confidence(F.col("source"), F.col("label")))


def disagreements(labels: DataFrame) -> DataFrame:
    """Rows of the (fp, class) pairs on which sources differ."""
    keys = labels.groupBy("fp", "swc_id").agg(F.count_distinct("label").alias("l"), F.count_distinct("source").alias("s")).where("l > 1 AND s > 1")
    return labels.join(keys.select("fp", "swc_id"), ["fp", "swc_id"], "left_semi")


def unique_map(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct value."""
    return pairs.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_top")).where(F.col(value) == F.col("_top")).drop("_top")


def two_tier_lookup(rows: DataFrame, exact: DataFrame, lower: DataFrame) -> DataFrame:
    """``fp`` for ``id``: by the id itself, else by ``low_id``; entries of the lower tier never replace exact ones."""
    known = unique_map(exact, "id", "fp")
    low = unique_map(lower, "id", "fp").join(known.select("id"), "id", "left_anti")
    table = known.unionByName(low)
    first = rows.join(table, "id", "left")
    return first.join(table.select(F.col("id").alias("low_id"), F.col("fp").alias("_low")), "low_id", "left").withColumn("fp", F.coalesce("fp", "_low")).drop("_low")


def decision(a_total: Column, b_total: Column, b_pos: Column, least: int = 20) -> Column:
    return F.when(a_total + b_total < least, "drop_low_count").when((a_total > 0) & (b_total == 0), "keep_cgt_only").when((a_total == 0) & (b_pos > 0), "keep_pu_only").otherwise("keep")


def decision_matrix(labels: DataFrame, classes: DataFrame, least: int = 20) -> DataFrame:
    """Known labels of each class by source, and what to do with the class."""
    n = lambda s, v: F.count_if((F.col("source") == s) & (F.col("label") == v))
    m = labels.groupBy("swc_id").agg(n("cgt", 1).alias("cgt_positive"), n("cgt", 0).alias("cgt_negative"), n("dappscan", 1).alias("dappscan_positive"), n("dappscan", 0).alias("dappscan_negative"))
    m = classes.join(m, "swc_id", "left").na.fill(0, ["cgt_positive", "cgt_negative", "dappscan_positive", "dappscan_negative"])
    m = m.withColumns({"cgt_known_total": F.col("cgt_positive") + F.col("cgt_negative"), "dappscan_known_total": F.col("dappscan_positive") + F.col("dappscan_negative")})
    return m.withColumns({
        "known_total": F.col("cgt_known_total") + F.col("dappscan_known_total"),
        "action": decision(F.col("cgt_known_total"), F.col("dappscan_known_total"), F.col("dappscan_positive"), least),
    })


#: Known labels of a split, and rows of the rarer class, from which a class enters the main benchmark.
MAIN_KNOWN, MAIN_MINORITY = 100, 10


def recommendations(matrix: DataFrame, split_counts: DataFrame) -> DataFrame:
    """``swc_id, recommendation, reason`` of each class from the decision matrix and its counts in the primary split.

    ``split_counts`` has ``swc_id, known, positive, negative``; classes without a row there have zeros.
    """
    j = matrix.join(split_counts, "swc_id", "left").na.fill(0, ["known", "positive", "negative"])
    drop = (F.col("action") == "drop_low_count") | (F.col("known_total") < 20)
    main = (F.col("known") >= MAIN_KNOWN) & (F.least("positive", "negative") >= MAIN_MINORITY)
    counts = F.format_string("(known=%d, positive=%d, negative=%d).", "known", "positive", "negative")
    what = F.when(drop, "drop_low_support").when(main, "keep_for_main_benchmark").otherwise("keep_for_auxiliary_only")
    why = F.when(drop, "Low known-label support after harmonization (below 20), unstable for benchmarking.").when(main, F.concat(F.lit("Strong primary support "), counts))
    return j.select("swc_id", what.alias("recommendation"), why.otherwise(F.concat(F.lit("Retained with limited/imbalanced primary evidence "), counts)).alias("reason"))


def source_label(rows: DataFrame) -> DataFrame:
    """Adds ``label`` from the first of ``property_holds``, ``property_holds_clean`` (t or f) and ``label`` (0 or 1) that the table has."""
    for name in ("property_holds", "property_holds_clean"):
        if name in rows.columns:
            v = F.lower(F.trim(F.col(name)))
            return rows.withColumn("label", F.when(v == "t", 1).when(v == "f", 0))
    if "label" not in rows.columns:
        raise ValueError("labels need property_holds, property_holds_clean or label")
    v = to_int(F.col("label").cast("string"))
    return rows.withColumn("label", F.when(v.isin(0, 1), v).cast("int"))


def pair_evidence(rows: DataFrame) -> DataFrame:
    """One row per (fp, class): whether any row says yes or no, the label where only one does, and the sorted set of sources."""
    g = rows.groupBy("fp", "swc_id").agg(F.bool_or(F.col("label") == 1).alias("yes"), F.bool_or(F.col("label") == 0).alias("no"), F.array_sort(F.collect_set("source")).alias("sources"))
    yes, no = F.coalesce("yes", F.lit(False)), F.coalesce("no", F.lit(False))
    return g.select("fp", "swc_id", yes.alias("positive"), no.alias("negative"), label_of(yes, no).alias("label"), "sources", F.size("sources").alias("n_sources"))


def wide_labels(labels: DataFrame, classes: list[int]) -> DataFrame:
    """One column per class in the given order; a pair with both labels is null, as is one with none."""
    known = labels.groupBy("fp", "swc_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).withColumn("label", F.when(F.col("lo") == F.col("hi"), F.col("lo")))
    wide = known.groupBy("fp").pivot("swc_id", classes).agg(F.first("label"))
    return wide.select("fp", *[F.col(str(c)).alias(f"swc_{c}") for c in classes])


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def markers(json: Column, keys: list[str], values: list[str]) -> Column:
    """Whether an object has one of the keys, or a value that is one of ``values`` in any case."""
    entries = F.map_entries(F.from_json(json, "map<string,string>"))
    return F.coalesce(F.exists(entries, lambda e: e["key"].isin(keys) | F.lower(F.coalesce(e["value"], F.lit(""))).isin(values)), F.lit(False))
