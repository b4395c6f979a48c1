"""Mixing sources to target weights by systematic sampling.

Within a source every document expects ``target / source size`` copies. Documents are
ranked within their source; the running sum of expected copies plus one random offset
per source crosses some integer boundaries, and a document is emitted once for each
boundary that falls into its stretch. A document's copies are therefore its expected
copies rounded down or up, and with documents ordered by size class the words taken
come within a document or so of the target.

No task sees a whole source: documents are ranked inside (source, size class, id
bucket) groups, and a table of group counts supplies each group's start. Buckets are
hashes of ids, and their number grows with the corpus, so a group stays small.

Defined cases: a null text has size 0 and takes nothing; null sources form a source of
their own, last in order; null ids are ordered first; repeated rows are separate
documents; texts are counted whole whatever their length; an empty table gives an empty
result; :func:`mix` keeps input columns of any names, and :func:`copies` replaces those
whose names start with ``_m_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Id buckets per source and size class: ``BUCKETS``, or one for each ``BUCKET_ROWS`` rows of the corpus if that is more.
BUCKETS, BUCKET_ROWS = 64, 1_000_000
#: Size classes: the length of the size in binary and its leading three digits.
SIZE_CLASS = "CASE WHEN {0} > 0 THEN 8 * length(bin({0})) + cast(shiftright({0}, greatest(length(bin({0})) - 3, 0)) AS int) ELSE 0 END"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds ``target`` to a table of ``_m_src, _m_null, source_size``.

    Weighted shares of ``share`` times all sizes, where no source exceeds ``cap`` times
    its size: with sources in order of cap per weight, the first one whose share of what
    the earlier caps leave fits below its cap fixes the level for all later ones. The
    windows without a partition run over one row per source.
    """
    by_name = Window.orderBy("_m_null", "_m_src")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights))
    df = sources.withColumns({"_m_w": w, "_m_cap": F.lit(cap) * F.col("source_size"), "_m_all": F.lit(share) * F.sum("source_size").over(Window.partitionBy())})
    order = Window.orderBy(F.col("_m_cap") / F.col("_m_w"), "_m_null", "_m_src")
    before = F.coalesce(F.sum("_m_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_m_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_m_level", (F.col("_m_all") - before) / rest).withColumn("_m_rank", F.row_number().over(order))
    level = F.min_by("_m_level", F.when(F.col("_m_level") * F.col("_m_w") <= F.col("_m_cap"), F.col("_m_rank"))).over(Window.partitionBy())
    return df.withColumn("target", F.coalesce(F.least("_m_cap", level * F.col("_m_w")), F.col("_m_cap"))).drop("_m_cap", "_m_all", "_m_level", "_m_rank")


def copies(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """``df`` with ``_m_size``, ``_m_source_size``, ``_m_target`` and ``_m_copies`` (0 to ``ceil(cap)``)."""
    buckets = max(BUCKETS, -(-df.count() // BUCKET_ROWS))
    hashed = F.conv(F.substring(F.md5(F.col(doc_id).cast("string")), 1, 8), 16, 10).cast("long")
    sized = df.withColumns({
        "_m_size": word_count(F.col(text)),
        "_m_src": F.coalesce(F.col(source), F.lit("")),
        "_m_null": F.col(source).isNull().cast("int"),
        "_m_bucket": F.coalesce(hashed % buckets, F.lit(0)).cast("int"),
    })
    sized = sized.withColumn("_m_class", F.expr(SIZE_CLASS.format("_m_size")))
    group = ["_m_src", "_m_null", "_m_class", "_m_bucket"]
    groups = cut(sized.groupBy(*group).agg(F.count("*").alias("_m_n"), F.sum("_m_size").alias("_m_sum")), "mix-groups")
    per_source = targets(groups.groupBy("_m_src", "_m_null").agg(F.sum("_m_sum").alias("source_size")), weights, share, cap)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_m_null").cast("string"), F.lit("|"), F.col("_m_src"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    per_source = per_source.select(
        "_m_src", "_m_null", F.col("source_size").alias("_m_source_size"), F.col("target").alias("_m_target"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_m_rate"), draw.alias("_m_draw"),
    )
    before = Window.partitionBy("_m_src", "_m_null").orderBy("_m_class", "_m_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("_m_start", F.coalesce(F.sum("_m_n").over(before), F.lit(0))).select(*group, "_m_start")
    starts = starts.join(per_source, ["_m_src", "_m_null"])
    within = Window.partitionBy(*group).orderBy("_m_size", F.col(doc_id).asc_nulls_first(), F.xxhash64(text))
    ranked = sized.withColumn("_m_k", F.row_number().over(within)).join(starts, group)
    k = F.col("_m_start") + F.col("_m_k")
    upto = lambda k: F.floor(k * F.col("_m_rate") + F.col("_m_draw"))
    return ranked.withColumn("_m_copies", upto(k) - upto(k - 1)).drop(*group, "_m_start", "_m_k", "_m_rate", "_m_draw")


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: ``df``'s rows and columns, each row as often as it was drawn."""
    at = lambda c: F.col(f"`{c}`")
    # the row travels as one struct, so its columns may have any names
    rows = df.select(F.struct(*map(at, df.columns)).alias("row"), at(text).alias("text"), at(source).alias("source"), at(doc_id).alias("doc_id"))
    drawn = copies(rows, **options).where("_m_copies > 0")
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m_copies")))).select("row.*")
