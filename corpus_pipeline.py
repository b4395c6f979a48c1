"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes the documents that the one before it kept and returns documents with
the same columns; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bytequarry.llm import mixing, ngram_join, packing, quality_rules, secret_scan
from bytequarry.llm.shared import cut, suspects


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass every quality rule; null and empty texts fail the length rule.

    Texts are judged whole, however long; repeated rows are judged each; columns may have any names.
    """
    return quality_rules.apply_rules(docs)


#: Ids from here on are given to further texts of an id; ids of documents are below.
FURTHER = 1 << 62


def one_text_an_id(docs: DataFrame) -> DataFrame:
    """``id, text, row`` (all columns) of every document, where rows with equal ids have equal texts.

    Of an id's texts the one of least hash keeps the id, each other one gets an id of its own
    from ``FURTHER`` on; ids that are null stay so.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    work = docs.select(F.col("doc_id").alias("id"), "text", whole.alias("row"))
    prints = work.where("id IS NOT NULL").select("id", F.xxhash64("text").alias("p")).groupBy("id").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    several = cut(prints.where("first <> last").select(F.col("id").alias("sid"), "first"), "texts-of-an-id")
    if several.isEmpty():
        return work
    sure, maybe = suspects(work, "id", several, "sid")
    own = F.coalesce(F.xxhash64("text") == F.col("first"), F.lit(True))
    met = maybe.join(several.hint("merge"), F.col("id") == F.col("sid"), "left")
    return sure.unionByName(met.select(F.when(own, F.col("id")).otherwise(F.lit(FURTHER) + F.pmod(F.xxhash64("id", "text"), F.lit(FURTHER))).alias("id"), "text", "row"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, and of rows with one id and text, one.

    Different texts of one id are different documents: they are compared like others. Documents
    without an id, without text or without words are in no group and stay. Texts are
    compared whole, however long; columns may have any names.
    """
    work = one_text_an_id(docs)
    groups = cut(ngram_join.near_duplicates(work.select("id", "text"), "id"), "groups").where("doc_id IS NOT NULL")
    odd = groups.groupBy("doc_id").agg(F.bool_or(F.col("component_id") != F.col("doc_id")).alias("gone"), F.count("*").alias("n")).where("gone OR n > 1")
    odd = cut(odd.withColumnRenamed("doc_id", "oid"), "odd-ids")
    sure, maybe = suspects(work.select("id", "row"), "id", odd, "oid")
    place = F.row_number().over(Window.partitionBy("id").orderBy("hash"))
    met = maybe.withColumn("hash", F.xxhash64("row")).join(odd.hint("merge"), F.col("id") == F.col("oid"), "left")
    kept = met.where("NOT coalesce(gone, false)").withColumn("place", place).where("place = 1 OR n IS NULL")
    return sure.select("row.*").unionByName(kept.select("row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found replaced by a mark and ``n_chars`` counted anew where the text changed.

    Null texts stay null; columns may have any names.
    """
    before = "chars before"
    while before in docs.columns:
        before += " "
    clean = secret_scan.redact(docs.withColumn(before, F.length("text")))
    n = F.when(F.length("text") != F.col(f"`{before}`"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, each as often as it was drawn.

    Null and empty texts have no words and are not drawn; rows of equal size and id are told
    apart by their text, and repeated rows count each; columns may have any names.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens.

    A null text counts as empty; repeated rows are packed each; texts longer than a sequence
    become several pieces.
    """
    return packing.pack(docs, **packing.default_vocabulary())


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Set similarity and tokenisation are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
