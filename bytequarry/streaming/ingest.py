"""Incremental ingest: new files of codes are fingerprinted, and only unseen fingerprints are added to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.functions import bytecode as B
from bytequarry.sources.io import exists


def fingerprinted(df: DataFrame, code: str = "code") -> DataFrame:
    h = B.normal(F.col(code))
    return df.withColumns({"code": h, "failure_mode": B.failure(F.col(code)), "fp": B.fingerprint(B.strip_metadata(h))})


def add_new(batch: DataFrame, table: str, batch_id: int = 0) -> None:
    """Adds the batch's fingerprints that ``table`` lacks, in a partition of its own.

    A batch that is run again replaces what it wrote before, so a restart in the middle of
    one neither loses nor repeats rows. Of the table, only fingerprints are read.
    """
    fresh = fingerprinted(batch).where("fp IS NOT NULL").select("fp", "code").dropDuplicates(["fp"])
    spark = batch.sparkSession
    if exists(spark, table):
        known = spark.read.parquet(table).where(F.col("batch") != batch_id).select("fp")
        fresh = fresh.join(known, "fp", "left_anti")
    fresh.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str):
    """A streaming query over Parquet files (``code``) in ``source``; runs through what is there and stops."""
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: add_new(df, table, i)).trigger(availableNow=True).start()
