"""Spark session helpers shared by tests, the benchmark and ad-hoc use."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, partitions: int = 8, app: str = "bytequarry") -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes up to which a table is broadcast unasked in operators of many steps.
SMALL = 64 << 10


@contextmanager
def few_broadcasts(spark: SparkSession, limit: int = SMALL) -> Iterator[None]:
    """Within it, Spark broadcasts unasked only tables of ``limit`` bytes (-1: none); those that code asks for go on.

    Spark takes a written table's size from its files, which hold ids many times smaller than
    the driver does, and an operator of many steps leaves a broadcast behind in each. So
    what the driver holds would grow with the input.
    """
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    with _set(spark, {k: str(limit) for k in limits if spark.conf.get(k, None) != "-1"}):
        yield


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """Within it, Spark hands rows to Python in batches of about ``limit`` bytes, or of one row that is larger.

    Spark's own limit is 64 MB, and a batch is there several times over: as the task's Arrow
    buffers, in the buffer that it is sent from, and in the worker as Arrow and as objects.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    with _set(spark, {key: f"{limit}b"}):
        yield


@contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables, whatever store ``sf_dir`` is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
