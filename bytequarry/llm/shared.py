"""Lineage cuts in the folder that the whole cluster shares, and filters of ids."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each application's database for written steps, and the table behind each frame that :func:`cut` returned.
_databases: dict[str, str] = {}
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where none is set, a local session (one machine, as in tests) gets a temporary folder;
    on a cluster that is an error, as other machines would not see the files.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: name a folder there that all machines share")
    return tempfile.mkdtemp(prefix="bytequarry-")


def _database(spark: SparkSession) -> str:
    app = spark.conf.get("spark.app.id", "")
    if app not in _databases:
        name = f"bytequarry_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_dir(spark)}/{name}'")
        _databases[app] = name
    return _databases[app]


def cut(df: DataFrame, name: str = "cut", buckets: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    Later steps then restart from these files when an executor is lost, instead of
    computing everything again, and each step runs once however often it is used. With
    ``buckets``, rows are dealt to so many files by ``keys`` and sorted there.
    """
    spark = df.sparkSession
    table = f"{_database(spark)}.{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd")
    (writer.bucketBy(buckets, *keys).sortBy(*keys) if buckets else writer).saveAsTable(table)
    out = spark.table(table)
    _tables[out] = table
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that :func:`cut` returned and that nothing reads any more."""
    for df in frames:
        if table := _tables.pop(df, None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


def release(spark: SparkSession) -> None:
    """Deletes all tables that :func:`cut` wrote for this application, once its results are stored elsewhere."""
    if name := _databases.pop(spark.conf.get("spark.app.id", ""), None):
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def drop_shuffles(spark: SparkSession) -> None:
    """From now on, Spark deletes the shuffle files of each query when it ends.

    For operators of many queries over written tables: no later query reads those files.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: Bits of an id filter, whatever the input: 2 MB in blocks of 4 kB.
FILTER_BITS = 1 << 24


def filter_place(key: Column) -> Column:
    """An id's bit, from 1 on."""
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1


def id_filter(ids: DataFrame, key: str) -> DataFrame:
    """The bits of all ids as ``_block, _bits``: at most ``FILTER_BITS / 32768`` rows of 4 kB, so it may be broadcast."""
    p = ids.select(filter_place(F.col(key)).alias("p"))
    return p.groupBy(F.bitmap_bucket_number("p").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))


def suspects(df: DataFrame, key: str, ids: DataFrame, ids_key: str) -> tuple[DataFrame, DataFrame]:
    """``df``'s rows that are surely not among ``ids``, and the rest, which a join must decide.

    So only rows whose bit is set are shuffled. The more ids there are the more other rows
    share their bits; then more are joined, and the result stays the same.
    """
    p = filter_place(F.col(f"`{key}`"))
    at = F.bitmap_bit_position(p)
    # the caller's columns travel as one struct, so they may have any names
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.bitmap_bucket_number(p).alias("block"), at.alias("at"))
    tested = row.join(F.broadcast(cut(id_filter(ids, ids_key), "filter")), F.col("block") == F.col("_block"), "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    tested = tested.select("row", "at", byte.alias("byte")).select("row", F.coalesce(F.expr("shiftright(byte, cast(at % 8 AS int))").bitwiseAND(1) == 1, F.lit(False)).alias("hit"))
    return tested.where("NOT hit").select("row.*"), tested.where("hit").select("row.*")
