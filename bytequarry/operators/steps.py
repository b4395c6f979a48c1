"""Written steps: cutting lineage in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Each application's database of steps, and the table behind each frame that :func:`written` returned.
_databases: dict[str, str] = {}
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where none is set, a temporary folder for a local session and an error on a cluster."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: name a folder there that all machines share")
    return tempfile.mkdtemp(prefix="bytequarry-")


def _new_table(spark: SparkSession, name: str) -> str:
    app = spark.conf.get("spark.app.id", "")
    if app not in _databases:
        database = f"bytequarry_steps_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {database} LOCATION '{shared_dir(spark)}/{database}'")
        _databases[app] = database
    return f"{_databases[app]}.{name}_{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a lost executor costs this step only, and it runs once."""
    table = _new_table(df.sparkSession, name)
    df.write.format("parquet").saveAsTable(table)
    out = df.sparkSession.table(table)
    _tables[out] = table
    return out


def path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, for what is not a table."""
    return f"{shared_dir(spark)}/bytequarry_{name}_{uuid.uuid4().hex}"


def dropped(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that :func:`written` returned and that nothing reads any more."""
    for df in frames:
        if table := _tables.pop(df, None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


def release(spark: SparkSession) -> None:
    """Deletes all steps of this application."""
    if name := _databases.pop(spark.conf.get("spark.app.id", ""), None):
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


class Growing:
    """A written table that grows round by round; rows of a round are a partition of it."""

    def __init__(self, first: DataFrame, name: str = "growing"):
        self.spark, self.table, self.round = first.sparkSession, _new_table(first.sparkSession, name), -1
        self.columns = first.columns
        self.add(first)

    def add(self, rows: DataFrame) -> bool:
        """Appends the rows of the next round; whether there are any."""
        from pyspark.sql import functions as F

        self.round += 1
        rows.select(*self.columns, F.lit(self.round).alias("round")).write.format("parquet").mode("append").partitionBy("round").saveAsTable(self.table)
        return not self.latest().isEmpty()

    def all(self) -> DataFrame:
        return self.spark.table(self.table).select(*self.columns)

    def latest(self) -> DataFrame:
        return self.spark.table(self.table).where(f"round = {self.round}").select(*self.columns)

    def before(self) -> DataFrame:
        return self.spark.table(self.table).where(f"round < {self.round}").select(*self.columns)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
