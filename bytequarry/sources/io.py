"""Scans and sinks. Paths go to Spark's readers and writers, so they may be in any store it reads."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.functions import bytecode as B
from bytequarry.functions.text import clean
from bytequarry.sources.workbook import scan_table


def scan_delimited(spark: SparkSession, path: str, sep: str = ";", columns: list[str] | None = None) -> DataFrame:
    """Delimited text with a header; every column is text and blanks stay blank. ``columns`` prunes the scan."""
    df = spark.read.csv(path, sep=sep, header=True, nullValue="\u0000", emptyValue="")
    df = df.select(*(columns or df.columns))
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in df.columns])


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, content`` of every matching file below ``path``, whole."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def stem(path):
    """File name without its suffix; ``.rt.hex`` counts as one suffix."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(path, "/", -1), r"\.rt\.hex$", ""), r"\.[^.]*$", "")


def first_part(path, root: str):
    """The first folder below ``root`` on a path."""
    tail = re.escape(root.rstrip("/").rpartition("/")[2])
    return F.regexp_extract(path, f"/{tail}/([^/]+)/", 1)


CONTRACTS = "struct<contracts: map<string, struct<bin: string, `bin-runtime`: string>>>"
FINDINGS = "`node name` string, SWCs array<map<string, string>>"


def scan_compiler_json(spark: SparkSession, root: str) -> DataFrame:
    """``dapp, path, contract_key, initcode, runtime`` of a tree of compiler output; unreadable files give one row with ``failed``."""
    files = _files(spark, root, "*.json").withColumn("doc", F.from_json("content", CONTRACTS, {"mode": "PERMISSIVE"}))
    rows = files.select(first_part(F.col("path"), root).alias("dapp"), "path", F.explode_outer("doc.contracts").alias("contract_key", "c"))
    return rows.select("dapp", "path", "contract_key", F.coalesce("c.bin", F.lit("")).alias("initcode"), F.coalesce(F.col("c")["bin-runtime"], F.lit("")).alias("runtime"), F.col("contract_key").isNull().alias("failed"))


def scan_findings(spark: SparkSession, root: str) -> DataFrame:
    """``path, node_name, finding`` (a map), ``failed`` of a tree of finding reports; a report without findings, or one that cannot be read, keeps one row."""
    files = _files(spark, root, "*.json").withColumn("doc", F.from_json("content", FINDINGS + ", broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}))
    return files.select("path", F.col("doc")["node name"].alias("node_name"), F.explode_outer("doc.SWCs").alias("finding"), (F.col("doc").isNull() | F.col("doc.broken").isNotNull()).alias("failed"))


def scan_counts(findings: DataFrame) -> DataFrame:
    """Files read, files that could not be, and findings of :func:`scan_findings`."""
    per_file = findings.groupBy("path").agg(F.bool_or("failed").alias("failed"), F.count("finding").alias("n"))
    return per_file.agg(F.count_if(~F.col("failed")).alias("parsed_files"), F.count_if("failed").alias("failed_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))


def scan_hex_files(spark: SparkSession, root: str) -> DataFrame:
    """``stem, code, failure_mode`` of every file below ``root``."""
    return _files(spark, root, "*").select(stem(F.col("path")).alias("stem"), B.normal(F.col("content")).alias("code"), B.failure(F.col("content")).alias("failure_mode"))


def list_stems(spark: SparkSession, root: str) -> DataFrame:
    """File stems below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(stem(F.col("path")).alias("stem")).distinct()


def attach_code(contracts: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Contracts with their file's code, empty and flagged where there is none."""
    j = contracts.join(files.select(F.col("stem").alias(key), "code"), key, "left")
    return j.withColumn("missing", F.col("code").isNull()).withColumn("code", F.coalesce("code", F.lit("")))


def scan_id_lists(spark: SparkSession, root: str) -> DataFrame:
    """``split, id`` of text files named ``<split>_ids.txt``; blank lines go."""
    lines = spark.read.option("pathGlobFilter", "*_ids.txt").text(root).select(F.col("_metadata.file_name").alias("f"), clean(F.col("value")).alias("id"))
    return lines.where("id <> ''").select(F.regexp_replace("f", "_ids\\.txt$", "").alias("split"), "id")


def id_list_faults(ids: DataFrame) -> DataFrame:
    """Ids that a list repeats or that several lists hold."""
    return ids.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits")).where("n > 1")


def scan_verdict(spark: SparkSession, path: str, allowed: tuple[str, ...]) -> str:
    """The back-quoted verdict of a Markdown file; an error where it is not one of ``allowed``."""
    row = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"Verdict:\s*`([^`]+)`", 1).alias("v")).first()
    if row is None or row["v"] not in allowed:
        raise ValueError(f"no allowed verdict in {path}")
    return row["v"]


def scan_mapping(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON file that holds one mapping."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def match_headers(columns: list[str], wanted: dict[str, list[str]]) -> dict[str, str]:
    """The column for each wanted name: the first candidate that equals one, else one that contains all its words."""
    norm = {re.sub(r"[^a-z0-9]+", " ", c.lower()).strip(): c for c in columns}
    out = {}
    for name, candidates in wanted.items():
        hit = next((norm[c] for c in candidates if c in norm), None)
        hit = hit or next((c for n, c in norm.items() for k in candidates if all(w in n for w in k.split())), None)
        if hit:
            out[name] = hit
    return out


def scan_sheet(spark: SparkSession, path: str, wanted: dict[str, list[str]]) -> DataFrame:
    """A sheet saved as comma-separated text, or the first one of a workbook, with matched headers."""
    if path.endswith(".xlsx"):
        df = scan_table(spark, path)
    else:
        df = scan_delimited(spark, path, sep=",")
    found = match_headers(df.columns, wanted)
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in found.items()])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever store it is; only its own entries are listed."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", False).option("pathGlobFilter", "no such name").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def free_path(spark: SparkSession, path: str, now: datetime | None = None) -> tuple[str, bool]:
    """``path``, or where that is taken one with a time stamp (and a number) before the suffix; and whether it was taken."""
    if not exists(spark, path):
        return path, False
    head, dot, suffix = path.rpartition(".") if "." in path.rpartition("/")[2] else (path, "", "")
    stamped = f"{head}_{(now or datetime.now(timezone.utc)):%Y%m%dT%H%M%SZ}"
    n, out = 1, f"{stamped}{dot}{suffix}"
    while exists(spark, out):
        n, out = n + 1, f"{stamped}_{n}{dot}{suffix}"
    return out, True


def write_parquet(df: DataFrame, path: str, keep: bool = False) -> str:
    """Writes ``df``; with ``keep`` an existing path is left alone and another one is taken."""
    path = free_path(df.sparkSession, path)[0] if keep else path
    df.write.mode("errorifexists" if keep else "overwrite").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_ids(df: DataFrame, path: str) -> None:
    """Ids in order, one on each line, as one file."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def report(df: DataFrame) -> str:
    """A small result as JSON (a list of objects)."""
    return json.dumps([r.asDict(recursive=True) for r in df.collect()], indent=2, default=str)


def markdown(df: DataFrame) -> str:
    """A small result as a Markdown table."""
    rows = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in df.collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"


def manifest(entrypoint: str, started: datetime, inputs: list[str], outputs: list[str], summary: dict) -> str:
    return json.dumps({"entrypoint": entrypoint, "started": started.isoformat(), "finished": datetime.now(timezone.utc).isoformat(), "inputs": inputs, "outputs": outputs, "summary": summary}, indent=2)
