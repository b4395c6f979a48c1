"""Flow graphs from an external program: run on the executors, one code at a time, read by Spark.

The program gets a code as its last argument (or in place of ``{code}``) and writes a JSON
report to the file named by ``{out}`` in its own temporary folder, or to its output. Only
running it is Python; its reports are parsed and turned into nodes and edges as columns, with
a failure mode for whatever can be wrong with them.
"""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.functions import evm

RAN = "fp string, failure_mode string, failure_detail string, report string"
REPORT = "runtimeCfg struct<nodes: string, successors: string>"
NODE = "array<struct<offset: string, length: string, stackBalance: string, type: string, bytecodeHex: string>>"
SUCCESSOR = "array<struct<`from`: string, `to`: string>>"


def run_program(codes: DataFrame, command: list[str], timeout: float, least: int = 400) -> DataFrame:
    """``fp, failure_mode, failure_detail, report`` of ``codes`` (``fp, code``): ``program_missing``, ``program_timeout``, ``program_failed``, ``report_missing`` or ''.

    A program that hangs is stopped after ``timeout`` seconds. Of its messages the first
    ``least`` characters are kept. A task that is run again runs it again.
    """

    def one(code: str) -> tuple[str, str, str | None]:
        with tempfile.TemporaryDirectory() as folder:  # the program's own, on the machine where it runs, and gone with it
            out = Path(folder, "report.json")
            filled = [a.replace("{code}", code).replace("{out}", out.name) for a in command]
            filled += [] if any("{code}" in a for a in command) else [code]
            try:
                done = subprocess.run(filled, cwd=folder, capture_output=True, text=True, errors="replace", timeout=timeout, check=False)
            except FileNotFoundError:
                return "program_missing", command[0], None
            except subprocess.TimeoutExpired:
                return "program_timeout", f"{timeout}s", None
            if done.returncode:
                return "program_failed", (done.stderr.strip() or done.stdout.strip())[:least], None
            if not any("{out}" in a for a in command):
                return "", "", done.stdout
            return ("", "", out.read_text(encoding="utf-8", errors="replace")) if out.exists() else ("report_missing", "", None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fp, code in zip(pdf["fp"], pdf["code"], strict=True):
                yield pd.DataFrame([(fp, *one(code))], columns=[c.split()[0] for c in RAN.split(", ")])

    return codes.select(F.col("fp").cast("string").alias("fp"), "code").mapInPandas(run, RAN)


def read_reports(ran: DataFrame) -> DataFrame:
    """``fp, failure_mode, failure_detail, nodes, successors`` of :func:`run_program`, with further modes for reports that are no graph.

    ``nodes`` and ``successors`` are arrays of structs, null where there is a failure.
    """
    x = ran.withColumn("g", F.from_json("report", REPORT)["runtimeCfg"])
    x = x.withColumns({"n": F.from_json("g.nodes", NODE), "s": F.from_json("g.successors", SUCCESSOR)})
    number = lambda v: v.rlike(r"^\s*-?[0-9]{1,9}\s*$")
    whole = lambda n: number(n["offset"]) & number(n["length"]) & number(n["stackBalance"])
    listed = lambda v: F.from_json(v, "array<string>")
    lists = lambda s: s["from"].isNotNull() & number(s["from"]) & s["to"].isNotNull() & s["to"].rlike(r"^\s*\[") & F.forall(F.coalesce(listed(s["to"]), F.array(F.lit("x"))), number)
    mode = (
        F.when(F.col("failure_mode") != "", F.col("failure_mode"))
        .when(F.coalesce(F.try_parse_json("report").isNull(), F.lit(True)), "invalid_json")
        .when(F.col("g").isNull() | (F.col("g.nodes").isNull() & F.col("g.successors").isNull()), "missing_runtime_cfg")
        .when(~F.coalesce(F.col("g.nodes").rlike(r"^\s*\[") & F.col("g.successors").rlike(r"^\s*\["), F.lit(False)), "invalid_runtime_cfg_schema")
        .when(F.col("n").isNull() | ~F.coalesce(F.forall("n", lambda n: F.coalesce(whole(n), F.lit(False))), F.lit(False)), "invalid_node_schema")
        .when(F.exists("n", lambda n: (n["offset"].cast("long") < 0) | (n["length"].cast("long") < 0)), "invalid_node_bounds")
        .when(F.size("n") == 0, "empty_cfg")
        .when(F.col("s").isNull() | ~F.coalesce(F.forall("s", lambda s: F.coalesce(lists(s), F.lit(False))), F.lit(False)), "invalid_successor_schema")
        .otherwise("")
    )
    x = x.withColumn("failure_mode", mode)
    fine = F.col("failure_mode") == ""
    return x.select("fp", "failure_mode", "failure_detail", F.when(fine, F.col("n")).alias("nodes"), F.when(fine, F.col("s")).alias("successors"))


def external_nodes(reports: DataFrame) -> DataFrame:
    """``fp, start_pc, end_pc, node_type, stack_balance, code`` of the graphs' nodes."""
    n = reports.select("fp", F.explode("nodes").alias("n"))
    start, length = F.col("n.offset").cast("int"), F.col("n.length").cast("int")
    return n.select("fp", start.alias("start_pc"), (start + F.greatest(length - 1, F.lit(0))).alias("end_pc"), F.coalesce("n.type", F.lit("unknown")).alias("node_type"), F.col("n.stackBalance").cast("int").alias("stack_balance"), length.alias("length"), F.coalesce("n.bytecodeHex", F.lit("")).alias("code"))


def external_edges(reports: DataFrame) -> DataFrame:
    """``fp, src, dst, edge_type`` of the graphs' successors whose source is a node, each once.

    The last instruction of the source's code gives the type: a conditional jump goes on to
    the place behind the block or is taken, a jump jumps, another ending one is terminal, and
    the rest falls through to the place behind the block or jumps.
    """
    nodes = external_nodes(reports)
    hexed = nodes.where(F.col("code").rlike("^([0-9a-fA-F]{2})+$")).select(F.concat_ws(":", "fp", "start_pc").alias("fp"), F.lower("code").alias("code"))
    ends = evm.disassemble(hexed).groupBy("fp").agg(F.max_by("opcode", "pc").alias("end_opcode"))
    known = nodes.withColumn("key", F.concat_ws(":", "fp", "start_pc")).join(ends.withColumnRenamed("fp", "key"), "key", "left")
    known = known.groupBy("fp", F.col("start_pc").alias("src")).agg(F.max_by("end_opcode", "length").alias("end_opcode"), F.max("length").alias("length"))
    to = reports.select("fp", F.explode("successors").alias("s")).select("fp", F.col("s.from").cast("int").alias("src"), F.explode(F.from_json("s.to", "array<string>")).alias("dst"))
    e = to.withColumn("dst", F.col("dst").cast("int")).join(known, ["fp", "src"])
    on = F.col("dst") == F.col("src") + F.col("length")
    kind = F.when(F.col("end_opcode") == "JUMPI", F.when(on, "jumpi_false").otherwise("jumpi_true")).when(F.col("end_opcode") == "JUMP", "jump")
    kind = kind.when(F.col("end_opcode").isin(*evm.TERMINAL), "terminal").when(on, "fallthrough").otherwise("jump")
    return e.select("fp", "src", "dst", kind.alias("edge_type")).distinct()
