"""``python -m bytequarry task NAME --flags``: the steps from raw files to a labelled, split corpus.

Each task reads files or tables of earlier tasks, writes Parquet tables below ``--out`` and
beside them ``report``, a JSON file of its counts with inputs, outputs and times. Paths may be
in any store that Spark reads. ``--keep`` leaves existing tables alone and takes free names.
"""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.functions import bytecode as B
from bytequarry.functions import evm
from bytequarry.functions import text as T
from bytequarry.operators import corpus, features, labels, splits, steps
from bytequarry.session import local_session
from bytequarry.sources import io

Tables = dict[str, DataFrame]
#: What a verdict file may say, and whether it allows negative labels.
VERDICTS = {"POS+NEG_EXPLICIT": True, "POS_ONLY": False}

#: Keys and values of findings that are no plain positive.
NEGATIVE_KEYS = ["status", "result", "label", "is_vulnerable", "vulnerable", "negative", "positive", "passed", "failed"]
NEGATIVE_VALUES = ["false", "negative", "not vulnerable", "safe", "clean", "pass", "passed", "no"]


def _votes(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = io.scan_delimited(spark, a.votes, a.sep, [a.fp_column, a.class_column, a.vote_column, a.dataset_column])
    fp, swc, vote, dataset = (T.clean(F.col(f"`{c}`")) for c in (a.fp_column, a.class_column, a.vote_column, a.dataset_column))
    return rows.select(F.lower(fp).alias("fp"), T.to_int(swc).cast("int").alias("swc_id"), F.lower(vote).alias("vote"), dataset.alias("dataset"))


def profile(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Fields of a vote table, and the distribution of its classes, votes and datasets."""
    v = _votes(spark, a)
    parts = [corpus.distribution(v.withColumn(c, F.col(c).cast("string")), c).withColumn("field", F.lit(c)) for c in ("swc_id", "vote", "dataset")]
    return {"fields": corpus.field_profile(v), "values": parts[0].unionByName(parts[1]).unionByName(parts[2])}


def curate(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Contracts, majority labels of every contract and class, and their balance, from a vote table; codes from ``--hex``."""
    v = _votes(spark, a).where("fp <> ''")
    pairs = labels.vote_pairs(labels.valid_votes(v, a.class_min, a.class_max))
    contracts = v.select("fp").distinct()
    grid = steps.written(labels.label_grid(contracts, pairs.select("swc_id").distinct(), pairs), "grid")
    if a.hex:
        contracts = io.attach_code(contracts, io.scan_hex_files(spark, a.hex).withColumn("stem", F.lower("stem")), "fp")
    return {"contracts": contracts, "labels": grid, "balance": labels.balance(grid)}


def _fingerprints(rows: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Canonical code, fingerprint, counts and flags of ``name, code, failure_mode``; rows without code stay, without a fingerprint."""
    code = B.strip_metadata(F.col("code"), a.metadata == "zero")
    x = steps.written(rows.withColumn("code", F.when(F.length("code") >= 2 * a.min_bytes, code)).withColumn("row", F.monotonically_increasing_id()), "codes")
    n = features.call_ratios(evm.disassemble(x.where("code <> ''"), "row", "code")).select(F.col("fp").cast("long").alias("row"), "opcode_count", "delegatecall_count", "delegatecall_ratio")
    j = x.join(n, "row", "left").na.fill(0, ["opcode_count", "delegatecall_count", "delegatecall_ratio"])
    proxy = B.is_minimal_proxy(F.col("code")) | (F.col("delegatecall_count") > 0) & (F.col("delegatecall_ratio") >= a.proxy_share)
    why = F.when(F.col("failure_mode") != "", F.col("failure_mode")).when(F.col("code").isNull(), "runtime_too_short").otherwise("")
    return j.select(
        "name", B.fingerprint(F.col("code")).alias("fp"), F.coalesce("code", F.lit("")).alias("body"), F.coalesce((F.length("code") / 2).cast("int"), F.lit(0)).alias("size"),
        F.coalesce(proxy, F.lit(False)).alias("is_proxy_like"), F.coalesce(F.length("code") / 2 < a.stub_bytes, F.lit(False)).alias("is_stub_like"), "opcode_count", "delegatecall_count", why.alias("failure_mode"),
    )


def fingerprint(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Fingerprints of the codes of ``--hex`` (named by file) or of runtime codes below ``--compiler`` (named by contract), with collisions."""
    if bool(a.hex) == bool(a.compiler):
        raise SystemExit("fingerprint needs one of --hex and --compiler")
    if a.hex:
        rows = io.scan_hex_files(spark, a.hex).select(F.col("stem").alias("name"), "code", "failure_mode")
    else:
        found = steps.written(extract_runtimes(spark, a), "runtimes")
        rows = found.select("name", B.normal(F.col("code")).alias("code"), F.when(F.col("code") == "", F.coalesce("failure_mode", F.lit("missing_runtime_bytecode"))).otherwise(B.failure(F.col("code"))).alias("failure_mode"))
    x = steps.written(_fingerprints(rows, a), "fingerprints")
    return {"fingerprints": x, "collisions": corpus.collisions(x)}


def extract_runtimes(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """``dapp, name, code, origin, failure_mode``: runtime code of every contract of compiler output, extracted from its initcode or as the compiler has it."""
    c = io.scan_compiler_json(spark, a.compiler).where("NOT failed")
    name = T.contract_id(F.col("dapp"), T.contract_name(F.col("contract_key"), io.stem(F.col("path"))))
    hexed = lambda x: F.coalesce(B.normal(F.col(x)), F.lit(""))
    c = steps.written(c.select("dapp", name.alias("name"), hexed("initcode").alias("initcode"), hexed("runtime").alias("compiled"), F.monotonically_increasing_id().alias("row")), "compiled")
    traced = evm.extract_runtime(c.where("initcode <> ''"), "row", "initcode").select(F.col("fp").cast("long").alias("row"), "runtime", "failure_mode")
    code, origin = B.runtime_source(F.col("runtime"), F.col("compiled"), F.col("initcode"), a.min_bytes)
    return c.join(traced, "row", "left").select("dapp", "name", code.alias("code"), origin.alias("origin"), "failure_mode")


def runtime_extract(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Runtime codes of compiler output, how each was found, and failures by project."""
    found = steps.written(extract_runtimes(spark, a), "runtimes")
    mode = F.when(F.col("code") != "", "").otherwise(F.coalesce(F.nullif("failure_mode", F.lit("")), F.lit("no_bytecode")))
    return {"runtimes": found, "failures": corpus.failure_summary(found.withColumn("failure_mode", mode), "dapp"), "origins": corpus.distribution(found, "origin")}


def findings_labels(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Labels of the contracts of finding reports; negatives only where the verdict file allows them."""
    allowed = VERDICTS[io.scan_verdict(spark, a.verdict, tuple(VERDICTS))] if a.verdict else False
    f = steps.written(io.scan_findings(spark, a.findings), "findings")
    name = T.contract_id(io.first_part(F.col("path"), a.findings), T.drop_json_suffix(F.col("node_name"), io.stem(F.col("path"))))
    found = f.where("finding IS NOT NULL").select(name.alias("name"), T.class_id(F.col("finding")["category"]).alias("swc_id"), labels.markers(F.to_json("finding"), NEGATIVE_KEYS, NEGATIVE_VALUES).alias("negative"))
    g = found.where("swc_id IS NOT NULL").groupBy("name", "swc_id").agg(F.count_if(~F.col("negative")).alias("positive_findings"), (F.count_if("negative") if allowed else F.lit(0)).alias("negative_findings"))
    return {"labels": labels.evidence_labels(g, allowed), "reports": io.scan_counts(f)}


def merge_dedup(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """One row a fingerprint of two fingerprint tables, and how far they overlap."""
    sides = [spark.read.parquet(p).where("fp IS NOT NULL").withColumn("flag", F.col("is_proxy_like")) for p in (a.first, a.second)]
    merged = [corpus.source_aggregate(x, F.struct("name", "body")) for x in sides]
    return {"contracts": corpus.merge_sources(*merged), "overlap": corpus.overlap(*sides, "fp")}


def label_harmonize(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Both sources' known labels by fingerprint, and the pairs on which they differ; names become fingerprints by their fingerprint tables."""

    def side(path: str, names: str | None) -> DataFrame:
        rows = spark.read.parquet(path)
        if not names:
            return rows.select("fp", "swc_id", "label")
        known = labels.unique_map(spark.read.parquet(names), "name", "fp").select("name", "fp")
        key = "name" if "name" in rows.columns else "fp"
        return rows.withColumnRenamed(key, "name").select("name", "swc_id", "label").join(known, "name").select("fp", "swc_id", "label")

    both = steps.written(labels.harmonize(side(a.first, a.first_names), side(a.second, a.second_names)), "labels")
    return {"labels": both, "disagreements": labels.disagreements(both), "evidence": labels.pair_evidence(both)}


def class_select(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """Known labels of each class and what to do with it."""
    from bytequarry.operators.reports import parse_classes

    rows = spark.read.parquet(a.labels)
    return {"classes": labels.decision_matrix(rows, parse_classes(a.classes, rows, a.class_min, a.class_max), a.least)}


def split(spark: SparkSession, a: argparse.Namespace) -> Tables:
    """A stratified split of labelled fingerprints in ``--folds`` folds, its labels, and ids of each part."""
    rows = spark.read.parquet(a.labels).where("label IS NOT NULL").select("fp", "swc_id", "label")
    x = rows.select(F.col("fp").alias("id"), F.col("swc_id").alias("label_id"), F.col("label").alias("target"))
    parts = steps.written(splits.stratified(x, folds=a.folds, seed=a.seed), "splits")
    return {"splits": parts, "labels": corpus.split_label_stats(rows, parts.select(F.col("id").alias("fp"), "split"))}


def _flag(p: argparse.ArgumentParser, *names: str, **kw) -> None:
    for n in names:
        p.add_argument(n, **kw)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bytequarry task", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    subs = top.add_subparsers(dest="task", required=True)

    def task(name: str, run) -> argparse.ArgumentParser:
        p = subs.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        p.add_argument("--out", required=True, help="folder of the task's tables")
        p.add_argument("--keep", action="store_true", help="do not replace existing tables")
        return p

    for name, run in (("profile", profile), ("curate", curate)):
        p = task(name, run)
        p.add_argument("--votes", required=True, help="delimited file with a header")
        for flag, default in (("--sep", ";"), ("--fp-column", "fp_runtime"), ("--class-column", "swc"), ("--vote-column", "property_holds"), ("--dataset-column", "dataset")):
            p.add_argument(flag, default=default)
        _flag(p, "--hex", help="folder of code files named by fingerprint")
        _range(p)
    for name, run in (("fingerprint", fingerprint), ("runtime-extract", runtime_extract)):
        p = task(name, run)
        _flag(p, "--compiler", required=run is runtime_extract, help="tree of compiler output")
        if run is fingerprint:
            _flag(p, "--hex", help="folder of code files")
        p.add_argument("--min-bytes", type=int, default=1, help="shortest runtime code")
        p.add_argument("--metadata", choices=["strip", "zero"], default="strip")
        p.add_argument("--stub-bytes", type=int, default=100)
        p.add_argument("--proxy-share", type=float, default=0.02)
    p = task("findings-labels", findings_labels)
    _flag(p, "--findings", required=True, help="tree of finding reports")
    _flag(p, "--verdict", help="Markdown file that says whether negatives are explicit")
    p = task("merge-dedup", merge_dedup)
    _flag(p, "--first", "--second", required=True, help="fingerprint tables; the first one's codes are preferred")
    p = task("label-harmonize", label_harmonize)
    _flag(p, "--first", "--second", required=True, help="label tables")
    _flag(p, "--first-names", "--second-names", help="fingerprint tables that say what a name's fingerprint is")
    p = task("class-select", class_select)
    _flag(p, "--labels", required=True)
    _flag(p, "--classes", help="list of classes; without it those seen in range")
    p.add_argument("--least", type=int, default=20, help="known labels from which a class stays")
    _range(p)
    p = task("split", split)
    _flag(p, "--labels", required=True)
    p.add_argument("--folds", type=int, default=10)
    p.add_argument("--seed", type=int, default=0)
    return top


def _range(p: argparse.ArgumentParser) -> None:
    p.add_argument("--class-min", type=int, default=100)
    p.add_argument("--class-max", type=int, default=136)


def main(argv: list[str]) -> int:
    a = parser().parse_args(argv)
    spark, began = local_session(), datetime.now(timezone.utc)
    paths, rows = {}, {}
    for name, df in a.run(spark, a).items():
        paths[name] = io.write_parquet(df, f"{a.out.rstrip('/')}/{name}", a.keep)
        rows[name] = spark.read.parquet(paths[name]).count()
    flags = {k: v for k, v in vars(a).items() if k not in ("run", "task")}
    text = io.manifest(f"task {a.task}", began, [str(v) for k, v in flags.items() if k not in ("out", "keep") and isinstance(v, str)], list(paths.values()), {"rows": rows, "flags": flags})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{a.out.rstrip('/')}/report")
    steps.release(spark)
    print(json.dumps({"task": a.task, "rows": rows}))
    return 0

