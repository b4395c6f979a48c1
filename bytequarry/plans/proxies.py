"""Deterministic views that give the driver's tables the shapes the operators expect, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.session import read_table

VOTES_SQL = "votes AS (SELECT l_partkey AS fp, 100 + l_linenumber AS swc_id, CASE l_returnflag WHEN 'A' THEN 't' WHEN 'R' THEN 'f' ELSE 'x' END AS vote, l_linestatus AS dataset FROM lineitem)"
PAIRS_SQL = (
    VOTES_SQL
    + """, pairs AS (
  SELECT fp, swc_id, count(*) FILTER (WHERE vote = 't') AS vote_true, count(*) FILTER (WHERE vote = 'f') AS vote_false, count(*) AS n_votes
  FROM votes WHERE vote IN ('t', 'f') AND swc_id BETWEEN 100 AND 136 GROUP BY fp, swc_id),
labels0 AS (
  SELECT *, vote_true > 0 AND vote_false > 0 AS has_conflict, vote_true = vote_false AS is_tie,
         CASE WHEN vote_true > vote_false THEN 1 WHEN vote_false > vote_true THEN 0 END AS label FROM pairs)"""
)


def votes(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("l_returnflag") == "A", "t").when(F.col("l_returnflag") == "R", "f").otherwise("x")
    return read_table(spark, d, "lineitem").select(F.col("l_partkey").alias("fp"), (F.col("l_linenumber") + 100).alias("swc_id"), v.alias("vote"), F.col("l_linestatus").alias("dataset"))


#: Two overlapping sources with equal texts: rows by the remainder of doc_id by 3 (remainder 0 is in both).
SOURCES_SQL = """docs AS (
  SELECT doc_id, source AS name, text AS body, n_chars AS size, n_chars < 500 AS flag, CASE WHEN length(text) > 0 THEN sha256(text) END AS fp FROM documents),
sa AS (SELECT * FROM docs WHERE doc_id % 3 <> 1), sb AS (SELECT * FROM docs WHERE doc_id % 3 <> 2)"""


def sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, d, "documents")
    fp = F.when(F.length("text") > 0, F.sha2(F.col("text"), 256))
    docs = docs.select("doc_id", F.col("source").alias("name"), F.col("text").alias("body"), F.col("n_chars").alias("size"), (F.col("n_chars") < 500).alias("flag"), fp.alias("fp"))
    return docs.where("doc_id % 3 <> 1"), docs.where("doc_id % 3 <> 2")


#: Labels of documents, quality as class 101 and toxic as class 102, from source a or b by the parity of doc_id; a contract is a remainder of doc_id.
LABELS_SQL = """lab AS (
  SELECT l.doc_id, sha256((l.doc_id % 197)::VARCHAR) AS fp, u.swc_id, u.label, CASE WHEN l.doc_id % 2 = 0 THEN 'cgt' ELSE 'dappscan' END AS source
  FROM labels l JOIN documents d USING (doc_id), LATERAL (SELECT 101 AS swc_id, l.quality AS label UNION ALL SELECT 102, l.toxic) u)"""


def labels(spark: SparkSession, d: str) -> DataFrame:
    j = read_table(spark, d, "labels").join(read_table(spark, d, "documents").select("doc_id", F.sha2((F.col("doc_id") % 197).cast("string"), 256).alias("fp")), "doc_id")
    long = j.select("doc_id", "fp", F.explode(F.array(F.struct(F.lit(101).alias("swc_id"), F.col("quality").alias("label")), F.struct(F.lit(102).alias("swc_id"), F.col("toxic").alias("label")))).alias("u"))
    return long.select("doc_id", "fp", "u.swc_id", "u.label", F.when(F.col("doc_id") % 2 == 0, "cgt").otherwise("dappscan").alias("source"))


#: Hex code made of eight digests of each text.
CODES_SQL = """codes AS (
  SELECT doc_id AS fp, sha256(text || '0') || sha256(text || '1') || sha256(text || '2') || sha256(text || '3')
    || sha256(text || '4') || sha256(text || '5') || sha256(text || '6') || sha256(text || '7') AS code FROM documents WHERE text IS NOT NULL)"""


def codes(spark: SparkSession, d: str) -> DataFrame:
    digests = [F.sha2(F.concat("text", F.lit(str(i))), 256) for i in range(8)]
    return read_table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("fp"), F.concat(*digests).alias("code"))


#: Codes over a small alphabet, one per user: four jump destinations, then a snippet for each event:
#: arithmetic, stores and loads at known places, duplicates, swaps, a copy, jumps with a target.
SNIPPETS = ("6001600201", "60aa600155", "60015450", "5b3350", "6000600357", "60aa80600155", "3391", "602052", "60205150", "6000600060003780", "600256", "60ff8060005560005450")
PROGRAMS_SQL = f"""programs AS (
  SELECT user_id AS fp, '5b5b5b5b' || string_agg(CASE event_id % {len(SNIPPETS)} {" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SNIPPETS))} END, '' ORDER BY event_id) || '00' AS code
  FROM events GROUP BY user_id)"""


def programs(spark: SparkSession, d: str) -> DataFrame:
    return _by_events(spark, d, "5b5b5b5b", SNIPPETS)


#: Codes with subroutines, one per user: three that go back to an address on the stack (the top; the
#: top after dropping the next; through the first), four landing pads, then calls, plain and
#: computed jumps and stack shuffles by event.
ROUTINES_HEAD = "6013565b565b9050565b8060035700" + "5b5b5b" + "00" + "5b"
ROUTINES = ("600f600356", "60aa6010600556", "6011600956", "5b", "6001600201", "80", "90", "56", "57", "6010", "5b50", "600f57")
ROUTINES_SQL = f"""routines AS (
  SELECT user_id AS fp, '{ROUTINES_HEAD}' || string_agg(CASE event_id % {len(ROUTINES)} {" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(ROUTINES))} END, '' ORDER BY event_id) || '00' AS code
  FROM events GROUP BY user_id)"""


def routines(spark: SparkSession, d: str) -> DataFrame:
    return _by_events(spark, d, ROUTINES_HEAD, ROUTINES)


def _by_events(spark: SparkSession, d: str, head: str, snippets: tuple[str, ...]) -> DataFrame:
    """A code for each user: the head, a snippet for each event in order, a stop."""
    snippet = F.get(F.array(*[F.lit(s) for s in snippets]), (F.col("event_id") % len(snippets)).cast("int"))
    rows = read_table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", snippet.alias("s")))).alias("r"))
    return rows.select(F.col("user_id").alias("fp"), F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["s"]), ""), F.lit("00")).alias("code"))


#: Predictions for every document and class; targets are unknown where the document has no label.
PRED_SQL = """pred AS (
  SELECT d.doc_id AS id, u.label_id, ((d.doc_id * 7919 + u.label_id * 104729) % 1000) / 1000.0::DOUBLE AS prob, CASE u.label_id WHEN 1 THEN l.quality ELSE l.toxic END AS target, d.doc_id % 5 AS fold
  FROM documents d LEFT JOIN labels l USING (doc_id), (VALUES (1), (2)) u(label_id))"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    j = read_table(spark, d, "documents").select("doc_id").join(read_table(spark, d, "labels"), "doc_id", "left")
    x = j.select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("label_id"), F.col("quality").alias("target")), F.struct(F.lit(2).alias("label_id"), F.col("toxic").alias("target")))).alias("u"))
    prob = ((F.col("doc_id") * 7919 + F.col("u.label_id") * 104729) % 1000) / F.lit(1000.0)
    return x.select(F.col("doc_id").alias("id"), "u.label_id", prob.alias("prob"), "u.target", (F.col("doc_id") % 5).alias("fold"))


#: Runs of models (event types) over seeds and two variants.
RUNS_SQL = "runs AS (SELECT event_type AS model, user_id % 5 AS seed, 'v' || (user_id % 2) AS variant, value AS metric, event_id FROM events)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("seed"), F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")).alias("variant"), F.col("value").alias("metric"), "event_id")


#: A hash split (8:1:1) by four hex digits of the id's digest.
SPLIT_SQL = "CASE WHEN h % 10 < 8 THEN 'train' WHEN h % 10 = 8 THEN 'val' ELSE 'test' END"


def split_hash_sql(c: str) -> str:
    return f"('0x' || substr(sha256(({c})::VARCHAR), 1, 4))::INT"
