"""Queries over votes and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytequarry.functions import text as T
from bytequarry.operators import corpus, labels
from bytequarry.plans import proxies as P
from bytequarry.plans.registry import query
from bytequarry.session import read_table

_VALID = "WHERE vote IN ('t', 'f') AND swc_id BETWEEN 100 AND 136"


def _pairs(s, d):
    return labels.vote_pairs(labels.valid_votes(P.votes(s, d)))


@query("vote_aggregate", f"WITH {P.PAIRS_SQL} SELECT * FROM labels0")
def vote_aggregate(s, d):
    return _pairs(s, d)


_GRID = P.PAIRS_SQL + """, cs AS (SELECT DISTINCT l_partkey AS fp FROM lineitem), sw AS (SELECT DISTINCT swc_id FROM votes),
grid AS (SELECT fp, swc_id, coalesce(vote_true, 0) AS vote_true, coalesce(vote_false, 0) AS vote_false, coalesce(n_votes, 0) AS n_votes,
  coalesce(has_conflict, false) AS has_conflict, coalesce(is_tie, false) AS is_tie, label, coalesce(n_votes, 0) > 0 AS is_assessed
  FROM cs CROSS JOIN sw LEFT JOIN labels0 USING (fp, swc_id))"""


def _grid(s, d):
    v = P.votes(s, d)
    return labels.label_grid(v.select("fp").distinct(), v.select("swc_id").distinct(), _pairs(s, d))


@query("label_grid", f"WITH {_GRID} SELECT * FROM grid")
def label_grid(s, d):
    return _grid(s, d)


@query("label_balance", f"""WITH {_GRID} SELECT swc_id, count(*) AS total, count(*) FILTER (WHERE is_assessed) AS assessed, count(*) FILTER (WHERE label = 1) AS positive,
  count(*) FILTER (WHERE label = 0) AS negative, count(*) FILTER (WHERE label IS NULL) AS unknown, count(*) FILTER (WHERE has_conflict) AS conflicts, count(*) FILTER (WHERE is_tie) AS ties FROM grid GROUP BY swc_id""")
def label_balance(s, d):
    return labels.balance(_grid(s, d))


@query("contract_counts", f"""WITH {P.PAIRS_SQL}, r AS (SELECT fp, count(*) AS n FROM votes {_VALID} GROUP BY fp), p AS (SELECT fp, count(*) AS n FROM pairs GROUP BY fp)
SELECT c.p_partkey AS fp, coalesce(r.n, 0) AS candidate_assessment_rows, coalesce(p.n, 0) AS assessed_swc_pairs, r.n IS NOT NULL AS has_votes FROM part c LEFT JOIN r ON r.fp = c.p_partkey LEFT JOIN p ON p.fp = c.p_partkey""")
def contract_counts(s, d):
    v = labels.valid_votes(P.votes(s, d))
    rows = v.groupBy("fp").agg(F.count("*").alias("candidate_assessment_rows"))
    pairs = v.select("fp", "swc_id").distinct().groupBy("fp").agg(F.count("*").alias("assessed_swc_pairs"))
    c = read_table(s, d, "part").select(F.col("p_partkey").alias("fp")).join(rows, "fp", "left").join(pairs, "fp", "left")
    return c.withColumn("has_votes", F.col("candidate_assessment_rows").isNotNull()).na.fill(0)


@query("value_distribution", "SELECT coalesce(nullif(trim(l_shipmode), ''), '<MISSING>') AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS pct FROM (SELECT l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1")
def value_distribution(s, d):
    return corpus.distribution(read_table(s, d, "lineitem"), "l_returnflag")


@query("field_profile", "WITH u AS (UNPIVOT (SELECT nullif(trim(c_custkey::VARCHAR), '') AS c_custkey, nullif(trim(c_name), '') AS c_name, nullif(trim(c_nationkey::VARCHAR), '') AS c_nationkey, nullif(trim(c_mktsegment), '') AS c_mktsegment FROM customer) x ON c_custkey, c_name, c_nationkey, c_mktsegment INTO NAME field VALUE v) SELECT field, CASE field WHEN 'c_custkey' THEN 'bigint' WHEN 'c_nationkey' THEN 'int' ELSE 'string' END AS dtype, count(v) AS non_empty, (SELECT count(*) FROM customer) - count(v) AS empty, count(DISTINCT v) AS unique_non_empty FROM u GROUP BY field")
def field_profile(s, d):
    return corpus.field_profile(read_table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query("mask_counters", f"WITH {_GRID} SELECT count(*) FILTER (WHERE is_assessed AND has_conflict AND NOT is_tie) AS conflict_no_tie, count(*) FILTER (WHERE is_tie AND is_assessed) AS ties, count(*) FILTER (WHERE NOT is_assessed) AS unassessed FROM grid")
def mask_counters(s, d):
    g = _grid(s, d)
    return g.agg(F.count_if(F.col("is_assessed") & F.col("has_conflict") & ~F.col("is_tie")).alias("conflict_no_tie"), F.count_if(F.col("is_tie") & F.col("is_assessed")).alias("ties"), F.count_if(~F.col("is_assessed")).alias("unassessed"))


_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


@query("text_clean", f"SELECT doc_id, trim(coalesce(x, ''), {_WS}) AS cleaned, coalesce(trim(slug, '_'), '') AS slug FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN chr(9) || source || ' ' || chr(10) ELSE '  ' || lang END AS x, CASE doc_id % 3 WHEN 0 THEN 'dataset' ELSE lower(regexp_replace(CASE doc_id % 3 WHEN 1 THEN chr(9) || source || ' ' || chr(10) ELSE '  ' || lang END, '[^a-zA-Z0-9]+', '_', 'g')) END AS slug FROM documents)")
def text_clean(s, d):
    m = F.col("doc_id") % 3
    x = F.when(m == 0, F.lit(None)).when(m == 1, F.concat(F.lit("\t"), "source", F.lit(" \n"))).otherwise(F.concat(F.lit("  "), "lang"))
    return read_table(s, d, "documents").select("doc_id", T.clean(x).alias("cleaned"), T.slug(x).alias("slug"))


@query("safe_cast", "SELECT o_orderkey, CASE WHEN x::DOUBLE = floor(x::DOUBLE) THEN x::DOUBLE::BIGINT END AS n FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_orderkey || '.0' WHEN 2 THEN o_orderkey || '.5' ELSE o_orderkey::VARCHAR END AS x FROM orders)")
def safe_cast(s, d):
    k, m = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    x = F.when(m == 0, F.lit("none")).when(m == 1, F.concat(F.lit(" "), k, F.lit(".0 "))).when(m == 2, F.concat(k, F.lit(".5"))).otherwise(k)
    return read_table(s, d, "orders").select("o_orderkey", T.to_int(x).alias("n"))


@query("class_extract", "SELECT event_id, (100 + event_id % 40)::INT AS swc_id, event_type || '/' || user_id AS contract_id, event_type AS contract_name, event_type AS report FROM events")
def class_extract(s, d):
    e = read_table(s, d, "events")
    category = F.concat(F.lit("SWC-"), (100 + F.col("event_id") % 40).cast("string"), F.lit("-Something"))
    key = F.concat(F.lit("contracts/a.sol:"), "event_type")
    return e.select("event_id", T.class_id(category).alias("swc_id"), T.contract_id(F.concat(F.lit("/"), "event_type"), F.col("user_id").cast("string")).alias("contract_id"), T.contract_name(key, F.lit("a")).alias("contract_name"), T.drop_json_suffix(F.concat("event_type", F.lit(".JSON")), F.lit("x")).alias("report"))


@query("negative_markers", "SELECT event_id, props LIKE '%\"k\"%' OR event_id % 7 = 0 AS by_key, event_id % 7 = 0 AS by_value FROM events")
def negative_markers(s, d):
    e = read_table(s, d, "events")
    j = F.when(F.col("event_id") % 7 == 0, '{"verdict": "Not-Vulnerable", "k": "1"}').otherwise(F.col("props"))
    return e.select("event_id", labels.markers(j, ["k"], []).alias("by_key"), labels.markers(j, ["absent"], ["not-vulnerable", "safe"]).alias("by_value"))


@query("negative_verdict", "SELECT event_type, bool_or(event_id % 7 = 0) AS negatives_allowed, count(*) FILTER (WHERE event_id % 7 = 0) AS marked FROM events GROUP BY event_type")
def negative_verdict(s, d):
    m = negative_markers(s, d).join(read_table(s, d, "events").select("event_id", "event_type"), "event_id")
    return m.groupBy("event_type").agg(F.bool_or("by_value").alias("negatives_allowed"), F.count_if("by_value").alias("marked"))


@query("json_keys", "SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def json_keys(s, d):
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    return read_table(s, d, "events").select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def _sources(s, d):
    x = P.labels(s, d)
    return x.where("source = 'cgt'"), x.where("source = 'dappscan'")


_HARM = P.LABELS_SQL + """, h AS (SELECT fp, swc_id, label, source, CASE WHEN source = 'cgt' THEN 'hard_cgt' WHEN label = 1 THEN 'pos_dappscan' ELSE 'explicit_neg_dappscan' END AS label_confidence
  FROM lab WHERE fp IS NOT NULL AND label IN (0, 1))"""


@query("harmonize", f"WITH {_HARM} SELECT * FROM h")
def harmonize(s, d):
    return labels.harmonize(*_sources(s, d))


@query("disagreements", f"WITH {_HARM} SELECT * FROM h WHERE (fp, swc_id) IN (SELECT (fp, swc_id) FROM h GROUP BY fp, swc_id HAVING count(DISTINCT label) > 1 AND count(DISTINCT source) > 1)")
def disagreements(s, d):
    return labels.disagreements(harmonize(s, d))


_MATRIX = _HARM + """, m AS (SELECT c.swc_id, count(*) FILTER (WHERE source = 'cgt' AND label = 1) AS cgt_positive, count(*) FILTER (WHERE source = 'cgt' AND label = 0) AS cgt_negative,
  count(*) FILTER (WHERE source = 'dappscan' AND label = 1) AS dappscan_positive, count(*) FILTER (WHERE source = 'dappscan' AND label = 0) AS dappscan_negative
  FROM (VALUES (101), (102), (103)) c(swc_id) LEFT JOIN h ON h.swc_id = c.swc_id GROUP BY c.swc_id),
mm AS (SELECT *, cgt_positive + cgt_negative AS cgt_known_total, dappscan_positive + dappscan_negative AS dappscan_known_total, cgt_positive + cgt_negative + dappscan_positive + dappscan_negative AS known_total FROM m),
dm AS (SELECT *, CASE WHEN known_total < 20 THEN 'drop_low_count' WHEN cgt_known_total > 0 AND dappscan_known_total = 0 THEN 'keep_cgt_only' WHEN cgt_known_total = 0 AND dappscan_positive > 0 THEN 'keep_pu_only' ELSE 'keep' END AS action FROM mm)"""


def _matrix(s, d):
    return labels.decision_matrix(harmonize(s, d), s.createDataFrame([(101,), (102,), (103,)], "swc_id int"))


@query("decision_matrix", f"WITH {_MATRIX} SELECT * FROM dm")
def decision_matrix(s, d):
    return _matrix(s, d)


_REC = _MATRIX + f""", sc AS (SELECT swc_id, count(label) AS known, count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative FROM h WHERE fp < 'a' GROUP BY swc_id),
rj AS (SELECT dm.*, coalesce(known, 0) AS known, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative FROM dm LEFT JOIN sc USING (swc_id)), rr AS (SELECT *, action = 'drop_low_count' OR known_total < 20 AS low, known >= 100 AND least(positive, negative) >= 10 AS main, '(known=' || known || ', positive=' || positive || ', negative=' || negative || ').' AS c FROM rj)"""


@query("recommendation", f"""WITH {_REC} SELECT swc_id, CASE WHEN low THEN 'drop_low_support' WHEN main THEN 'keep_for_main_benchmark' ELSE 'keep_for_auxiliary_only' END AS recommendation,
CASE WHEN low THEN 'Low known-label support after harmonization (below 20), unstable for benchmarking.' WHEN main THEN 'Strong primary support ' || c ELSE 'Retained with limited/imbalanced primary evidence ' || c END AS reason FROM rr""")
def recommendation(s, d):
    h = harmonize(s, d).where("fp < 'a'")
    counts = h.groupBy("swc_id").agg(F.count("label").alias("known"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))
    return labels.recommendations(_matrix(s, d), counts)


_HOLDS = "CASE l_returnflag WHEN 'A' THEN ' T ' WHEN 'R' THEN 'f' ELSE 'x' END"


@query("label_columns", f"""SELECT l_orderkey AS k, l_linenumber AS n, 1 AS kind, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 END AS label FROM lineitem UNION ALL
SELECT l_orderkey, l_linenumber, 2, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 END FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 3, CASE WHEN l_linenumber IN (0, 1) THEN l_linenumber::INT END FROM lineitem""")
def label_columns(s, d):
    flag = F.col("l_returnflag")
    holds = F.when(flag == "A", " T ").when(flag == "R", "f").otherwise("x")
    x = read_table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), holds.alias("holds"), F.col("l_linenumber").cast("string").alias("label"))
    kinds = [x.withColumnRenamed("holds", "property_holds").withColumn("property_holds_clean", F.lit("t")), x.withColumnRenamed("holds", "property_holds_clean"), x.drop("holds")]
    parts = [labels.source_label(k).select("k", "n", F.lit(i + 1).alias("kind"), "label") for i, k in enumerate(kinds)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("pair_evidence", f"WITH {P.LABELS_SQL} SELECT fp, swc_id, bool_or(coalesce(label = 1, false)) AS positive, bool_or(coalesce(label = 0, false)) AS negative, CASE WHEN min(label) = max(label) THEN min(label)::INT END AS label, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source)::INT AS n_sources FROM lab GROUP BY fp, swc_id")
def pair_evidence(s, d):
    return labels.pair_evidence(P.labels(s, d)).withColumn("sources", F.array_join("sources", ","))


@query("nested_keys", """WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events), c AS (SELECT key, count(*) AS n FROM k GROUP BY key)
SELECT 0 AS level, key, (SELECT count(*) FROM events) AS n FROM (VALUES ('a'), ('b'), ('c')) v(key) UNION ALL SELECT 1, key, 3 * n FROM c""")
def nested_keys(s, d):
    text = F.concat(F.lit('{"a": '), "props", F.lit(', "b": ['), "props", F.lit(", "), "props", F.lit('], "c": "plain"}'))
    return corpus.key_counts(read_table(s, d, "events").select(text.alias("json")), depth=2)


#: Seven objects in one another, with lists, and lists of lists, in between.
_DEEP_SQL = """deep AS (SELECT ('{"a": {"b": [{"c": {"d": [[' || props || '], [{"e": {"f": {"g": [' || props || ', 1, "x"]}}}]], "k": "{plain"}}, ' || props || ']}, "z": null}')::JSON AS j FROM events)"""


@query("keys_at_any_depth", f"""WITH RECURSIVE {_DEEP_SQL}, lv AS (
  SELECT 0 AS level, NULL::VARCHAR AS key, j, json_type(j) = 'OBJECT' AS o FROM deep
  UNION ALL
  SELECT level + (o::INT), CASE WHEN o THEN (json_keys(j))[i] END, json_extract(j, CASE WHEN o THEN '$."' || (json_keys(j))[i] || '"' ELSE '$[' || (i - 1) || ']' END),
    json_type(json_extract(j, CASE WHEN o THEN '$."' || (json_keys(j))[i] || '"' ELSE '$[' || (i - 1) || ']' END)) = 'OBJECT'
  FROM (SELECT *, unnest(range(1, 1 + CASE WHEN o THEN len(json_keys(j)) ELSE json_array_length(j) END::BIGINT)) AS i FROM lv WHERE json_type(j) IN ('OBJECT', 'ARRAY')))
SELECT level - 1 AS level, key, count(*) AS n FROM lv WHERE key IS NOT NULL GROUP BY ALL""")
def keys_at_any_depth(s, d):
    parts = ('{"a": {"b": [{"c": {"d": [[', '], [{"e": {"f": {"g": [', ', 1, "x"]}}}]], "k": "{plain"}}, ', ']}, "z": null}')
    text = F.concat(F.lit(parts[0]), "props", F.lit(parts[1]), "props", F.lit(parts[2]), "props", F.lit(parts[3]))
    return corpus.key_counts(read_table(s, d, "events").select(text.alias("json")))


@query("member_datasets", "SELECT DISTINCT doc_id % 50 AS fp, source AS dataset FROM documents WHERE doc_id % 4 <> 0 AND trim(coalesce(source, '')) <> ''")
def member_datasets(s, d):
    docs = read_table(s, d, "documents")
    lists = docs.groupBy((F.col("doc_id") % 50).alias("fp")).agg(F.to_json(F.collect_list(F.col("doc_id").cast("string"))).alias("ids"))
    return corpus.member_datasets(lists, docs.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), F.col("source").alias("dataset")))


_WIDE = _HARM + """, k AS (SELECT fp, swc_id, CASE WHEN min(label) = max(label) THEN min(label) END AS label FROM h GROUP BY fp, swc_id),
wide AS (SELECT fp, max(label) FILTER (WHERE swc_id = 101) AS swc_101, max(label) FILTER (WHERE swc_id = 102) AS swc_102, max(label) FILTER (WHERE swc_id = 103) AS swc_103 FROM k GROUP BY fp)"""


@query("label_pivot", f"WITH {_WIDE} SELECT * FROM wide")
def label_pivot(s, d):
    return labels.wide_labels(harmonize(s, d), [101, 102, 103])


@query("label_vector", f"WITH {_WIDE} SELECT fp, [coalesce(swc_101, -1), coalesce(swc_102, -1), coalesce(swc_103, -1)] AS label_vector, [swc_101 IS NOT NULL, swc_102 IS NOT NULL, swc_103 IS NOT NULL] AS label_mask FROM wide")
def label_vector(s, d):
    w = label_pivot(s, d)
    cols = ["swc_101", "swc_102", "swc_103"]
    return w.select("fp", F.array(*[F.coalesce(c, F.lit(-1)) for c in cols]).alias("label_vector"), F.array(*[F.col(c).isNotNull() for c in cols]).alias("label_mask"))


@query("evidence_labels", f"WITH {P.LABELS_SQL}, e AS (SELECT doc_id, bool_or(swc_id = 101 AND label = 1) AS p, bool_or(swc_id = 102 AND label = 1) AS n FROM lab GROUP BY doc_id) SELECT doc_id, CASE WHEN p AND NOT n THEN 1 WHEN n AND NOT p THEN 0 END AS label, CASE WHEN p AND NOT n THEN 1 END AS label_pu FROM e")
def evidence_labels(s, d):
    e = P.labels(s, d).groupBy("doc_id").agg(F.bool_or((F.col("swc_id") == 101) & (F.col("label") == 1)).alias("is_positive_evidence"), F.bool_or((F.col("swc_id") == 102) & (F.col("label") == 1)).alias("is_negative_evidence"))
    a = labels.evidence_labels(e, True)
    b = labels.evidence_labels(e, False).select("doc_id", F.col("label").alias("label_pu"))
    return a.select("doc_id", "label").join(b, "doc_id")


@query("two_tier_lookup", """WITH ex AS (SELECT 'S' || s_suppkey AS id, 'f' || s_nationkey AS fp FROM supplier), lo AS (SELECT lower('S' || (s_suppkey % 7)) AS id, 'g' || (s_suppkey % 7) AS fp FROM supplier UNION ALL SELECT 's3', 'other'),
ke AS (SELECT id, min(fp) AS fp FROM ex GROUP BY id HAVING count(DISTINCT fp) = 1), kl AS (SELECT id, min(fp) AS fp FROM lo GROUP BY id HAVING count(DISTINCT fp) = 1),
t AS (SELECT * FROM ke UNION ALL SELECT * FROM kl WHERE id NOT IN (SELECT id FROM ke)), r AS (SELECT c_custkey, 'S' || (c_custkey % 23) AS id, 's' || (c_custkey % 23) AS low_id FROM customer)
SELECT r.*, coalesce(a.fp, b.fp) AS fp FROM r LEFT JOIN t a ON a.id = r.id LEFT JOIN t b ON b.id = r.low_id""")
def two_tier_lookup(s, d):
    sup = read_table(s, d, "supplier")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    exact = sup.select(name("S", F.col("s_suppkey")).alias("id"), name("f", F.col("s_nationkey")).alias("fp"))
    lower = sup.select(name("s", F.col("s_suppkey") % 7).alias("id"), name("g", F.col("s_suppkey") % 7).alias("fp")).unionByName(s.createDataFrame([("s3", "other")], "id string, fp string"))
    k = F.col("c_custkey") % 23
    rows = read_table(s, d, "customer").select("c_custkey", name("S", k).alias("id"), name("s", k).alias("low_id"))
    return labels.two_tier_lookup(rows, exact, lower).select("c_custkey", "id", "low_id", "fp")


@query("dedup_first", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def dedup_first(s, d):
    return labels.keep_first(read_table(s, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("dictionary_join", "SELECT c_custkey, coalesce(n.n_name, '<UNKNOWN>') AS team FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) n ON n.n_nationkey = c.c_nationkey")
def dictionary_join(s, d):
    n = read_table(s, d, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return read_table(s, d, "customer").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("<UNKNOWN>")).alias("team"))


@query("sample_weights", f"WITH {P.PRED_SQL}, n AS (SELECT label_id, count(*) FILTER (WHERE target = 1) AS pos, count(*) FILTER (WHERE target = 0) AS neg FROM pred GROUP BY label_id) SELECT id, round(greatest(coalesce(max(least(neg / pos, 20.0)) FILTER (WHERE target = 1), 1.0), 1.0), 6)::DOUBLE AS weight FROM pred JOIN n USING (label_id) GROUP BY id")
def sample_weights(s, d):
    from bytequarry.operators import metrics

    return metrics.sample_weights(P.predictions(s, d)).select("id", F.round("weight", 6).alias("weight"))
