"""Queries over bytecode text, fingerprints, merging, splits and feature text."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytequarry.functions import bytecode as B
from bytequarry.operators import corpus, features
from bytequarry.operators.order import positions
from bytequarry.plans import proxies as P
from bytequarry.plans.registry import query
from bytequarry.session import read_table

_STATS = "count({0}) AS n, min({0}) AS min, max({0}) AS max, round(avg({0}), 4) AS mean, round(quantile_cont({0}, 0.5), 4) AS median, round(quantile_cont({0}, 0.95), 4) AS p95, round(quantile_cont({0}, 0.99), 4) AS p99"


@query("length_stats", f"SELECT lang, {_STATS.format('n_chars')} FROM documents GROUP BY lang")
def length_stats(s, d):
    return corpus.length_stats(read_table(s, d, "documents"), F.col("n_chars"), "lang")


@query("histogram40", """WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM documents),
c AS (SELECT least(floor((n_chars - lo) / ((hi - lo) / 40)), 39)::INT AS bin, count(*) AS n FROM documents, e GROUP BY 1)
SELECT g.bin::INT AS bin, floor(lo + g.bin * ((hi - lo) / 40))::BIGINT AS "left", floor(lo + (g.bin + 1) * ((hi - lo) / 40))::BIGINT AS "right", coalesce(c.n, 0) AS n FROM range(40) g(bin) CROSS JOIN e LEFT JOIN c ON c.bin = g.bin""")
def histogram40(s, d):
    return corpus.histogram(read_table(s, d, "documents"), F.col("n_chars"), 40)


_FAIL = "CASE event_id % 6 WHEN 0 THEN 'odd_length_hex' WHEN 1 THEN 'invalid_hex' WHEN 2 THEN 'invalid_hex' ELSE '' END"


def _failures(s, d):
    m = F.col("event_id") % 6
    return read_table(s, d, "events").select("event_type", F.when(m == 0, "odd_length_hex").when(m.isin(1, 2), "invalid_hex").otherwise("").alias("failure_mode"))


@query("top_failure", f"""WITH f AS (SELECT event_type, {_FAIL} AS failure_mode FROM events), m AS (SELECT event_type, failure_mode, count(*) AS c FROM f WHERE failure_mode <> '' GROUP BY ALL),
t AS (SELECT event_type, failure_mode FROM m QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY c DESC, failure_mode) = 1),
n AS (SELECT event_type, count(*) AS processed, count(*) FILTER (WHERE failure_mode = '') AS succeeded FROM f GROUP BY 1)
SELECT n.*, processed - succeeded AS failed, round(succeeded / processed, 6) AS success_rate, coalesce(t.failure_mode, '') AS top_failure FROM n LEFT JOIN t USING (event_type)""")
def top_failure(s, d):
    return corpus.failure_summary(_failures(s, d), "event_type")


@query("failure_modes", f"SELECT failure_mode, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS rate FROM (SELECT {_FAIL} AS failure_mode FROM events) WHERE failure_mode <> '' GROUP BY 1 ORDER BY n DESC, failure_mode LIMIT 20")
def failure_modes(s, d):
    f = _failures(s, d)
    total = f.agg(F.count("*").alias("t"))
    return f.where("failure_mode <> ''").groupBy("failure_mode").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("failure_mode", "n", F.round(F.col("n") / F.col("t"), 6).alias("rate")).orderBy(F.desc("n"), "failure_mode").limit(20)


@query("failure_rates", f"WITH f AS (SELECT event_type, {_FAIL} AS failure_mode FROM events), n AS (SELECT event_type, failure_mode, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT event_type, sum(n) AS rows, sum(n) FILTER (WHERE failure_mode <> '') AS failed FROM n GROUP BY 1) SELECT event_type, failure_mode, n, round(n / rows, 6) AS rate_of_rows, round(n / failed, 6) AS rate_of_failures FROM n JOIN t USING (event_type) WHERE failure_mode <> ''")
def failure_rates(s, d):
    r = corpus.failure_rates(_failures(s, d), "event_type")
    return r.withColumns({c: F.round(c, 6) for c in ("rate_of_rows", "rate_of_failures")})


@query("status_join", """WITH r AS (SELECT nullif(trim(l_orderkey::VARCHAR), '') AS fp, l_linenumber AS row, CASE WHEN l_linestatus = 'O' THEN l_returnflag <> 'R' END AS ok, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber % 2 = 0 THEN ' bad_hex ' ELSE '' END END AS m FROM lineitem WHERE l_orderkey % 9 <> 0),
a AS (SELECT fp, bool_or(coalesce(ok, false)) AS parsed, coalesce(trim(arg_min(m, row) FILTER (WHERE trim(m) <> '')), '') AS failure_mode FROM r GROUP BY fp)
SELECT o_orderkey::VARCHAR AS fp, coalesce(parsed, false) AS parsed, coalesce(failure_mode, 'missing_instruction_rows') AS failure_mode FROM orders LEFT JOIN a ON fp = o_orderkey::VARCHAR""")
def status_join(s, d):
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    rows = read_table(s, d, "lineitem").where("l_orderkey % 9 <> 0").select(F.col("l_orderkey").cast("string").alias("fp"), n.alias("row"), F.when(F.col("l_linestatus") == "O", flag != "R").alias("parse_success"), F.when(flag == "R", F.when(n % 2 == 0, " bad_hex ").otherwise("")).alias("failure_mode"))
    contracts = read_table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("fp"))
    return corpus.with_status(contracts, corpus.instruction_status(rows))


@query("fingerprint", f"WITH {P.CODES_SQL} SELECT fp AS doc_id, sha256(unhex(code)) AS fingerprint FROM codes")
def fingerprint(s, d):
    return P.codes(s, d).select(F.col("fp").alias("doc_id"), B.fingerprint(F.col("code")).alias("fingerprint"))


_RAW = "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' 0x' || upper(md5(text)) || ' ' || chr(10) WHEN 2 THEN 'abc' WHEN 3 THEN 'zz' WHEN 4 THEN 'nan' ELSE substr(md5(text), 1, 7) || 'g' || md5(text) END"
_SQUEEZED = f"regexp_replace(regexp_replace(lower(coalesce({_RAW}, '')), '\\s+', '', 'g'), '^0x', '')"


@query("hex_normalize", f"WITH r AS (SELECT doc_id, {_SQUEEZED} AS h FROM documents), f AS (SELECT *, CASE WHEN h IN ('', 'nan', 'none', 'null') THEN 'missing_runtime_bytecode' WHEN length(h) % 2 = 1 THEN 'odd_length_hex' WHEN NOT regexp_full_match(h, '[0-9a-f]*') THEN 'invalid_hex' ELSE '' END AS failure_mode FROM r) SELECT doc_id, failure_mode, CASE WHEN failure_mode = '' THEN h END AS code FROM f")
def hex_normalize(s, d):
    m, md5 = F.col("doc_id") % 6, F.md5("text")
    raw = F.when(m == 0, F.lit(None)).when(m == 1, F.concat(F.lit(" 0x"), F.upper(md5), F.lit(" \n"))).when(m == 2, "abc").when(m == 3, "zz").when(m == 4, "nan").otherwise(F.concat(F.substring(md5, 1, 7), F.lit("g"), md5))
    return read_table(s, d, "documents").select("doc_id", B.failure(raw).alias("failure_mode"), B.normal(raw).alias("code"))


_META = """m AS (SELECT doc_id, md5(text) || CASE doc_id % 5 WHEN 0 THEN 'a164736f6c63430008130a0009' WHEN 1 THEN 'a264697066735822' || md5(text) || '64736f6c634300081900' || '22' WHEN 2 THEN '61736f6c630005' WHEN 3 THEN 'a1736f6c630005' ELSE '' END AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS size, ('0x' || right(h, 4))::INT AS n FROM m),
b AS (SELECT *, CASE WHEN n > 0 AND n + 2 <= size THEN substr(h, (size - n - 2) * 2 + 1, n * 2) END AS blob FROM n),
k AS (SELECT *, CASE WHEN blob IS NOT NULL AND (('0x' || substr(blob, 1, 2))::INT >> 5) = 5 AND (('0x' || substr(blob, 1, 2))::INT & 31) <= 27 AND regexp_matches(blob, '^(..)*(69706673|627a7a7230|627a7a7231|627a7a72|736f6c63|6578706572696d656e74616c)') THEN n + 2 ELSE 0 END AS cut FROM b)"""


@query("metadata_strip", f"WITH {_META} SELECT doc_id, cut::INT AS metadata_len_bytes, substr(h, 1, length(h) - cut * 2) AS stripped, substr(h, 1, length(h) - cut * 2) || repeat('00', cut) AS zeroed FROM k")
def metadata_strip(s, d):
    m, md5 = F.col("doc_id") % 5, F.md5("text")
    tail = F.when(m == 0, "a164736f6c63430008130a0009").when(m == 1, F.concat(F.lit("a264697066735822"), md5, F.lit("64736f6c63430008190022"))).when(m == 2, "61736f6c630005").when(m == 3, "a1736f6c630005").otherwise("")
    x = read_table(s, d, "documents").select("doc_id", F.concat(md5, tail).alias("h"))
    h = F.col("h")
    return x.select("doc_id", B.metadata_bytes(h).alias("metadata_len_bytes"), B.strip_metadata(h).alias("stripped"), B.strip_metadata(h, True).alias("zeroed"))


@query("collision_stats", f"WITH {P.SOURCES_SQL}, g AS (SELECT fp, count(*) AS n, count(DISTINCT name) AS bodies FROM docs WHERE fp IS NOT NULL GROUP BY fp) SELECT count(*) AS unique_fps, count(*) FILTER (WHERE n > 1) AS dup_groups, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS rows_in_dups, count(*) FILTER (WHERE bodies > 1) AS conflicting_fps FROM g")
def collision_stats(s, d):
    docs = read_table(s, d, "documents").where("length(text) > 0").select(F.sha2(F.col("text"), 256).alias("fp"), F.col("source").alias("body"))
    return corpus.collisions(docs)


_AGG = P.SOURCES_SQL + """, aa AS (SELECT fp, list_sort(list(DISTINCT trim(name))) AS names, coalesce(arg_min(body, doc_id), '') AS body, max(size) AS size, bool_or(flag) AS flag, count(*) AS rows FROM sa WHERE fp IS NOT NULL GROUP BY fp),
ab AS (SELECT fp, list_sort(list(DISTINCT trim(name))) AS names, coalesce(arg_min(body, doc_id), '') AS body, max(size) AS size, bool_or(flag) AS flag, count(*) AS rows FROM sb WHERE fp IS NOT NULL GROUP BY fp)"""


def _aggregates(s, d):
    a, b = P.sources(s, d)
    return corpus.source_aggregate(a, F.col("doc_id")), corpus.source_aggregate(b, F.col("doc_id"))


@query("source_aggregate", f"WITH {_AGG} SELECT fp, array_to_string(names, ',') AS names, md5(trim(body, {chr(39)} {chr(39)} || chr(10) || chr(9) || chr(13))) AS body, size, flag, rows FROM aa")
def source_aggregate(s, d):
    return _aggregates(s, d)[0].withColumns({"names": F.array_join("names", ","), "body": F.md5("body")})


@query("merge_dedup", f"""WITH {_AGG} SELECT coalesce(aa.fp, ab.fp) AS fp, CASE WHEN aa.fp IS NULL THEN 'b' WHEN ab.fp IS NULL THEN 'a' ELSE 'a,b' END AS sources,
md5(trim(coalesce(nullif(aa.body, ''), ab.body), ' ' || chr(10) || chr(9) || chr(13))) AS body, greatest(coalesce(aa.size, 0), coalesce(ab.size, 0)) AS size, coalesce(aa.flag, false) OR coalesce(ab.flag, false) AS flag,
coalesce(array_to_string(aa.names, ','), '') AS a_names, coalesce(array_to_string(ab.names, ','), '') AS b_names, coalesce(aa.rows, 0) + coalesce(ab.rows, 0) AS rows FROM aa FULL JOIN ab ON aa.fp = ab.fp""")
def merge_dedup(s, d):
    m = corpus.merge_sources(*_aggregates(s, d))
    return m.withColumns({"sources": F.array_join("sources", ","), "body": F.md5("body"), "a_names": F.array_join("a_names", ","), "b_names": F.array_join("b_names", ",")})


@query("overlap_counts", f"WITH {P.SOURCES_SQL}, a AS (SELECT DISTINCT fp FROM sa), b AS (SELECT DISTINCT fp FROM sb) SELECT (SELECT count(*) FROM a WHERE fp IN (SELECT fp FROM b)) AS both, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM a WHERE fp NOT IN (SELECT fp FROM b)) AS only_a, (SELECT count(*) FROM b WHERE fp NOT IN (SELECT fp FROM a)) AS only_b, round((SELECT count(*) FROM a WHERE fp IN (SELECT fp FROM b)) / (SELECT count(*) FROM a), 6) AS coverage")
def overlap_counts(s, d):
    return corpus.overlap(*P.sources(s, d), "fp")


@query("source_groups", f"WITH {_AGG} SELECT CASE WHEN aa.fp IS NULL THEN 'dappscan_only' WHEN ab.fp IS NULL THEN 'cgt_only' ELSE 'both' END AS source_group, count(*) AS n FROM aa FULL JOIN ab ON aa.fp = ab.fp GROUP BY 1")
def source_groups(s, d):
    a, b = _aggregates(s, d)
    j = a.select("fp", F.lit(True).alias("a")).join(b.select("fp", F.lit(True).alias("b")), "fp", "full")
    g = corpus.source_group(F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False)))
    return j.groupBy(g.alias("source_group")).agg(F.count("*").alias("n"))


_SPLITS = f"sp AS (SELECT doc_id AS fp, {P.SPLIT_SQL} AS split FROM (SELECT doc_id, {P.split_hash_sql('doc_id')} AS h FROM documents))"


def _splits(s, d):
    return read_table(s, d, "documents").select(F.col("doc_id").alias("fp"), corpus.hash_split(F.col("doc_id")).alias("split"))


@query("hash_split", f"WITH {_SPLITS} SELECT * FROM sp")
def hash_split(s, d):
    return _splits(s, d)


@query("split_order", f"WITH {_SPLITS} SELECT fp, split, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, fp) AS position FROM sp")
def split_order(s, d):
    rank = F.array_position(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("split"))
    return positions(_splits(s, d).withColumn("rank", rank), ["rank", "fp"]).select("fp", "split", (F.col("i") + 1).alias("position"))


@query("split_label_stats", f"""WITH {_SPLITS}, l AS (SELECT doc_id AS fp, 101 AS swc_id, quality AS label FROM labels UNION ALL SELECT doc_id, 102, toxic FROM labels), j AS (SELECT * FROM l JOIN sp USING (fp))
SELECT swc_id, split, count(label) AS known, count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative FROM j GROUP BY swc_id, split
UNION ALL SELECT swc_id, 'all', count(label), count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 0) FROM j GROUP BY swc_id""")
def split_label_stats(s, d):
    lab = P.labels(s, d).select(F.col("doc_id").alias("fp"), "swc_id", "label")
    return corpus.split_label_stats(lab, _splits(s, d))


@query("leave_one_out", "WITH m AS (SELECT doc_id % 500 AS id, source AS dataset FROM documents), t AS (SELECT DISTINCT id FROM m WHERE dataset = 'src0') SELECT id, 'test' AS part FROM t UNION ALL SELECT DISTINCT id, 'train' FROM m WHERE id NOT IN (SELECT id FROM t)")
def leave_one_out(s, d):
    m = read_table(s, d, "documents").select((F.col("doc_id") % 500).alias("id"), F.col("source").alias("dataset"))
    return corpus.leave_one_out(m, "src0")


@query("variants", f"""WITH {_SPLITS}, i AS (SELECT sp.*, n_chars < 300 AS is_stub, doc_id % 11 = 0 AS is_proxy, doc_id % 3 <> 1 AS has_a, doc_id % 7 = 0 AS has_positive FROM sp JOIN documents ON doc_id = fp WHERE n_chars >= 300),
v AS (SELECT 'clean_default' AS variant, split FROM i UNION ALL SELECT 'no_proxy', split FROM i WHERE NOT is_proxy UNION ALL SELECT 'cgt_only', split FROM i WHERE has_a UNION ALL SELECT 'combined_posaug', split FROM i WHERE has_a OR has_positive)
SELECT variant, split, count(*) AS n FROM v GROUP BY ALL""")
def variants(s, d):
    x = read_table(s, d, "documents").select(F.col("doc_id").alias("fp"), (F.col("n_chars") < 300).alias("is_stub"), (F.col("doc_id") % 11 == 0).alias("is_proxy"), (F.col("doc_id") % 3 != 1).alias("has_a"), (F.col("doc_id") % 7 == 0).alias("has_positive"))
    return corpus.variants(x.join(_splits(s, d), "fp"))


@query("set_alignment", "(SELECT DISTINCT c_nationkey AS k, 'left_only' AS side FROM customer WHERE c_nationkey < 20 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey > 6) ORDER BY k LIMIT 10) UNION ALL (SELECT DISTINCT s_nationkey, 'right_only' FROM supplier WHERE s_nationkey > 6 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 20) ORDER BY 1 LIMIT 10)")
def set_alignment(s, d):
    c, p = read_table(s, d, "customer").select(F.col("c_nationkey").alias("k")), read_table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return corpus.set_difference(c.where("k < 20"), p.where("k > 6"), "k")


@query("stable_sample", "SELECT doc_id FROM documents ORDER BY sha256('0|' || doc_id), doc_id LIMIT 25")
def stable_sample(s, d):
    return corpus.stable_sample(read_table(s, d, "documents").select("doc_id"), "doc_id", 25)


_SHORT = "short AS ()"
_TERMS = _SHORT + r""", w AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}') AS w FROM short),
tk AS (SELECT id, unnest(w) AS term FROM w UNION ALL SELECT id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM w),
tf AS (SELECT id, term, count(*) AS tf FROM tk GROUP BY ALL), tr AS (SELECT id FROM short WHERE id % 10 < 8),
vo AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf WHERE id IN (SELECT id FROM tr) GROUP BY term ORDER BY total DESC, term LIMIT 500),
vi AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, ln((1.0 + (SELECT count(*) FROM tr)) / (1 + df)) + 1 AS idf FROM vo),
rw AS (SELECT id, idx, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vi USING (term)), nm AS (SELECT id, sqrt(sum(w * w)) AS n FROM rw GROUP BY id)"""


def _words(s, d):
    return read_table(s, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace(F.lower("text"), "[^a-z0-9_]+", " ").alias("text"))


_ALL = _TERMS.replace(_SHORT, "short AS (SELECT doc_id AS id, regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g') AS text FROM documents)")
@query("tfidf", f"WITH {_ALL} SELECT id, idx::INT AS idx, term, round(w / n, 6) AS weight FROM rw JOIN nm USING (id)")
def tfidf(s, d):
    t = features.tfidf(_words(s, d), F.col("id") % 10 < 8)
    return t.select("id", "idx", "term", F.round("weight", 6).alias("weight"))


@query("vocabulary", f"WITH {_ALL} SELECT term, idx::INT AS idx, round(idf, 6) AS idf FROM vi")
def vocabulary(s, d):
    return features.vocabulary(_words(s, d).where("id % 10 < 8")).select("term", "idx", F.round("idf", 6).alias("idf"))


@query("merge_flagship_sizes", f"WITH {_AGG} SELECT greatest(coalesce(aa.size, 0), coalesce(ab.size, 0)) // 1000 AS kb, count(*) AS n FROM aa FULL JOIN ab ON aa.fp = ab.fp GROUP BY 1")
def merge_flagship_sizes(s, d):
    return merge_dedup(s, d).groupBy(F.floor(F.col("size") / 1000).alias("kb")).agg(F.count("*").alias("n"))
