"""The opN_<name> queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytequarry.llm import ann, centroids, license_scan, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, secret_scan, source_divergence, suffix_dedup, url_filters


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its rule features and verdict."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.score_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
_BASE = " OR ".join(f"({c})" for _, base, c in quality_rules.RULES if base)
_REST = " OR ".join(f"({c})" for _, base, c in quality_rules.RULES if not base)

OP1_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g),
r AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM c WHERE c > 1) GROUP BY rid),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         len(list_filter(w, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({_BASE}) AS base_failed, NOT ({_BASE} OR {_REST}) AS kept
FROM f
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, from a network fitted outside the held-out fold."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    sample = quality_classifier.labelled(docs, _read(spark, sf_dir, "labels"))
    model = quality_classifier.fit(sample["text"].tolist(), sample["label"].tolist())
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: The rules of the contract, longest first wins.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return url_filters.judge(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20."""
    return ann.nearest(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the strings that start in an earlier one."""
    return suffix_dedup.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)


#: Bytes as hex digits: two for each, so a string of 50 bytes has 100; texts are cut into overlapping pieces first.
OP5_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
b AS (SELECT doc_id, 512 * b AS base, substr(h, 1024 * b + 1, 1122) AS h FROM (SELECT doc_id, h, unnest(range((n + 462) // 512)) AS b FROM d WHERE n >= 50)),
s AS (SELECT doc_id, base + j AS i, substr(h, 2 * j + 1, 100) AS s FROM (SELECT *, unnest(range(length(h) // 2 - 49)) AS j FROM b)),
m AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s),
g AS (SELECT doc_id, i FROM s JOIN m USING (s) WHERE first < doc_id),
e AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM g),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
p AS (SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, hi AS lo, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS hi FROM p UNION ALL SELECT doc_id, 0, min(lo) FROM p GROUP BY doc_id),
c AS (SELECT k.doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, n) - lo)), '' ORDER BY lo) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id),
x AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM p GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern spans and random-looking runs of every document."""
    scan = secret_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return scan.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.listed("assign", "access", "hex"), 256).alias("base_sha256"),
        secret_scan.listed(*secret_scan.KINDS).alias("spans"),
    )


def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern spans alone of :func:`op6_secret_scan`."""
    return op6_secret_scan(spark, sf_dir).drop("spans")


_PLACED = """SELECT rid, '{kind}' AS kind, {order} AS o, start, start + length(m[i]) AS stop FROM (
    SELECT rid, m, v, i, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}') AS m, {value} AS v FROM d))) WHERE {cond}"""
_KINDS = [("assign", secret_scan.ASSIGN, "length(v[i]) >= 6"), ("access", secret_scan.ACCESS, "true"), ("hex", secret_scan.HEX, "true")]


def _placed(order: int, kind: str, pattern: str, cond: str) -> str:
    p = pattern.replace("'", "''")
    value = f"regexp_extract_all(t, '{p}', 1)" if kind == "assign" else "[]::VARCHAR[]"
    # without a capturing group, so that splits return gaps only
    return _PLACED.format(kind=kind, order=order, pattern=p.replace("([A-Za-z0-9+/_.=-]+)", "(?:[A-Za-z0-9+/_.=-]+)"), value=value, cond=cond)


SECRET_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_placed(i, *k) for i, k in enumerate(_KINDS))}),
g AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (rid)
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.copies(docs).select(
        "doc_id",
        F.col("_m_size").alias("size"),
        F.col("_m_source_size").alias("source_size"),
        F.col("_m_target").alias("target"),
        (F.col("_m_copies") * F.col("_m_size")).cast("long").alias("taken"),
    )


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % greatest({mixing.BUCKETS}, (SELECT ceil(count(*) / {mixing.BUCKET_ROWS}.0)::BIGINT FROM documents)), 0) AS bucket FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY (source IS NULL)::INT, coalesce(source, '')) - 1) % 3] AS w,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s0),
s2 AS (
  SELECT *, row_number() OVER o AS k,
         (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s1 WINDOW o AS (ORDER BY cap / w, (source IS NULL)::INT, coalesce(source, ''))),
s3 AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, k) FROM s2 WHERE level * w <= cap) * w), cap) AS target,
         ('0x' || substr(md5('mix|' || (source IS NULL)::INT || '|' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM s2),
r AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source
           ORDER BY CASE WHEN size > 0 THEN 8 * length(bin(size)) + (size >> greatest(length(bin(size)) - 3, 0)::INT) ELSE 0 END, bucket, size, doc_id NULLS FIRST) AS k FROM d)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size > 0 THEN ((floor(k * (target / source_size) + draw) - floor((k - 1) * (target / source_size) + draw)) * size)::BIGINT ELSE 0 END AS taken
FROM r JOIN s3 ON r.source IS NOT DISTINCT FROM s3.source
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), **packing.default_vocabulary())


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its near-duplicate component."""
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and score of every document."""
    return license_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases alone of :func:`op10_license_scan`."""
    return op10_license_scan(spark, sf_dir).drop("labels", "score")


def _phrase_sql(phrase: str, label: str) -> str:
    ws = phrase.split()
    return f"SELECT rid, i - 1 AS i, '{label}' AS label FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(ws))


LICENSE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS ({" UNION ALL ".join(_phrase_sql(*x) for x in license_scan.PHRASES)}),
g AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (rid)
"""


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector with its cluster after ten rounds, and a digest of the cluster's centroid."""
    found = centroids.cluster(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def _centroid_sql(rounds: int = 10) -> str:
    """The rounds one after the other; ``//`` cuts towards zero, so floors come from the remainder."""
    near = """a{r} AS MATERIALIZED (
  SELECT rid, vec_id, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT, j := j)) AS m FROM x, c{r} GROUP BY ALL)"""
    move = """s{r} AS (SELECT m.j AS j, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM (SELECT m, v, unnest(range(1, 65)) AS i FROM a{b}) GROUP BY ALL),
c{r} AS MATERIALIZED (SELECT c{b}.j, coalesce(f.c, c{b}.c) AS c FROM c{b} LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY j) f USING (j))"""
    steps = [near.format(r=0)] + [s for r in range(1, rounds + 1) for s in (move.format(r=r, b=r - 1), near.format(r=r))]
    return f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS j, v AS c FROM x ORDER BY sha256('3:' || vec_id), v LIMIT 8),
{", ".join(steps)}
SELECT vec_id, m.j::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.j))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON m.j = c{rounds}.j"""


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of lines and of dropped ones, and a digest of the rest."""
    found = line_dedup.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS MATERIALIZED (
  SELECT rid, doc_id, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d)),
f AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT rid) >= 5),
m AS (SELECT k.*, f.k IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM k LEFT JOIN f ON k.k = f.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of every two sources of a language, and the terms that set each apart from its language."""
    return source_divergence.audit(_read(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, lang, source, unnest(t) AS t FROM d),
k AS MATERIALIZED (SELECT lang, t FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, t, count(*) AS c FROM w SEMI JOIN k USING (lang, t) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, coalesce(sum(c), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, sum(n)::BIGINT AS n FROM g GROUP BY lang),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.t, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2) // (n + 2 * v)) AS p
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
q AS (SELECT lang, t, 1 + (1000000000::HUGEINT * (sum(c) + 2) // (any_value(l.n) + 2 * any_value(v))) AS q FROM p JOIN l USING (lang) JOIN v USING (lang) GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, t) WHERE a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'term' AS part, t AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM y UNION ALL SELECT * FROM z) QUALIFY part = 'pair' OR rank <= 10
"""


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_url_filters": op3_url_filters,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_ngram_join": op9_ngram_join,
    "op10_license_scan": op10_license_scan,
    "op11_centroids": op11_centroids,
    "op12_line_dedup": op12_line_dedup,
    "op13_source_divergence": op13_source_divergence,
    "secret_patterns": secret_patterns,
    "license_phrases": license_phrases,
}
ORACLES = {
    "op1_quality_rules": OP1_SQL,
    "op5_suffix_dedup": OP5_SQL,
    "op9_ngram_join": OP9_SQL,
    "secret_patterns": SECRET_SQL,
    "license_phrases": LICENSE_SQL,
    "op7_mixing": OP7_SQL,
    "op11_centroids": _centroid_sql(),
    "op12_line_dedup": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
