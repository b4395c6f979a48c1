"""Queries over instructions, blocks, flow graphs and opcode features."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytequarry.functions import bytecode as B
from bytequarry.functions import evm
from bytequarry.operators import features, graphs
from bytequarry.operators.steps import written
from bytequarry.plans import proxies as P
from bytequarry.plans.registry import query

_NAMES = "ops(opcode_id, opcode) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, (n, _, _) in evm.instruction_set().items()) + ")"
_TERMINAL = ", ".join(f"'{t}'" for t in evm.TERMINAL)


def _ins_sql(view: str, name: str) -> str:
    """Linear sweep as a recursive query over ``view``."""
    return f"""{view}, {_NAMES}, walk AS (
  SELECT fp, code, 0 AS pc, ('0x' || substr(code, 1, 2))::INT AS op FROM {name}
  UNION ALL
  SELECT fp, code, n, ('0x' || substr(code, 2 * n + 1, 2))::INT FROM (
    SELECT fp, code, pc + 1 + CASE WHEN op BETWEEN 96 AND 127 THEN op - 95 ELSE 0 END AS n FROM walk) WHERE 2 * n < length(code)),
ins0 AS (SELECT fp, pc, op AS opcode_id, opcode, CASE WHEN op BETWEEN 96 AND 127 THEN substr(code, 2 * pc + 3, 2 * (op - 95)) ELSE '' END AS push_data FROM walk JOIN ops ON opcode_id = op),
ins1 AS (SELECT *, 1 + length(push_data) // 2 AS size, CASE WHEN opcode = 'JUMPDEST' OR coalesce(lag(opcode) OVER (PARTITION BY fp ORDER BY pc) IN ({_TERMINAL}), true) THEN 1 ELSE 0 END AS s FROM ins0),
ins AS (SELECT fp, pc, opcode, opcode_id, push_data, size, (sum(s) OVER (PARTITION BY fp ORDER BY pc) - 1)::INT AS basic_block_id FROM ins1)"""


_CODE_INS, _PROG_INS = _ins_sql(P.CODES_SQL, "codes"), _ins_sql(P.PROGRAMS_SQL, "programs")


def _code_ins(s, d):
    return evm.disassemble(P.codes(s, d), blocks=True).withColumn("fp", F.col("fp").cast("long"))


def _prog_ins(s, d):
    return evm.disassemble(P.programs(s, d), blocks=True).withColumn("fp", F.col("fp").cast("long"))


def _prog_once(s, d):
    """The programs' instructions as a written step, for plans that read them more than once."""
    return written(_prog_ins(s, d), "instructions")


@query("disassemble", f"WITH RECURSIVE {_CODE_INS} SELECT fp, pc, opcode, opcode_id, push_data, size::INT AS size, basic_block_id FROM ins")
def disassemble(s, d):
    return _code_ins(s, d)


_BLOCKS = f"""blocks AS (SELECT fp, basic_block_id, min(pc) AS start_pc, max(pc) AS end_pc, count(*) AS instruction_count, arg_min(opcode, pc) = 'JUMPDEST' AS starts_with_jumpdest,
  arg_max(opcode, pc) IN ({_TERMINAL}) AS ends_with_terminal, arg_max(opcode, pc) AS end_opcode FROM ins GROUP BY fp, basic_block_id)"""


@query("basic_blocks", f"WITH RECURSIVE {_PROG_INS}, {_BLOCKS} SELECT * FROM blocks")
def basic_blocks(s, d):
    return graphs.block_summary(_prog_ins(s, d))


@query("basic_blocks_random", f"WITH RECURSIVE {_CODE_INS}, {_BLOCKS} SELECT * FROM blocks")
def basic_blocks_random(s, d):
    return graphs.block_summary(_code_ins(s, d))


_CFG = _BLOCKS + """, nb AS (SELECT *, lead(start_pc) OVER (PARTITION BY fp ORDER BY basic_block_id) AS nxt FROM blocks),
jm AS (SELECT fp, basic_block_id, opcode, lag(opcode) OVER w AS prev, lag(push_data) OVER w AS data FROM ins WINDOW w AS (PARTITION BY fp, basic_block_id ORDER BY pc)),
jt AS (SELECT fp, basic_block_id, ('0x' || data)::BIGINT AS target FROM jm WHERE opcode IN ('JUMP', 'JUMPI') AND prev LIKE 'PUSH%' AND prev <> 'PUSH0' AND length(ltrim(data, '0')) <= 8 AND data <> ''),
cfg AS (SELECT b.fp, b.start_pc AS src, t.start_pc AS dst, CASE WHEN b.end_opcode = 'JUMP' THEN 'jump' ELSE 'jumpi_true' END AS edge_type
  FROM nb b JOIN jt USING (fp, basic_block_id) JOIN nb t ON t.fp = b.fp AND t.start_pc = jt.target
  UNION ALL SELECT fp, start_pc, nxt, CASE WHEN end_opcode = 'JUMPI' THEN 'jumpi_false' ELSE 'fallthrough' END FROM nb
  WHERE nxt IS NOT NULL AND end_opcode NOT IN ('JUMP', 'STOP', 'RETURN', 'REVERT', 'INVALID', 'SELFDESTRUCT'))"""


@query("cfg_fallback", f"WITH RECURSIVE {_PROG_INS}, {_CFG} SELECT * FROM cfg")
def cfg_fallback(s, d):
    return graphs.fallback_cfg(_prog_once(s, d))


_IEDGES = _CFG + ", ie AS (SELECT DISTINCT c.fp, coalesce(b.end_pc, c.src) AS src, c.dst, c.edge_type FROM cfg c LEFT JOIN blocks b ON b.fp = c.fp AND b.start_pc = c.src WHERE (c.fp, c.dst) IN (SELECT (fp, pc) FROM ins))"


def _iedges(s, d):
    ins = _prog_once(s, d)
    return ins, graphs.instruction_edges(ins, graphs.fallback_cfg(ins))


@query("cfg_instr_edges", f"WITH RECURSIVE {_PROG_INS}, {_IEDGES} SELECT * FROM ie")
def cfg_instr_edges(s, d):
    return _iedges(s, d)[1]


@query("edge_type_counts", f"WITH RECURSIVE {_PROG_INS}, {_CFG} SELECT edge_type, count(*) AS n FROM cfg GROUP BY 1")
def edge_type_counts(s, d):
    return graphs.edges_by_type(graphs.fallback_cfg(_prog_once(s, d)))


@query("invalid_edges", f"WITH RECURSIVE {_PROG_INS}, {_CFG}, e AS (SELECT fp, CASE WHEN src % 5 <> 0 THEN src END AS src, CASE WHEN dst % 7 <> 0 THEN dst END AS dst, CASE WHEN edge_type = 'jump' AND src % 2 = 0 THEN 'leap' WHEN src % 11 = 0 THEN NULL ELSE edge_type END AS edge_type FROM cfg) SELECT * FROM e WHERE src IS NULL OR dst IS NULL OR edge_type IS NULL OR edge_type = 'leap'")
def invalid_edges(s, d):
    src, dst, kind = F.col("src"), F.col("dst"), F.col("edge_type")
    spoilt = F.when((kind == "jump") & (src % 2 == 0), "leap").when(src % 11 == 0, F.lit(None)).otherwise(kind)
    e = graphs.fallback_cfg(_prog_once(s, d)).select("fp", F.when(src % 5 != 0, src).alias("src"), F.when(dst % 7 != 0, dst).alias("dst"), spoilt.alias("edge_type"))
    return graphs.invalid_edges(e)


_NODES = "nodes AS (SELECT fp, row_number() OVER (PARTITION BY fp ORDER BY pc) - 1 AS node, pc, opcode_id, basic_block_id AS bb FROM ins)"


@query("node_table", f"WITH RECURSIVE {_PROG_INS}, {_NODES} SELECT fp, node::INT AS node, pc, opcode_id, bb FROM nodes")
def node_table(s, d):
    return graphs.node_table(_prog_ins(s, d))


_REINDEX = _IEDGES + ", " + _NODES + ", re AS (SELECT DISTINCT e.fp, a.node AS s, b.node AS t, CASE edge_type WHEN 'fallthrough' THEN 0 WHEN 'jump' THEN 1 WHEN 'jumpi_true' THEN 2 WHEN 'jumpi_false' THEN 3 END AS type_id FROM ie e JOIN nodes a ON a.fp = e.fp AND a.pc = e.src JOIN nodes b ON b.fp = e.fp AND b.pc = e.dst)"


@query("graph_reindex", f"WITH RECURSIVE {_PROG_INS}, {_REINDEX} SELECT fp, s::INT AS s, t::INT AS t, type_id FROM re")
def graph_reindex(s, d):
    ins, e = _iedges(s, d)
    return graphs.reindex(graphs.node_table(ins), e)


#: The abstract stack as a recursive query: the state before each instruction of each block, then the edges that it gives.
_EFFECTS = "effects(o, pops, pushes) AS (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (n, a, b) in evm.instruction_set().items()) + ")"
_VALUE = "STRUCT(p INT[], v VARCHAR)"
_WRITES = lambda names, state, other: f"""CASE WHEN opcode IN ({names}) THEN CASE WHEN s[1].v IS NULL THEN MAP {{}} ELSE map_concat({state}, MAP {{s[1].v: pc}}) END WHEN opcode IN ({other}) THEN MAP {{}} ELSE {state} END"""
_ALL_EFFECTS = ", ".join(f"'{x}'" for x in graphs.EFFECTS)
_FLOW = f"""{_EFFECTS},
li AS (SELECT fp, basic_block_id AS bb, row_number() OVER (PARTITION BY fp, basic_block_id ORDER BY pc) AS k, min(pc) OVER (PARTITION BY fp, basic_block_id) AS src, pc, opcode, o, push_data, pops, pushes FROM ins JOIN effects ON o = opcode_id),
fw AS (
  SELECT fp, bb, 1::BIGINT AS k, []::{_VALUE}[] AS s, MAP {{}}::MAP(VARCHAR, INT) AS st, MAP {{}}::MAP(VARCHAR, INT) AS me FROM li WHERE k = 1
  UNION ALL
  SELECT fp, bb, k + 1,
    CASE WHEN opcode LIKE 'PUSH%' THEN list_prepend({{'p': [pc], 'v': CASE WHEN o = 95 THEN '0' WHEN push_data = '' THEN NULL ELSE coalesce(nullif(ltrim(push_data, '0'), ''), '0') END}}::{_VALUE}, s)
         WHEN o BETWEEN 128 AND 143 THEN list_prepend(coalesce(s[o - 127], {{'p': [], 'v': NULL}}::{_VALUE}), s)
         WHEN o BETWEEN 144 AND 159 THEN CASE WHEN len(s) > o - 143 THEN list_concat([s[o - 142]], s[2:o - 143], [s[1]], s[o - 141:]) ELSE s END
         ELSE list_concat(list_transform(range(pushes), lambda x: {{'p': [pc], 'v': NULL}}::{_VALUE}), s[pops + 1:]) END,
    {_WRITES("'SSTORE'", "st", _ALL_EFFECTS)}, {_WRITES("'MSTORE', 'MSTORE8'", "me", _ALL_EFFECTS + ", " + ", ".join(f"'{x}'" for x in graphs.COPIES))}
  FROM fw JOIN li USING (fp, bb, k) WHERE opcode NOT LIKE 'UNKNOWN%'),
fx AS (SELECT fp, src, pc, opcode, o, s, st, me, CASE WHEN opcode LIKE 'PUSH%' OR o BETWEEN 144 AND 159 OR opcode LIKE 'UNKNOWN%' THEN [] WHEN o BETWEEN 128 AND 143 THEN s[o - 127:o - 127] ELSE s[1:pops] END AS used FROM fw JOIN li USING (fp, bb, k)),
fb AS (SELECT fp, src, list(dst) FILTER (edge_type = 'jumpi_true') AS a, list(dst) FILTER (edge_type = 'jumpi_false') AS b FROM cfg GROUP BY fp, src),
fe AS (
  SELECT fp, unnest(list_distinct(flatten(list_transform(used, lambda x: x.p)))) AS src, pc AS dst, 'stack_flow' AS edge_type, NULL::VARCHAR AS storage_slot, NULL::VARCHAR AS memory_offset FROM fx
  UNION SELECT fp, st[s[1].v], pc, 'storage_flow', s[1].v, NULL FROM fx WHERE opcode = 'SLOAD' AND s[1].v IS NOT NULL AND st[s[1].v] IS NOT NULL
  UNION SELECT fp, me[s[1].v], pc, 'memory_flow', NULL, s[1].v FROM fx WHERE opcode = 'MLOAD' AND s[1].v IS NOT NULL AND me[s[1].v] IS NOT NULL
  UNION SELECT fp, p, unnest(list_concat(a, b)), 'control_dependency', NULL, NULL FROM (SELECT fp, a, b, unnest(used[2].p) AS p FROM fx JOIN fb USING (fp, src) WHERE opcode = 'JUMPI' AND a IS NOT NULL AND b IS NOT NULL))"""
_GRAPH = f"{_FLOW}, alle AS (SELECT fp, src, dst, edge_type, true AS c FROM ie UNION ALL SELECT fp, src, dst, edge_type, false FROM fe)"

_COUNTS = f"{_GRAPH}, gc AS (SELECT n.fp, nodes, blocks, coalesce(e, 0) AS cfg_edges, coalesce(f, 0) AS dfg_edges, coalesce(e + f, 0) AS total_edges FROM (SELECT fp, count(DISTINCT pc) AS nodes, count(DISTINCT basic_block_id) AS blocks FROM ins GROUP BY fp) n LEFT JOIN (SELECT fp, count(*) FILTER (c) AS e, count(*) FILTER (NOT c) AS f FROM alle GROUP BY fp) x ON x.fp = n.fp)"


def _graph_edges(s, d):
    """Instructions and all edges of the programs' graphs: control flow, and data flow between nodes."""
    ins = _prog_once(s, d)
    cfg = written(graphs.fallback_cfg(ins), "cfg")
    flow = graphs.flow_edges(ins, graphs.data_flow(ins, cfg).withColumn("fp", F.col("fp").cast("long")))
    return ins, graphs.instruction_edges(ins, cfg).unionByName(flow.select("fp", "src", "dst", "edge_type"))


@query("graph_counts", f"WITH RECURSIVE {_PROG_INS}, {_IEDGES}, {_COUNTS} SELECT * FROM gc")
def graph_counts(s, d):
    return graphs.graph_counts(*_graph_edges(s, d))


@query("graph_edge_types", f"WITH RECURSIVE {_PROG_INS}, {_IEDGES}, {_GRAPH} SELECT edge_type, count(*) AS n FROM alle GROUP BY 1")
def graph_edge_types(s, d):
    return graphs.edges_by_type(_graph_edges(s, d)[1])


@query("control_edges", f"WITH RECURSIVE {_PROG_INS}, {_IEDGES}, {_GRAPH} SELECT fp, src, dst, edge_type FROM alle WHERE c")
def control_edges(s, d):
    return graphs.control_edges(_graph_edges(s, d)[1])


@query("unresolved_jumps", f"WITH RECURSIVE {_PROG_INS}, {_CFG} SELECT fp, count(*) AS jumps, count(*) FILTER (WHERE (fp, start_pc) NOT IN (SELECT (fp, src) FROM cfg WHERE edge_type IN ('jump', 'jumpi_true'))) AS unresolved FROM blocks WHERE end_opcode IN ('JUMP', 'JUMPI') GROUP BY fp")
def unresolved_jumps(s, d):
    ins = _prog_once(s, d)
    return graphs.unresolved_jumps(ins, graphs.fallback_cfg(ins))


_INDEX_SQL = f"""oc AS (SELECT fp, count(*) AS opcode_token_count, count(*) FILTER (WHERE opcode IN ({", ".join(f"'{c}'" for c in evm.CALLS)})) / count(*) AS call_like_ratio, count(*) FILTER (WHERE opcode = 'DELEGATECALL') / count(*) AS delegatecall_ratio FROM ins WHERE fp % 7 <> 0 GROUP BY fp),
gf AS (SELECT gc.*, fp % 2 = 0 AS has_cgt, CASE WHEN fp % 5 <> 0 THEN fp % 3 = 0 END AS has_dappscan, length(code) // 2 < 100 AS is_stub_like FROM gc JOIN programs USING (fp))"""


@query("graph_features", f"""WITH RECURSIVE {_PROG_INS}, {_IEDGES}, {_COUNTS}, {_INDEX_SQL}
SELECT fp, nodes::DOUBLE AS gf_node_count, blocks::DOUBLE AS gf_basic_block_count, cfg_edges::DOUBLE AS gf_cfg_edge_count, dfg_edges::DOUBLE AS gf_dfg_edge_count, total_edges::DOUBLE AS gf_edge_count_total,
round(CASE WHEN nodes > 0 THEN total_edges / nodes ELSE 0 END, 6) AS gf_avg_edges_per_node, round(CASE WHEN total_edges > 0 THEN cfg_edges / total_edges ELSE 0 END, 6) AS gf_cfg_edge_ratio, round(CASE WHEN total_edges > 0 THEN dfg_edges / total_edges ELSE 0 END, 6) AS gf_dfg_edge_ratio,
round(coalesce(delegatecall_ratio, 0), 6) AS gf_delegatecall_ratio, round(coalesce(call_like_ratio, 0), 6) AS gf_call_like_ratio, coalesce(opcode_token_count, 0)::DOUBLE AS gf_opcode_token_count,
has_cgt::INT::DOUBLE AS gf_has_cgt, coalesce(has_dappscan, false)::INT::DOUBLE AS gf_has_dappscan, 0::DOUBLE AS gf_is_proxy_like, is_stub_like::INT::DOUBLE AS gf_is_stub_like,
(nodes > 0)::INT::DOUBLE AS gf_graph_build_success, (cfg_edges > 0)::INT::DOUBLE AS gf_cfg_success, (dfg_edges > 0)::INT::DOUBLE AS gf_dfg_success, (opcode_token_count IS NOT NULL)::INT::DOUBLE AS gf_opcode_text_available
FROM gf LEFT JOIN oc USING (fp)""")
def graph_features(s, d):
    ins, edges = _graph_edges(s, d)
    flags = P.programs(s, d).select("fp", (F.col("fp") % 2 == 0).alias("has_cgt"), F.when(F.col("fp") % 5 != 0, F.col("fp") % 3 == 0).alias("has_dappscan"), B.is_stub_like(F.col("code")).alias("is_stub_like"), B.is_minimal_proxy(F.col("code")).alias("is_proxy_like"))
    counts = graphs.graph_counts(ins, edges)
    index = counts.join(flags, "fp").withColumns({"graph_build_success": F.col("nodes") > 0, "cfg_success": F.col("cfg_edges") > 0, "dfg_success": F.col("dfg_edges") > 0})
    # contracts without opcode text stay, with zeros
    corpus = features.call_ratios(ins.where("fp % 7 <> 0")).select("fp", "call_like_ratio", "delegatecall_ratio", F.col("opcode_count").alias("opcode_token_count"), F.lit(True).alias("opcode_text_available"))
    g = features.graph_features(index, corpus)
    return g.select("fp", *[F.round(c, 6).alias(c) for c in g.columns if c != "fp"])


@query("graph_labels", f"WITH RECURSIVE {_PROG_INS}, {_IEDGES}, {_COUNTS}, lc AS (SELECT fp, count(*) FILTER (WHERE l = 1) AS label_positive_count, count(l) AS label_assessed_count FROM (SELECT l_suppkey AS fp, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 END AS l FROM lineitem) GROUP BY fp) SELECT gc.*, coalesce(label_positive_count, 0) AS label_positive_count, coalesce(label_assessed_count, 0) AS label_assessed_count FROM gc LEFT JOIN lc USING (fp)")
def graph_labels(s, d):
    flag = F.col("l_returnflag")
    labels = P.read_table(s, d, "lineitem").select(F.col("l_suppkey").alias("fp"), F.when(flag == "A", 1).when(flag == "R", 0).alias("label"))
    return graphs.with_label_counts(graphs.graph_counts(*_graph_edges(s, d)), labels)


_ROWS_SQL = "rows0 AS (SELECT l_orderkey AS fp, l_linenumber AS \"row\", l_returnflag <> 'R' AS parse_success, CASE WHEN l_linestatus = 'O' THEN l_linenumber END AS pc, CASE WHEN l_returnflag = 'R' THEN CASE l_linenumber % 3 WHEN 0 THEN 'odd_length' WHEN 1 THEN ' non_hex ' ELSE '' END END AS failure_mode FROM lineitem)"


@query("dfg_status", f"""WITH {_ROWS_SQL}, c AS (SELECT o_orderkey AS fp FROM orders UNION ALL SELECT o_orderkey + 1000000000 FROM orders),
a AS (SELECT fp, bool_or(coalesce(parse_success, false) AND pc IS NOT NULL) AS ok, arg_min(nullif(trim(failure_mode), ''), "row") FILTER (WHERE trim(failure_mode) <> '') AS m FROM rows0 GROUP BY fp)
SELECT c.fp, coalesce(ok, false) AS dfg_success, CASE WHEN ok IS NULL THEN 'missing_instruction_rows' WHEN ok THEN '' ELSE coalesce(m, 'instruction_parse_failed') END AS failure_mode FROM c LEFT JOIN a USING (fp)""")
def dfg_status(s, d):
    n = F.col("l_linenumber")
    bad = F.when(n % 3 == 0, "odd_length").when(n % 3 == 1, " non_hex ").otherwise("")
    rows = P.read_table(s, d, "lineitem").select(F.col("l_orderkey").alias("fp"), n.alias("row"), (F.col("l_returnflag") != "R").alias("parse_success"), F.when(F.col("l_linestatus") == "O", n).alias("pc"), F.lit(0).alias("opcode_id"), F.when(F.col("l_returnflag") == "R", bad).alias("failure_mode"))
    orders = P.read_table(s, d, "orders").select(F.col("o_orderkey").alias("fp"))
    return graphs.flow_status(orders.unionByName(orders.select((F.col("fp") + 1000000000).alias("fp"))), rows)


@query("batch_offsets", f"WITH RECURSIVE {_PROG_INS}, {_IEDGES}, {_COUNTS}, i AS (SELECT fp, nodes, row_number() OVER (ORDER BY fp) - 1 AS i FROM gc) SELECT fp, (i // 32)::INT AS batch, coalesce(sum(nodes) OVER (PARTITION BY i // 32 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", nodes FROM i")
def batch_offsets(s, d):
    return graphs.batch_offsets(graph_counts(s, d), 32)


@query("message_passing", f"WITH RECURSIVE {_PROG_INS}, {_REINDEX} SELECT re.fp, t::INT AS node, sum(opcode_id)::BIGINT AS x FROM re JOIN nodes ON nodes.fp = re.fp AND nodes.node = re.s GROUP BY ALL")
def message_passing(s, d):
    nodes = node_table(s, d).select("fp", "node", F.col("opcode_id").alias("x"))
    return graphs.message_passing(graph_reindex(s, d), nodes)


@query("edge_softmax", f"WITH RECURSIVE {_PROG_INS}, {_REINDEX} SELECT fp, s::INT AS s, t::INT AS t, type_id, round(exp(s % 7 - max(s % 7) OVER w) / sum(exp(s % 7 - m)) OVER w, 6) AS weight FROM (SELECT *, max(s % 7) OVER (PARTITION BY fp, t) AS m FROM re) WINDOW w AS (PARTITION BY fp, t)")
def edge_softmax(s, d):
    e = graph_reindex(s, d).withColumn("score", (F.col("s") % 7).cast("double"))
    return graphs.edge_softmax(e).select("fp", "s", "t", "type_id", F.round("weight", 6).alias("weight"))


@query("graph_pool", f"WITH RECURSIVE {_PROG_INS} SELECT fp, round(avg(opcode_id), 6) AS mean, max(opcode_id) AS max FROM ins GROUP BY fp")
def graph_pool(s, d):
    p = graphs.pool(_prog_ins(s, d).select("fp", F.col("opcode_id").alias("x")))
    return p.select("fp", F.round("mean", 6).alias("mean"), "max")


_TEXT = "ot AS (SELECT fp, list(opcode ORDER BY pc) AS tokens, string_agg(opcode, ' ' ORDER BY pc) AS opcode_text FROM ins GROUP BY fp)"


def _text(s, d):
    return features.opcode_text(_prog_ins(s, d))


@query("opcode_text", f"WITH RECURSIVE {_PROG_INS}, {_TEXT} SELECT fp, opcode_text FROM ot")
def opcode_text(s, d):
    return _text(s, d).select("fp", "opcode_text")


@query("token_cascade", f"WITH RECURSIVE {_PROG_INS}, {_TEXT} SELECT programs.fp, CASE WHEN programs.fp % 3 = 0 THEN 'STOP ADD' WHEN programs.fp % 3 = 1 THEN opcode_text ELSE '' END AS tokens, CASE programs.fp % 3 WHEN 0 THEN 'opcode_sequence' WHEN 1 THEN 'node_table' ELSE '' END AS origin FROM programs LEFT JOIN ot USING (fp)")
def token_cascade(s, d):
    contracts = P.programs(s, d).select("fp")
    stored = contracts.select("fp", F.when(F.col("fp") % 3 == 0, F.array(F.lit("STOP"), F.lit("ADD"))).otherwise(F.array().cast("array<string>")).alias("tokens"))
    t = features.token_cascade(contracts, stored, _prog_ins(s, d).where("fp % 3 <> 2"))
    return t.select("fp", F.array_join("tokens", " ").alias("tokens"), "origin")


_CALLS = ", ".join(f"'{c}'" for c in evm.CALLS)


@query("call_ratios", f"WITH RECURSIVE {_CODE_INS}, c AS (SELECT fp, count(*) AS opcode_count, count(*) FILTER (WHERE opcode IN ({_CALLS})) AS call_like_count, count(*) FILTER (WHERE opcode = 'DELEGATECALL') AS delegatecall_count FROM ins GROUP BY fp) SELECT *, round(call_like_count / opcode_count, 6) AS call_like_ratio, round(delegatecall_count / opcode_count, 6) AS delegatecall_ratio FROM c")
def call_ratios(s, d):
    return features.call_ratios(_code_ins(s, d))


@query("opcode_histogram", f"WITH RECURSIVE {_CODE_INS} SELECT opcode, count(*) AS n FROM ins GROUP BY opcode")
def opcode_histogram(s, d):
    return _code_ins(s, d).groupBy("opcode").agg(F.count("*").alias("n"))


#: Every fifth code is a minimal proxy to an address, and every seventh of those has a byte more.
_FLAGGED_SQL = P.CODES_SQL + ", flagged AS (SELECT fp, CASE WHEN fp % 5 = 0 THEN '363d3d373d3d3d363d73' || substr(code, 1, 40) || '5af43d82803e903d91602b57fd5bf3' || CASE WHEN fp % 7 = 0 THEN '00' ELSE '' END ELSE code END AS code FROM codes)"


@query("bytecode_flags", f"""WITH RECURSIVE {_ins_sql(_FLAGGED_SQL, "flagged")}, c AS (SELECT fp, count(*) AS n, count(*) FILTER (WHERE opcode = 'DELEGATECALL') AS k FROM ins GROUP BY fp)
SELECT c.fp, k AS delegatecall_count, n AS opcode_count, fp % 5 = 0 AND fp % 7 <> 0 AS is_eip1167_proxy, (fp % 5 = 0 AND fp % 7 <> 0) OR (k > 0 AND k / n >= 0.02) AS is_proxy_like, length(code) / 2 < 100 AS is_stub_like, (length(code) // 2)::INT AS runtime_size_bytes FROM c JOIN flagged USING (fp)""")
def bytecode_flags(s, d):
    fp = F.col("fp")
    proxy = F.concat(F.lit("363d3d373d3d3d363d73"), F.substring("code", 1, 40), F.lit("5af43d82803e903d91602b57fd5bf3"), F.when(fp % 7 == 0, "00").otherwise(""))
    codes = P.codes(s, d).withColumn("code", F.when(fp % 5 == 0, proxy).otherwise(F.col("code")))
    ins = evm.disassemble(codes).withColumn("fp", fp.cast("long"))
    n = ins.groupBy("fp").agg(F.count_if(F.col("opcode") == "DELEGATECALL").alias("delegatecall_count"), F.count("*").alias("opcode_count"))
    h = F.col("code")
    j = n.join(codes, "fp")
    return j.select("fp", "delegatecall_count", "opcode_count", B.is_minimal_proxy(h).alias("is_eip1167_proxy"), B.is_proxy_like(h, F.col("delegatecall_count"), F.col("opcode_count")).alias("is_proxy_like"), B.is_stub_like(h).alias("is_stub_like"), (F.length(h) / 2).cast("int").alias("runtime_size_bytes"))


def _pattern_sql() -> str:
    many = lambda *names: "len(list_filter(tokens, lambda x: x IN (" + ", ".join(f"'{n}'" for n in names) + ")))::DOUBLE"
    n = "greatest(len(tokens), 1)::DOUBLE"
    found = lambda k, p: f"len(regexp_extract_all(substr(opcode_text, 1, {k}), '{p}'))::DOUBLE"
    cols = {f"{c.lower()}_count": many(c) for c in features.COUNTED}
    cols |= {
        "external_call_total": many(*evm.CALLS), "external_call_ratio": f"{many(*evm.CALLS)} / {n}", "call_then_sstore": found(50000, r"CALL\b.*?\bSSTORE"), "add_then_lt": found(50000, r"ADD\b[^S]*?\bLT"),
        "call_then_pop": r"len(regexp_extract_all(opcode_text, '\bCALL POP\b'))::DOUBLE", "arithmetic_total": many(*features.ARITHMETIC), "arithmetic_ratio": f"{many(*features.ARITHMETIC)} / {n}",
        "has_origin": f"({many('ORIGIN')} > 0)::INT::DOUBLE", "origin_eq": found(20000, r"ORIGIN\b.*?\bEQ"), "origin_without_caller": f"({many('ORIGIN')} > 0 AND {many('CALLER')} = 0)::INT::DOUBLE",
        "randomness_source_total": many(*features.RANDOMNESS), "loop_density": f"{many('JUMPI')} / {n}", "storage_ratio": f"{many('SSTORE', 'SLOAD')} / {n}", "log_total": many(*features.LOGS),
        "unique_opcodes": "len(list_distinct(tokens))::DOUBLE", "total_opcodes": "len(tokens)::DOUBLE",
    }
    return ", ".join(f"round({v}, 6) AS pat_{k}" for k, v in cols.items())


@query("pattern_features", f"WITH RECURSIVE {_PROG_INS}, {_TEXT} SELECT fp, {_pattern_sql()} FROM ot")
def pattern_features(s, d):
    p = features.pattern_features(_prog_ins(s, d))
    return p.select("fp", *[F.round(c, 6).alias(c) for c in p.columns if c != "fp"])


_IDS = "(SELECT list(coalesce(m.k, 257) ORDER BY i) FROM (SELECT unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i) u LEFT JOIN (VALUES " + ", ".join(f"('{n}', {i + 1})" for i, (n, _, _) in evm.instruction_set().items() if not n.startswith("UNKNOWN")) + ") m(n, k) ON m.n = u.t WHERE i <= 1024)"


@query("token_ids", f"WITH RECURSIVE {_PROG_INS}, {_TEXT}, i AS (SELECT fp, {_IDS} AS ids FROM ot) SELECT fp, len(ids)::INT AS n_ids, list_aggregate(list_concat(ids, [0 for x in range(1024 - len(ids))]), 'string_agg', ',') AS ids FROM i")
def token_ids(s, d):
    t = features.token_ids(_text(s, d))
    return t.select("fp", "n_ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


#: Initcode of five kinds by the remainder of fp: whole, without its return, of odd length, cut short, empty.
_EXTRACT_SQL = f"""WITH {P.CODES_SQL}, x AS (SELECT *, fp % 5 AS k FROM codes)
SELECT fp::VARCHAR AS fp, k = 0 AS success, CASE k WHEN 0 THEN '' WHEN 1 THEN 'no_return_linked_codecopy' WHEN 2 THEN 'invalid_hex_odd_length' WHEN 3 THEN 'runtime_out_of_bounds' ELSE 'empty_initcode' END AS failure_mode,
CASE WHEN k = 0 THEN 12 END AS "offset", CASE WHEN k = 0 THEN length(code) // 2 END AS length, CASE WHEN k = 0 THEN code END AS runtime, CASE WHEN k IN (0, 3) THEN 1 ELSE 0 END AS candidates FROM x"""


@query("runtime_extract", _EXTRACT_SQL)
def runtime_extract(s, d):
    """Runtime code found in initcode that copies and returns the rest of itself, and why there is none."""
    size, k = F.length("code") / 2, F.col("fp") % 5
    head = F.concat(F.lit("61"), F.lpad(F.lower(F.hex(size.cast("long"))), 4, "0"), F.lit("80600c6000396000"), F.when(k == 1, "fd").otherwise("f3"))
    tail = F.when(k == 2, F.concat("code", F.lit("a"))).when(k == 3, F.substring("code", 1, 100)).otherwise(F.col("code"))
    return evm.extract_runtime(P.codes(s, d).select("fp", F.when(k == 4, "").otherwise(F.concat(head, tail)).alias("code")))


_EARLY = "early(opcode_id, name) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in sorted(evm.early_names().items())) + ")"


@query("early_histogram", f"WITH RECURSIVE {_CODE_INS}, {_EARLY} SELECT name, count(*) AS n FROM ins JOIN early USING (opcode_id) GROUP BY name")
def early_histogram(s, d):
    return _code_ins(s, d).groupBy(evm.early_name(F.col("opcode_id")).alias("name")).agg(F.count("*").alias("n"))


@query("runtime_source", f"""WITH {P.CODES_SQL}, r AS (SELECT fp, CASE WHEN fp % 2 = 0 THEN code END AS e, CASE WHEN fp % 3 = 0 THEN substr(code, 1, 64) ELSE '' END AS r, CASE WHEN fp % 5 = 0 THEN '6000' END AS i FROM codes)
SELECT fp, CASE WHEN fp % 2 = 0 THEN e ELSE r END AS code, CASE WHEN fp % 2 = 0 THEN 'bin_extracted' WHEN fp % 3 = 0 AND fp % 5 = 0 THEN 'bin_runtime_fallback' WHEN fp % 3 = 0 THEN 'bin_runtime_direct' ELSE '' END AS source FROM r""")
def runtime_source(s, d):
    fp = F.col("fp")
    x = P.codes(s, d).select("fp", F.when(fp % 2 == 0, F.col("code")).alias("e"), F.when(fp % 3 == 0, F.substring("code", 1, 64)).otherwise("").alias("r"), F.when(fp % 5 == 0, "6000").alias("i"))
    code, name = B.runtime_source(F.col("e"), F.col("r"), F.col("i"))
    return x.select("fp", code.alias("code"), name.alias("source"))


@query("canonical_info", f"""WITH {P.CODES_SQL}, x AS (SELECT fp, code, fp % 4 AS k FROM codes WHERE fp % 4 <> 0)
SELECT fp, CASE WHEN k = 1 THEN code END AS code, CASE WHEN k = 1 THEN (length(code) // 2 + 12)::INT END AS raw_bytes, CASE WHEN k = 1 THEN (length(code) // 2)::INT END AS canonical_bytes, CASE k WHEN 2 THEN 'odd_length_hex' WHEN 3 THEN 'invalid_hex' ELSE '' END AS failure_mode FROM x""")
def canonical_info(s, d):
    fp = F.col("fp")
    raw = F.when(fp % 4 == 1, F.concat(F.lit(" 0x"), F.upper("code"), F.lit("A164736F6C6343000813 000A\n"))).when(fp % 4 == 2, F.concat("code", F.lit("a"))).otherwise("zz")
    x = P.codes(s, d).where(fp % 4 != 0).select("fp", B.canonical_info(raw).alias("i"))
    return x.select("fp", "i.code", "i.raw_bytes", "i.canonical_bytes", "i.failure_mode")


@query("dfg_edges", f"WITH RECURSIVE {_PROG_INS}, {_CFG}, {_FLOW} SELECT fp, src, dst, edge_type, storage_slot, memory_offset FROM fe")
def dfg_edges(s, d):
    ins = _prog_once(s, d)
    return graphs.data_flow(ins, graphs.fallback_cfg(ins)).withColumn("fp", F.col("fp").cast("long"))
