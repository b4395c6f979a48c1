"""Queries over jumps that are resolved across blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from bytequarry.functions import evm
from bytequarry.operators import graphs, jumps, steps
from bytequarry.plans import proxies as P
from bytequarry.plans.graph_queries import _CFG, _ins_sql
from bytequarry.plans.registry import query

_TAKES = "takes(o, pops, pushes) AS (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (n, a, b) in evm.instruction_set().items()) + ")"
#: Stacks of symbols: e<i> an entry, c<n> a number, u anything else; K entries are there at first, as many as the block could take.
_FACTS = f"""{_ins_sql(P.ROUTINES_SQL, "routines")}, {_CFG}, {_TAKES},
li AS MATERIALIZED (
  SELECT fp, basic_block_id AS bb, row_number() OVER w AS k, min(pc) OVER b AS block, sum(pops) OVER b AS n, bool_or(opcode LIKE 'UNKNOWN%') OVER b AS dead, opcode, o, pops, pushes,
    CASE WHEN o = 95 THEN 'c0' WHEN push_data = '' OR length(ltrim(push_data, '0')) > 8 THEN 'u' ELSE 'c' || ('0x0' || push_data)::BIGINT END AS pushed
  FROM ins JOIN takes ON o = opcode_id WINDOW w AS (PARTITION BY fp, basic_block_id ORDER BY pc), b AS (PARTITION BY fp, basic_block_id)),
sy AS (
  SELECT fp, bb, 1::BIGINT AS k, list_transform(range(n::BIGINT), lambda i: 'e' || i) AS s FROM li WHERE k = 1
  UNION ALL
  SELECT fp, bb, k + 1, CASE WHEN opcode LIKE 'PUSH%' THEN list_prepend(pushed, s) WHEN o BETWEEN 128 AND 143 THEN list_prepend(s[o - 127], s)
    WHEN o BETWEEN 144 AND 159 THEN list_concat([s[o - 142]], s[2:o - 143], [s[1]], s[o - 141:]) ELSE list_concat(list_transform(range(pushes), lambda x: 'u'), s[pops + 1:]) END
  FROM sy JOIN li USING (fp, bb, k) WHERE NOT dead),
marks AS MATERIALIZED (SELECT fp, pc AS v FROM ins WHERE opcode = 'JUMPDEST'),
ends AS MATERIALIZED (SELECT fp, bb, any_value(block) AS block, max(k) + 1 AS k, any_value(n) AS n FROM li WHERE NOT dead GROUP BY fp, bb),
after AS MATERIALIZED (SELECT fp, block, n, s FROM ends JOIN sy USING (fp, bb, k)),
sl AS MATERIALIZED (SELECT fp, block, i - 1 AS slot, s[i] AS x FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM after)),
own AS MATERIALIZED (SELECT fp, block, slot, v AS "value" FROM sl JOIN marks USING (fp) WHERE x = 'c' || v),
copied AS MATERIALIZED (SELECT fp, block, substr(x, 2)::BIGINT AS slot, slot AS "to" FROM sl WHERE x LIKE 'e%'),
deep AS MATERIALIZED (SELECT fp, block, n, len(s) - n AS net FROM after),
jt2 AS MATERIALIZED (SELECT fp, block, s[1] AS x FROM li JOIN sy USING (fp, bb, k) WHERE opcode IN ('JUMP', 'JUMPI') AND NOT dead),
js AS MATERIALIZED (SELECT fp, block, substr(x, 2)::BIGINT AS slot FROM jt2 WHERE x LIKE 'e%'),
direct AS MATERIALIZED (SELECT fp, block AS src, v AS dst FROM jt2 JOIN marks USING (fp) WHERE x = 'c' || v),
known AS MATERIALIZED (SELECT fp, src, dst FROM cfg UNION SELECT fp, src, dst FROM direct),
f(fp, block, slot, "value") USING KEY (fp, block, slot, "value") AS (
  SELECT DISTINCT own.fp, dst, slot::BIGINT, "value"::BIGINT FROM own JOIN known ON known.fp = own.fp AND src = block
  UNION
  SELECT x.fp, e.dst, x.slot, x."value" FROM (
    SELECT f.fp, f.block, c."to" AS slot, f."value" FROM recurring.f AS f JOIN copied c ON c.fp = f.fp AND c.block = f.block AND c.slot = f.slot
    UNION SELECT f.fp, f.block, (f.slot + net)::BIGINT, f."value" FROM recurring.f AS f JOIN deep d ON d.fp = f.fp AND d.block = f.block WHERE f.slot >= n
    UNION SELECT fp, block, slot, "value" FROM own) x
  JOIN (SELECT fp, src, dst FROM known UNION SELECT f.fp, f.block, f."value" FROM recurring.f AS f JOIN js ON js.fp = f.fp AND js.block = f.block AND js.slot = f.slot) e ON e.fp = x.fp AND e.src = x.block
  WHERE x.slot < {jumps.DEPTH}),
tg AS (SELECT f.fp, f.block AS src, f."value"::INT AS dst FROM f JOIN js ON js.fp = f.fp AND js.block = f.block AND js.slot = f.slot UNION SELECT fp, src, dst FROM direct),
rj AS MATERIALIZED (
  SELECT tg.fp, tg.src, tg.dst, CASE WHEN end_opcode = 'JUMP' THEN 'jump' ELSE 'jumpi_true' END AS edge_type FROM tg JOIN blocks ON blocks.fp = tg.fp AND start_pc = src
  EXCEPT SELECT fp, src, dst, edge_type FROM cfg)"""


def _ins(s, d):
    return steps.written(graphs.with_blocks(evm.disassemble(P.routines(s, d))).withColumn("fp", F.col("fp").cast("long")), "instructions")


@query("stack_facts", f"WITH RECURSIVE {_FACTS} SELECT fp, block::INT AS block, slot::INT AS slot, \"value\" FROM f")
def stack_facts(s, d):
    ins = _ins(s, d)
    return jumps.stack_facts(ins, graphs.fallback_cfg(ins))[0]


@query("resolved_jumps", f"WITH RECURSIVE {_FACTS} SELECT * FROM rj")
def resolved_jumps(s, d):
    return jumps.resolved_jumps(_ins(s, d))


@query("jumps_left", f"""WITH RECURSIVE {_FACTS}, al AS (SELECT fp, src FROM cfg WHERE edge_type IN ('jump', 'jumpi_true') UNION SELECT fp, src FROM rj)
SELECT b.fp, count(*) AS jumps, count(*) FILTER (WHERE al.src IS NULL) AS unresolved FROM blocks b LEFT JOIN al ON al.fp = b.fp AND al.src = b.start_pc WHERE end_opcode IN ('JUMP', 'JUMPI') GROUP BY b.fp""")
def jumps_left(s, d):
    """Jumps of each code, and those without any known target even after resolution across blocks."""
    ins = _ins(s, d)
    return graphs.unresolved_jumps(ins, jumps.resolved_cfg(ins))
