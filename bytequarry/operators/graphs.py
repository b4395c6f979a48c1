"""Basic blocks, control and data flow, graph tables; keyed by ``fp`` throughout."""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytequarry.functions.evm import CALLS, HALTING, TERMINAL, instruction_set, stack_moves
from bytequarry.operators.order import positions

#: Edge types in order of their ids.
EDGE_TYPES = ("fallthrough", "jump", "jumpi_true", "jumpi_false", "terminal", "stack_flow", "memory_flow", "storage_flow", "control_dependency")


def with_blocks(ins: DataFrame) -> DataFrame:
    """Adds ``basic_block_id``: a block begins at a JUMPDEST and after a terminal instruction."""
    w = Window.partitionBy("fp").orderBy("pc")
    starts = (F.col("opcode") == "JUMPDEST") | F.coalesce(F.lag("opcode").over(w).isin(*TERMINAL), F.lit(True))
    return ins.withColumn("_s", starts.cast("int")).withColumn("basic_block_id", (F.sum("_s").over(w) - 1).cast("int")).drop("_s")


def block_summary(ins: DataFrame) -> DataFrame:
    """First and last place, size and last opcode of each block.

    Opcodes are taken by their numbers beside their places, so the aggregate has numbers alone and
    combines rows in a hash table (texts would make Spark sort all instructions).
    """
    names = F.array(*[F.lit(name) for _, (name, _, _) in sorted(instruction_set().items())])
    at = F.col("pc").cast("long") * 256 + F.col("opcode_id")
    found = ins.groupBy("fp", "basic_block_id").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("instruction_count"))
    found = found.withColumn("end_opcode", F.get(names, (F.col("last") % 256).cast("int")))
    pc = lambda c: F.shiftright(c, 8).cast("int")
    return found.select(
        "fp", "basic_block_id", pc("first").alias("start_pc"), pc("last").alias("end_pc"), "instruction_count",
        (F.col("first") % 256 == 0x5B).alias("starts_with_jumpdest"), F.col("end_opcode").isin(*TERMINAL).alias("ends_with_terminal"), "end_opcode",
    )


def hex_value(h: Column, digits: int = 8) -> Column:
    """The number that a short hex text holds; null for longer ones (no place in a code is that far)."""
    short = F.regexp_replace(h, "^0+", "")
    return F.when(h == "", None).when(F.length(short) <= digits, F.coalesce(F.conv(F.nullif(short, F.lit("")), 16, 10).cast("long"), F.lit(0)))


def fallback_cfg(ins: DataFrame) -> DataFrame:
    """Control-flow edges by block starts; jumps are resolved where a push stands right before them."""
    w = Window.partitionBy("fp", "basic_block_id").orderBy("pc")
    jumps = ins.withColumns({"prev": F.lag("opcode").over(w), "data": F.lag("push_data").over(w)}).where(F.col("opcode").isin("JUMP", "JUMPI"))
    target = F.when(F.col("prev").startswith("PUSH") & (F.col("prev") != "PUSH0"), hex_value(F.col("data")))
    jumps = jumps.select("fp", "basic_block_id", target.alias("target"))
    blocks = block_summary(ins).withColumn("next", F.lead("start_pc").over(Window.partitionBy("fp").orderBy("basic_block_id")))
    starts = blocks.select("fp", F.col("start_pc").cast("long").alias("target"))
    taken = blocks.join(jumps, ["fp", "basic_block_id"]).join(starts, ["fp", "target"])
    taken = taken.select("fp", F.col("start_pc").alias("src"), F.col("target").cast("int").alias("dst"), F.when(F.col("end_opcode") == "JUMP", "jump").otherwise("jumpi_true").alias("edge_type"))
    on = blocks.where(F.col("next").isNotNull() & ~F.col("end_opcode").isin("JUMP", *HALTING))
    on = on.select("fp", F.col("start_pc").alias("src"), F.col("next").alias("dst"), F.when(F.col("end_opcode") == "JUMPI", "jumpi_false").otherwise("fallthrough").alias("edge_type"))
    return taken.unionByName(on)


def instruction_edges(ins: DataFrame, cfg: DataFrame) -> DataFrame:
    """Block edges as edges from a block's last instruction to the target's first."""
    ends = block_summary(ins).select("fp", F.col("start_pc").alias("src"), "end_pc")
    nodes = ins.select("fp", F.col("pc").alias("dst")).distinct()
    return cfg.join(ends, ["fp", "src"], "left").withColumn("src", F.coalesce("end_pc", "src")).join(nodes, ["fp", "dst"], "left_semi").select("fp", "src", "dst", "edge_type").distinct()


#: Instructions that write memory at places not followed, and those that may change all state.
COPIES = ("CALLDATACOPY", "CODECOPY", "EXTCODECOPY", "RETURNDATACOPY", "MCOPY")
EFFECTS = (*CALLS, "CREATE", "CREATE2", "SELFDESTRUCT")
#: What an instruction does to known places: of which state it writes or reads the one on top of the stack, and which states it forgets.
WRITES = {"SSTORE": "storage", "MSTORE": "memory", "MSTORE8": "memory"}
READS = {"SLOAD": "storage", "MLOAD": "memory"}
FORGETS = {**{c: ("memory",) for c in COPIES}, **{c: ("storage", "memory") for c in EFFECTS}}
#: A stack entry is the set of its producers and its value where a push gave it; below a block's own entries nothing is known.
Entry = tuple[frozenset, str | None]
NOTHING: Entry = (frozenset(), None)


@cache
def effects_table() -> dict[str, tuple[int, list[int | None], list[int]]]:
    """Of each known instruction but pushes: entries taken, what is put in their place (see :func:`stack_moves`), and which of those taken it uses.

    Instructions that only move entries use none of them, but the one that they copy.
    """
    table = {}
    for op, (takes, puts) in stack_moves().items():
        copied = [p for p in puts if p is not None and puts.count(p) > 1]
        moved = bool(puts) and None not in puts
        table[op] = takes, puts, sorted(set(copied)) if moved else list(range(takes))
    return table


def simulate_block(rows: list[tuple[int, str, str]], taken: list[int], passed: list[int]) -> list[tuple]:
    """Data-flow edges (src, dst, type, slot, offset) of one block, by one interpreter over :func:`effects_table`.

    Storage and memory are known by constant places only: a write to an unknown place forgets
    its kind. A conditional jump gives control dependencies where the targets of both branches
    (``taken``, ``passed``) are known. An exchange of entries that are not all there does
    nothing; an unknown instruction ends the block.
    """
    table, stack, edges = effects_table(), [], {}
    states: dict[str, dict[str, int]] = {"storage": {}, "memory": {}}
    for pc, op, data in rows:
        if op.startswith("PUSH"):
            number = "0" if op == "PUSH0" else data
            stack.append((frozenset([pc]), (number.lstrip("0") or "0") if number else None))
            continue
        if op not in table:
            break
        takes, puts, uses = table[op]
        missing = max(0, takes - len(stack))
        if missing and len(puts) == takes and None not in puts:
            continue
        items = [stack.pop() if stack else NOTHING for _ in range(takes)]
        for producer in {p for u in uses for p in items[u][0]}:
            edges[producer, pc, "stack_flow", None, None] = None
        place = items[0][1] if items else None
        if (kind := WRITES.get(op)) and place is not None:
            states[kind][place] = pc
        elif kind:
            states[kind].clear()
        if (kind := READS.get(op)) and place in states[kind]:
            edges[states[kind][place], pc, f"{kind}_flow", *((place, None) if kind == "storage" else (None, place))] = None
        for forgotten in FORGETS.get(op, ()):
            states[forgotten].clear()
        if op == "JUMPI" and taken and passed:
            edges |= {(p, t, "control_dependency", None, None): None for p in items[1][0] for t in (*taken, *passed)}
        back = [(frozenset([pc]), None) if p is None else items[p] for p in puts]
        # what was not there is not put back, but for a copy of it on top
        kept = len(back) - missing if None not in puts else len(back)
        stack += back[:kept][::-1]
    return list(edges)


DFG = "fp string, src int, dst int, edge_type string, storage_slot string, memory_offset string"


def data_flow(ins: DataFrame, cfg: DataFrame) -> DataFrame:
    """Data-flow edges of all blocks. Rows are grouped by block, so a long code spreads over tasks."""
    rows = ins.groupBy("fp", "basic_block_id").agg(F.min("pc").alias("src"), F.sort_array(F.collect_list(F.struct("pc", "opcode", "push_data"))).alias("rows"))
    ends = lambda kind: F.array_sort(F.collect_set(F.when(F.col("edge_type") == kind, F.col("dst"))))
    targets = cfg.where(F.col("edge_type").isin("jumpi_true", "jumpi_false")).groupBy("fp", "src").agg(ends("jumpi_true").alias("taken"), ends("jumpi_false").alias("passed"))

    def run(batches):
        for pdf in batches:
            out = []
            for fp, block, *to in zip(pdf["fp"], pdf["rows"], pdf["taken"], pdf["passed"], strict=True):
                edges = simulate_block([(r["pc"], r["opcode"], r["push_data"]) for r in block], *([] if t is None else [int(x) for x in t] for t in to))
                out += [(fp, *e) for e in edges]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DFG.split(", ")])

    joined = rows.join(targets, ["fp", "src"], "left").select(F.col("fp").cast("string").alias("fp"), "rows", "taken", "passed")
    return joined.mapInPandas(run, DFG).distinct()


def flow_status(contracts: DataFrame, ins: DataFrame) -> DataFrame:
    """``fp, dfg_success, failure_mode`` of each contract: whether it has instructions to walk, or why not.

    ``ins`` has ``parse_success``, ``pc``, ``opcode_id`` and ``failure_mode``; a contract without
    rows, or without a row that was parsed and has a place and a code, has no data flow.
    """
    fine = F.coalesce(F.col("parse_success"), F.lit(False)) & F.col("pc").isNotNull() & F.col("opcode_id").isNotNull()
    mode = F.when(F.trim("failure_mode") != "", F.trim("failure_mode"))
    seen = ins.groupBy("fp").agg(F.bool_or(fine).alias("dfg_success"), F.min_by(mode, F.when(mode.isNotNull(), F.col("row"))).alias("mode"))
    why = F.when(F.col("dfg_success").isNull(), "missing_instruction_rows").when(F.col("dfg_success"), "").otherwise(F.coalesce("mode", F.lit("instruction_parse_failed")))
    return contracts.join(seen, "fp", "left").select("fp", F.coalesce("dfg_success", F.lit(False)).alias("dfg_success"), why.alias("failure_mode"))


def flow_edges(nodes: DataFrame, dfg: DataFrame) -> DataFrame:
    """Data-flow edges of known types whose ends are both nodes, each once by ends, type, slot and offset."""
    known = dfg.where(F.col("edge_type").isin(*EDGE_TYPES[5:]) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    at = nodes.select("fp", "pc").distinct()
    both = known.join(at.withColumnRenamed("pc", "src"), ["fp", "src"], "left_semi").join(at.withColumnRenamed("pc", "dst"), ["fp", "dst"], "left_semi")
    return both.select("fp", "src", "dst", "edge_type", "storage_slot", "memory_offset").distinct()


def control_edges(edges: DataFrame) -> DataFrame:
    """Only the control-flow edges of a graph."""
    return edges.where(F.col("edge_type").isin(*EDGE_TYPES[:5]))


def unresolved_jumps(ins: DataFrame, cfg: DataFrame) -> DataFrame:
    """``fp, jumps, unresolved``: jumps of each contract and those whose target is no known block start."""
    ends = block_summary(ins).where(F.col("end_opcode").isin("JUMP", "JUMPI")).select("fp", F.col("start_pc").alias("src"))
    found = cfg.where(F.col("edge_type").isin("jump", "jumpi_true")).select("fp", "src", F.lit(1).alias("hit")).distinct()
    return ends.join(found, ["fp", "src"], "left").groupBy("fp").agg(F.count("*").alias("jumps"), F.count_if(F.col("hit").isNull()).alias("unresolved"))


def edges_by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n"))


def edge_type_id(c: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(t) for t in EDGE_TYPES]), c) - 1).cast("int")


def node_table(ins: DataFrame) -> DataFrame:
    """Instructions with dense node ids in order of pc, one per pc."""
    first = ins.withColumn("_k", F.row_number().over(Window.partitionBy("fp", "pc").orderBy("opcode_id"))).where("_k = 1")
    return first.withColumn("node", F.row_number().over(Window.partitionBy("fp").orderBy("pc")) - 1).select("fp", "node", "pc", "opcode_id", F.coalesce("basic_block_id", F.lit(-1)).alias("bb"))


def reindex(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges over node ids and type ids; edges without both ends go."""
    n = nodes.select("fp", "pc", "node")
    e = edges.join(n.select("fp", F.col("pc").alias("src"), F.col("node").alias("s")), ["fp", "src"]).join(n.select("fp", F.col("pc").alias("dst"), F.col("node").alias("t")), ["fp", "dst"])
    return e.select("fp", "s", "t", edge_type_id(F.col("edge_type")).alias("type_id")).distinct()


def graph_counts(ins: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, blocks and edges of each graph; ``edges`` has control and data flow."""
    control = F.col("edge_type").isin(*EDGE_TYPES[:5])
    e = edges.groupBy("fp").agg(F.count_if(control).alias("cfg_edges"), F.count_if(~control).alias("dfg_edges"), F.count("*").alias("total_edges"))
    n = ins.groupBy("fp").agg(F.count_distinct("pc").alias("nodes"), F.count_distinct("basic_block_id").alias("blocks"))
    return n.join(e, "fp", "left").na.fill(0, ["cfg_edges", "dfg_edges", "total_edges"])


def with_label_counts(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """``counts`` with each graph's positive and assessed labels (``labels`` has ``fp`` and a nullable 0 or 1)."""
    n = labels.groupBy("fp").agg(F.count_if(F.col("label") == 1).alias("label_positive_count"), F.count("label").alias("label_assessed_count"))
    return counts.join(n, "fp", "left").na.fill(0, ["label_positive_count", "label_assessed_count"])


def batch_offsets(counts: DataFrame, size: int) -> DataFrame:
    """Batches of ``size`` graphs in order of fp, with each graph's node offset within its batch."""
    order = positions(counts, ["fp"]).withColumn("batch", F.floor(F.col("i") / size).cast("int"))
    before = Window.partitionBy("batch").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return order.select("fp", "batch", F.coalesce(F.sum("nodes").over(before), F.lit(0)).alias("offset"), "nodes")


def invalid_edges(edges: DataFrame) -> DataFrame:
    """Edges that break the schema: unknown type or a missing end."""
    return edges.where(~F.coalesce(F.col("edge_type").isin(*EDGE_TYPES), F.lit(False)) | F.col("src").isNull() | F.col("dst").isNull())


def message_passing(edges: DataFrame, x: DataFrame) -> DataFrame:
    """Sum of source values at each target (columns ``fp, s, t`` and ``fp, node, x``)."""
    return edges.join(x.withColumnRenamed("node", "s"), ["fp", "s"]).groupBy("fp", F.col("t").alias("node")).agg(F.sum("x").alias("x"))


def edge_softmax(edges: DataFrame) -> DataFrame:
    """Each edge's share of its target's exponentials (column ``score``), shifted by the largest."""
    w = Window.partitionBy("fp", "t")
    e = F.exp(F.col("score") - F.max("score").over(w))
    return edges.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def pool(x: DataFrame) -> DataFrame:
    return x.groupBy("fp").agg(F.avg("x").alias("mean"), F.max("x").alias("max"))
