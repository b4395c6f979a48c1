"""Jumps whose target was pushed in another block: known stack entries carried along edges to a fixpoint.

What a block does to the stack is summed up once: which entry each slot of the stack it
leaves behind came from, or which number was pushed there. From then on all is relations.
A fact ``(fp, block, slot, value)`` says that a slot (0 is the top) of the stack before a
block may hold a place to jump to. Facts move along edges by the blocks' summaries, and a
jump to a slot turns its facts into edges, along which more facts move.

Rounds end: a fact's block and value are places in the code and its slot is below
:data:`DEPTH`, the machine's own limit, so there are finitely many; each round adds only
facts that were not there before, and one without new facts is the last. Sets of values
only grow, so the order of rounds doesn't matter. Paths are not told apart: a slot has the
values of all ways to it, so every edge that a run of the code can take is there, as far as
values come from pushes and are only copied, and some may be that no run takes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytequarry.functions.evm import stack_moves
from bytequarry.operators.graphs import block_summary, fallback_cfg
from bytequarry.operators.steps import Growing, dropped, written
from bytequarry.session import few_broadcasts

#: The largest stack of the machine.
DEPTH = 1024
FACT = ["fp", "block", "slot", "value"]
TRANSFER = "fp string, block int, dead boolean, takes int, net int, jump_slot int, jump_value long, slots array<struct<slot int, entry int, value long>>"


def transfer(rows: list[tuple[str, str]]) -> tuple:
    """What a block of (opcode, push data) does to the stack: ``dead, takes, net, jump_slot, jump_value, slots``.

    ``takes`` entries go and ``takes + net`` come in their place, which ``slots`` lists as far
    as they are copies of entries or short numbers. A block with an unknown instruction is
    dead: nothing runs on after it.
    """
    moves, stack, taken, target = stack_moves(), [], 0, None
    for op, data in rows:
        if op.startswith("PUSH"):
            number = "0" if op == "PUSH0" else data
            stack.append(("value", int(number, 16)) if 0 < len(number) and len(number.lstrip("0")) <= 8 else None)
            continue
        if op not in moves:
            return True, 0, 0, None, None, []
        pops, puts = moves[op]
        items = []
        for _ in range(pops):
            if stack:
                items.append(stack.pop())
            else:
                items.append(("entry", taken))
                taken += 1
        if op in ("JUMP", "JUMPI"):
            target = items[0]
        stack += [None if p is None else items[p] for p in reversed(puts)]
    slots = [(i, x[1] if x[0] == "entry" else None, x[1] if x[0] == "value" else None) for i, x in enumerate(reversed(stack)) if x]
    kind, at = target or (None, None)
    return False, taken, len(stack) - taken, at if kind == "entry" else None, at if kind == "value" else None, slots


def transfers(ins: DataFrame) -> DataFrame:
    """:func:`transfer` of every block, by ``fp`` and the block's start."""
    row = F.struct("pc", "opcode", "push_data")
    blocks = ins.groupBy("fp", "basic_block_id").agg(F.min("pc").cast("int").alias("block"), F.sort_array(F.collect_list(row)).alias("rows"))

    def run(batches):
        for pdf in batches:
            out = [(fp, block, *transfer([(r["opcode"], r["push_data"]) for r in rows])) for fp, block, rows in zip(pdf["fp"], pdf["block"], pdf["rows"], strict=True)]
            table = pd.DataFrame(out, columns=[c.split()[0] for c in TRANSFER.split(", ")[:7]] + ["slots"])
            for c in ("jump_slot", "jump_value"):
                table[c] = pd.array(table[c], dtype="Int64")
            table["slots"] = [[{"slot": s, "entry": e, "value": v} for s, e, v in x] for x in table["slots"]]
            yield table

    kind = ins.schema["fp"].dataType
    return blocks.select(F.col("fp").cast("string").alias("fp"), "block", "rows").mapInPandas(run, TRANSFER).withColumn("fp", F.col("fp").cast(kind))


def stack_facts(ins: DataFrame, cfg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All facts of the codes ``ins``, and the edges ``fp, src, dst`` of the jumps that they or a block's own pushes give.

    ``cfg`` has the edges known so far (``fp, src, dst`` by block starts). Only numbers that
    are the place of a JUMPDEST are followed.
    """
    with few_broadcasts(ins.sparkSession, -1):
        return _carried(ins, cfg)


def _carried(ins: DataFrame, cfg: DataFrame) -> tuple[DataFrame, DataFrame]:
    marks = written(ins.where("opcode = 'JUMPDEST'").select("fp", F.col("pc").cast("long").alias("value")), "marks")
    blocks = written(transfers(ins).where("NOT dead"), "transfers")
    slots = blocks.select("fp", "block", F.explode("slots").alias("s")).select("fp", "block", "s.*")
    own = written(slots.join(marks, ["fp", "value"], "left_semi").select(*FACT), "pushed")
    copied = written(slots.where("entry IS NOT NULL").select("fp", "block", F.col("entry").alias("slot"), F.col("slot").alias("to")), "copied")
    below = blocks.select("fp", "block", "takes", "net")
    jumps = blocks.where("jump_slot IS NOT NULL").select("fp", "block", F.col("jump_slot").alias("slot"))
    direct = blocks.select("fp", "block", F.col("jump_value").alias("value")).join(marks, ["fp", "value"], "left_semi")
    direct = written(direct.select("fp", F.col("block").alias("src"), F.col("value").cast("int").alias("dst")), "direct")
    known = written(cfg.select("fp", "src", "dst").unionByName(direct).distinct(), "known")

    def left(facts: DataFrame) -> DataFrame:
        """Facts before blocks as facts after them."""
        moved = facts.join(copied, ["fp", "block", "slot"]).select("fp", "block", F.col("to").alias("slot"), "value")
        deep = facts.join(below, ["fp", "block"]).where("slot >= takes").select("fp", "block", (F.col("slot") + F.col("net")).alias("slot"), "value")
        return moved.unionByName(deep).where(F.col("slot") < DEPTH)

    def along(facts: DataFrame, edges: DataFrame) -> DataFrame:
        """Facts after blocks as facts before those that follow."""
        return facts.join(edges.withColumnRenamed("src", "block"), ["fp", "block"]).select("fp", F.col("dst").alias("block"), "slot", "value")

    def targets(facts: DataFrame) -> DataFrame:
        """The edges of jumps to slots with facts."""
        return facts.join(jumps, ["fp", "block", "slot"]).select("fp", F.col("block").alias("src"), F.col("value").cast("int").alias("dst"))

    facts = Growing(along(own, known).distinct(), "facts")
    more = not facts.latest().isEmpty()
    while more:
        news, fresh = facts.latest(), targets(facts.latest())
        seen = facts.before().join(fresh.select("fp", F.col("src").alias("block")).distinct(), ["fp", "block"], "left_semi")
        found = along(left(news), known.unionByName(targets(facts.all()))).unionByName(along(left(seen), fresh)).unionByName(along(own, fresh))
        more = facts.add(found.distinct().join(facts.all(), FACT, "left_anti"))
    edges = written(targets(facts.all()).unionByName(direct).distinct(), "targets")
    result = written(facts.all(), "stack_facts")
    facts.close()
    dropped(marks, blocks, own, copied, direct, known)
    return result, edges


def resolved_jumps(ins: DataFrame, cfg: DataFrame | None = None) -> DataFrame:
    """``fp, src, dst, edge_type`` of jumps that ``cfg`` (by default the edges of pushes right before jumps) does not have."""
    cfg = fallback_cfg(ins) if cfg is None else cfg
    _, edges = stack_facts(ins, cfg)
    ends = block_summary(ins).select("fp", F.col("start_pc").alias("src"), F.when(F.col("end_opcode") == "JUMP", "jump").otherwise("jumpi_true").alias("edge_type"))
    return edges.hint("merge").join(ends, ["fp", "src"]).select("fp", "src", "dst", "edge_type").join(cfg.hint("merge"), ["fp", "src", "dst", "edge_type"], "left_anti")


def resolved_cfg(ins: DataFrame) -> DataFrame:
    """Control-flow edges with those of computed jumps."""
    cfg = written(fallback_cfg(ins), "fallback")
    return cfg.unionByName(resolved_jumps(ins, cfg))
