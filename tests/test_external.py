"""The external program: every way it can fail, and edges of its graphs."""

import sys

from bytequarry.sources import external

PROGRAM = """
import sys, time, json
code = sys.argv[2]
good = {"runtimeCfg": {"nodes": [{"offset": 0, "length": 3, "stackBalance": 0, "type": "basic", "bytecodeHex": "600557"}, {"offset": 3, "length": 2, "stackBalance": -1, "bytecodeHex": "5b56"}, {"offset": 5, "length": 1, "stackBalance": 0, "bytecodeHex": "00"}, {"offset": 6, "length": 1, "stackBalance": 0, "bytecodeHex": ""}],
  "successors": [{"from": 0, "to": [3, 5, 5]}, {"from": 3, "to": [5]}, {"from": 5, "to": [6]}, {"from": 6, "to": [7, 0]}, {"from": 99, "to": [1]}]}}
node = {"offset": 0, "length": 1, "stackBalance": 0}
bad = {"02": "{not json", "03": {}, "04": {"runtimeCfg": {"nodes": {}, "successors": []}}, "05": {"runtimeCfg": {"nodes": [{"offset": "x", "length": 1, "stackBalance": 0}], "successors": []}},
  "06": {"runtimeCfg": {"nodes": [{"offset": -1, "length": 1, "stackBalance": 0}], "successors": []}}, "07": {"runtimeCfg": {"nodes": [], "successors": []}},
  "08": {"runtimeCfg": {"nodes": [node], "successors": [{"from": 0}]}}, "09": {"runtimeCfg": {"nodes": [node], "successors": [{"from": 0, "to": ["y"]}]}}}
if code == "0a": sys.exit("no luck")
if code == "0b": time.sleep(60)
if code != "0c":
    out = bad.get(code, good)
    open(sys.argv[1], "w").write(out if isinstance(out, str) else json.dumps(out))
"""


def test_external_graphs(spark, tmp_path):
    (tmp_path / "program.py").write_text(PROGRAM)
    codes = spark.createDataFrame([(f"{i:02x}", f"{i:02x}") for i in range(1, 13)], "fp string, code string").repartition(4)
    reports = external.read_reports(external.run_program(codes, [sys.executable, str(tmp_path / "program.py"), "{out}"], 5)).persist()
    modes = {r["fp"]: r["failure_mode"] for r in reports.collect()}
    assert modes == {"01": "", "02": "invalid_json", "03": "missing_runtime_cfg", "04": "invalid_runtime_cfg_schema", "05": "invalid_node_schema", "06": "invalid_node_bounds", "07": "empty_cfg", "08": "invalid_successor_schema", "09": "invalid_successor_schema", "0a": "program_failed", "0b": "program_timeout", "0c": "report_missing"}
    assert reports.where("failure_mode = 'program_failed'").first()["failure_detail"] == "no luck"
    edges = {(r["src"], r["dst"], r["edge_type"]) for r in external.external_edges(reports).collect()}
    assert edges == {(0, 3, "jumpi_false"), (0, 5, "jumpi_true"), (3, 5, "jump"), (5, 6, "terminal"), (6, 7, "fallthrough"), (6, 0, "jump")}
    assert {(r["start_pc"], r["end_pc"], r["node_type"]) for r in external.external_nodes(reports).collect()} == {(0, 2, "basic"), (3, 4, "unknown"), (5, 5, "unknown"), (6, 6, "unknown")}
    reports.unpersist()
    missing = external.run_program(codes.limit(1), ["no-such-program"], 5).first()
    assert (missing["failure_mode"], missing["failure_detail"]) == ("program_missing", "no-such-program")
