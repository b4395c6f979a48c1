"""The tasks of the command line, one after the other, over small files."""

import json

from bytequarry.__main__ import main

RUNTIME = "6001600201600055" + "00" * 4
INIT = "600c600c600039600c6000f3" + RUNTIME


def test_tasks_from_files_to_splits(spark, tmp_path, capsys):
    votes = ["fp_runtime;swc;property_holds;dataset"]
    for i in range(40):
        votes += [f"FP{i};101;{'t' if i % 2 else 'f'};d1", f"fp{i};107; T ;d2", f"fp{i};999;t;d1"]
    (tmp_path / "votes.csv").write_text("\n".join([*votes, "fp0;101;t;d3", ";101;t;d1"]))
    (tmp_path / "hex").mkdir()
    for i in range(40):
        (tmp_path / "hex" / f"fp{i}.rt.hex").write_text("0x" + RUNTIME + f"{i:02x}")
    (tmp_path / "hex" / "odd.rt.hex").write_text("abc")
    build = tmp_path / "build"
    for d in ("dapp1", "dapp2"):
        (build / d).mkdir(parents=True)
        contracts = {"a.sol:Good": {"bin": INIT, "bin-runtime": ""}, "a.sol:Kept": {"bin": "6000", "bin-runtime": RUNTIME + "07"}, "a.sol:None": {"bin": "", "bin-runtime": ""}}
        (build / d / "out.json").write_text(json.dumps({"contracts": contracts}))
        (build / d / "broken.json").write_text("{")
    found = tmp_path / "found" / "dapp1"
    found.mkdir(parents=True)
    (found / "x.json").write_text(json.dumps({"node name": "Good.json", "SWCs": [{"category": "SWC-101-overflow", "function": "f"}, {"category": "no class"}]}))
    (found / "y.json").write_text(json.dumps({"node name": "Kept.json", "SWCs": [{"category": "SWC-107-reentrancy"}]}))
    (tmp_path / "verdict.md").write_text("Verdict: `POS_ONLY`\n")
    p = lambda *parts: str(tmp_path.joinpath(*parts))
    run = lambda *argv: main(["task", *argv]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["rows"]
    read = lambda *parts: spark.read.parquet(p(*parts))

    assert run("profile", "--votes", p("votes.csv"), "--out", p("o", "profile"))["fields"] == 4
    rows = run("curate", "--votes", p("votes.csv"), "--hex", p("hex"), "--out", p("o", "curate"))
    assert rows == {"contracts": 40, "labels": 80, "balance": 2}
    label = {(r["fp"], r["swc_id"]): r["label"] for r in read("o", "curate", "labels").collect()}
    assert label["fp1", 101] == 1 and label["fp2", 101] == 0 and label["fp0", 101] is None and label["fp5", 107] == 1
    assert read("o", "curate", "contracts").where("missing").count() == 0

    assert run("fingerprint", "--hex", p("hex"), "--out", p("o", "a"))["fingerprints"] == 41
    odd = read("o", "a", "fingerprints").where("name = 'odd'").first()
    assert odd["fp"] is None and odd["failure_mode"] == "odd_length_hex"
    assert run("runtime-extract", "--compiler", p("build"), "--out", p("o", "runtimes"))["runtimes"] == 6
    origin = {r["name"]: r["origin"] for r in read("o", "runtimes", "runtimes").collect()}
    assert origin == {f"{d}/{n}": o for d in ("dapp1", "dapp2") for n, o in (("Good", "bin_extracted"), ("Kept", "bin_runtime_fallback"), ("None", ""))}
    assert run("fingerprint", "--compiler", p("build"), "--out", p("o", "b"))["fingerprints"] == 6
    # one code of the compiler output is among the files
    assert run("merge-dedup", "--first", p("o", "a", "fingerprints"), "--second", p("o", "b", "fingerprints"), "--out", p("o", "merged"))["contracts"] == 41
    assert read("o", "merged", "overlap").first()["both"] == 1

    assert run("findings-labels", "--findings", p("found"), "--verdict", p("verdict.md"), "--out", p("o", "findings")) == {"labels": 2, "reports": 1}
    # where the verdict allows it, a finding with a negative marker is a negative
    (found / "z.json").write_text(json.dumps({"node name": "Other.json", "SWCs": [{"category": "SWC-107-x", "result": "Not Vulnerable"}, {"category": "SWC-101-x"}, {"category": "SWC-101-x", "note": "safe"}]}))
    label = lambda verdict: (p("verdict.md"), (tmp_path / "verdict.md").write_text(f"Verdict: `{verdict}`"))[0]
    got = {}
    for verdict in ("POS_ONLY", "POS+NEG_EXPLICIT"):
        run("findings-labels", "--findings", p("found"), "--verdict", label(verdict), "--out", p("o", "other"))
        got[verdict] = {r["swc_id"]: r["label"] for r in read("o", "other", "labels").where("name = 'dapp1/Other'").collect()}
    assert got == {"POS_ONLY": {107: None, 101: 1}, "POS+NEG_EXPLICIT": {107: 0, 101: None}}
    rows = run("label-harmonize", "--first", p("o", "curate", "labels"), "--first-names", p("o", "a", "fingerprints"), "--second", p("o", "findings", "labels"), "--second-names", p("o", "b", "fingerprints"), "--out", p("o", "labels"))
    assert rows["labels"] == 79 + 2 and rows["disagreements"] == 0
    rows = run("class-select", "--labels", p("o", "labels", "labels"), "--classes", "101, 107, 120", "--out", p("o", "classes"))
    assert rows["classes"] == 3
    action = {r["swc_id"]: r["action"] for r in read("o", "classes", "classes").collect()}
    assert action[120] == "drop_low_count" and action[101] == "keep"
    rows = run("split", "--labels", p("o", "labels", "labels"), "--folds", "5", "--out", p("o", "split"))
    assert rows["splits"] == 41 and {r["split"] for r in read("o", "split", "splits").collect()} == {"train", "val", "test"}
    # a second run with --keep leaves the first one's tables alone
    assert run("split", "--labels", p("o", "labels", "labels"), "--folds", "5", "--out", p("o", "split"), "--keep")["splits"] == 41
    assert len(list((tmp_path / "o" / "split").glob("splits*"))) == 2
    report = json.loads(spark.read.text(p("o", "split", "report"), wholetext=True).first()["value"])
    assert report["summary"]["rows"]["splits"] == 41 and report["summary"]["flags"]["folds"] == 5
