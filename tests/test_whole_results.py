"""Results stay whole: many calls and blocks, null keys, split files, time windows, sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spoor.operators import audit, detections, findings, process, report, search
from spoor.plans import process as process_plans
from spoor.plans import registry
from spoor.scale import running_sum
from spoor.sinks import writers
from spoor.sources import blocks, kv, lines, tables, tsv

SF = "/root/testdata/sf0.001"


def test_every_call_is_listed(spark):
    f = spark.createDataFrame(
        [("c", "disk", "f1", "ip", "1.2.3.4", "CONFIRMED", "HIGH", ["T1"], [("a.txt", 1, "x")])],
        "case_id string, module string, finding_id string, entity_type string, entity_value string, verdict string,"
        " severity string, mitre array<string>, evidence array<struct<source_file:string,line:int,content:string>>")
    calls = spark.createDataFrame(
        [("c", i, f"k{i}", "disk/analyst", ["x/analyst.txt"]) for i in range(101)],
        "case_id string, ord int, call_id string, agent_name string, output_files array<string>")
    asked = spark.createDataFrame(
        [], "case_id string, call_id string, query_id string, agent_name string, entity_type string, entity_value string, verdict string")
    index = report.trace_index(f, calls, calls, asked)
    row = index.first()
    assert row.call_ids == [f"k{i}" for i in range(101)] and row.n_calls == 101 and row.mitre == ["T1"]
    assert report.trace_calls(index).count() == 101
    assert "k100" in report.trace_markdown(index).first().row


@pytest.mark.parametrize("small", [True, False])
def test_trace_rows_equal_the_lists_and_hold_none(spark, monkeypatch, small):
    f = spark.createDataFrame(
        [(c, m, f"{m}-chunk_{i % 3}-f{i}", "ip", str(i), None, None, []) for i, (c, m) in enumerate(
            [(c, m) for c in ("a", "b", None, "z") for m in ("disk", "ram") for _ in range(3)])],
        "case_id string, module string, finding_id string, entity_type string, entity_value string, verdict string,"
        " severity string, evidence array<struct<source_file:string,line:int,content:string>>")
    calls = spark.createDataFrame(
        [(c, i // 7, f"k{i}", "x", [f"chunk_{i % 4}/analyst.txt"]) for c in ("a", "b", None) for i in range(40)],
        "case_id string, ord int, call_id string, agent_name string, output_files array<string>")
    asked = spark.createDataFrame(
        [("a", "t1", "q1", None, "ip", "9", "x"), ("a", None, "q2", None, "ip", "9", "x")],
        "case_id string, call_id string, query_id string, agent_name string, entity_type string, entity_value string, verdict string")
    want = report.trace_calls(report.trace_index(f, calls, calls, asked))
    monkeypatch.setattr(report, "CALL_BLOCK", 9)
    monkeypatch.setattr(report, "fits", lambda df: small)
    got = report.trace_rows(f, calls, calls, asked)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.schema["call_pos"].dataType == want.schema["call_pos"].dataType


@pytest.mark.parametrize("small", [True, False])
def test_a_task_of_the_trace_has_few_calls_and_all_their_findings(spark, monkeypatch, small):
    f = spark.range(70).select(
        F.lit("c").alias("case_id"), F.lit("disk").alias("module"), F.concat(F.lit("f"), "id").alias("finding_id"), F.lit("ip").alias("entity_type"),
        F.col("id").cast("string").alias("entity_value"), F.lit("x").alias("verdict"), F.lit("x").alias("severity"),
        F.array(F.struct(F.lit("a").alias("source_file"), F.lit(1).alias("line"), F.lit("t").alias("content"))).alias("evidence"))
    calls = spark.range(256).select(
        F.lit("c").alias("case_id"), F.col("id").alias("ord"), F.concat(F.lit("k"), "id").alias("call_id"), F.lit("x").alias("agent_name"),
        F.array(F.lit("x/analyst.txt")).alias("output_files"))
    asked = spark.createDataFrame(
        [], "case_id string, call_id string, query_id string, agent_name string, entity_type string, entity_value string, verdict string")
    monkeypatch.setattr(report, "CALL_BLOCK", 4)
    monkeypatch.setattr(report, "fits", lambda df: small)
    got = report.trace_rows(f, calls, calls, asked).withColumn("p", F.spark_partition_id()).collect()
    assert {(r.finding_id, r.call_id, r.call_pos) for r in got} == {(f"f{i}", f"k{j}", j) for i in range(70) for j in range(256)}
    assert len(got) == 70 * 256
    seen = {}
    for r in got:
        seen.setdefault(r.p, set()).add(r.call_pos // 4)
    assert max(map(len, seen.values())) <= 16  # of 64 blocks
    # a finding takes a whole block before the next finding comes
    assert all((a.finding_id, a.call_pos + 1) == (b.finding_id, b.call_pos) for a, b in zip(got, got[1:]) if a.call_pos % 4 < 3)


def test_block_ids_do_not_meet(spark):
    text = "\n".join(f"[REJECTED]\nKey: 10.0.0.{i}\n" for i in range(1011))
    got = blocks.parse_verdict_blocks(spark.createDataFrame([(text,)], "text string")).collect()
    assert len({r.finding_id for r in got}) == 1011
    assert {got[0].finding_id, got[998].finding_id, got[1000].finding_id} == {
        "disk-scan-f001", "disk-scan-f999", "disk-scan-f1001"}


def test_report_keeps_all_evidence(spark):
    f = spark.createDataFrame(
        [("ip", "1.2.3.4", 1, "disk", "CONFIRMED", "HIGH", "j", ["T1"], [("a", i, "x") for i in range(60)])],
        "entity_type string, entity_value string, ord int, module string, verdict string, severity string,"
        " justification string, mitre array<string>, evidence array<struct<source_file:string,line:int,content:string>>")
    assert report.report_payload(f).first().document.count('"line"') == 60


def test_null_groups_and_times_are_kept(spark):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, "a", t), (2, None, t), (3, "a", None), (4, None, None)], "call_id int, case_id string, ts timestamp")
    got = {r.call_id: r.step for r in audit.replay(e).collect()}
    assert got == {1: 2, 3: 1, 2: 2, 4: 1}
    f = spark.createDataFrame([(None, 1), (None, 2), ("c", 3)], "chunk string, ord int")
    assert findings.number_findings(f, "ord").count() == 3
    s = running_sum(e, ["case_id"], [F.col("call_id")], F.lit(None).cast("int"), "call_id", "s")
    assert {r.call_id: r.s for r in s.collect()} == {1: 1, 2: 2, 3: 4, 4: 6}


def test_lines_of_cases_do_not_mix(spark, monkeypatch):
    ln = spark.createDataFrame([("a", "f", 1, "run evil.exe"), ("b", "f", 1, "run evil.exe")], "case_id string, source_file string, line_no int, content string")
    keys = spark.createDataFrame([("a", 7, "evil.exe", "word"), ("b", 7, "evil.exe", "word")], "case_id string, finding_id int, term string, mode string")
    for small in (True, False):
        monkeypatch.setattr(search, "fits", lambda df, small=small: small)
        got = search.pivot_hits(keys, ln).collect()
        assert sorted((r.case_id, r.finding_id, r.line_no) for r in got) == [("a", 7, 1), ("b", 7, 1)]
        assert search.pivot_hits(keys.where("case_id = 'a'"), ln).count() == 1


def test_split_size_may_change_between_plan_and_action(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"type=file n={i}\n" for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        df = lines.read_lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        assert {r.line_no: r.content for r in df.collect()} == {i: f"type=file n={i}" for i in range(1, 3001)}
        assert {r.line_no: r.rec["n"] for r in kv.read_kv(spark, str(tmp_path)).collect()} == {i: str(i) for i in range(1, 3001)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def events(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, base + dt.timedelta(seconds=s), src, host, "3") for i, s, src, host in rows],
                                 "id int, time timestamp, src string, computer string, logon_type string")


def test_bursts_are_found_wherever_they_lie(spark):
    burst = [(4625, 250 + 60 * i, "x", "h") for i in range(10)]
    ev = events(spark, burst + [(4625, -86400, "x", "h")] + [(4625, 100 * i, "y", "h") for i in range(9)])
    assert [(r.src, r.failures) for r in detections.brute_force(ev).collect()] == [("x", 10)]
    sweep = events(spark, [(4624, 595 + 5 * i, "x", f"h{i}") for i in range(3)] + [(4624, 400 * i, "y", f"h{i}") for i in range(3)])
    assert [(r.src, r.hosts) for r in detections.lateral_sweep(sweep).collect()] == [("x", 3)]


def test_all_rules_fire(spark):
    got = registry.QUERIES["benign_exclusion_rules"](spark, SF).select("excluded_by").distinct().collect()
    assert {r.excluded_by for r in got} == {r.name for r in process.BENIGN_RULES} | {None}


@pytest.mark.parametrize("name", ["benign_exclusion_rules", "pack_chunks", "text_entropy"])
def test_no_single_task_and_no_nested_loop(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    plan = plan.replace("Scan OneRowRelation", "")
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in plan


def test_tool_tables_from_files(spark, tmp_path):
    case = tmp_path / "case1"
    case.mkdir()
    files = {
        "pstree.txt": "Volatility 3 Framework 2.7.0\n\nPID\tPPID\tImageFileName\tPath\tAudit\tCmd\tWow64\tSessionId\tThreads\tCreateTime\tExitTime\n4\t0\tSystem\t-\t-\t-\tFalse\tN/A\t90\tt\tN/A\n* 300\t4\tsmss.exe\t\\SystemRoot\\System32\\smss.exe\ta\tN/A\tFalse\tN/A\t2\tt\t-\n",
        "psscan.txt": "Volatility 3 Framework 2.7.0\n\nPID\tPPID\tImageFileName\tWow64\tSessionId\tThreads\tCreateTime\tExitTime\n300\t4\tother.exe\tFalse\t0\t1\tt\t-\n666\t4\thidden.exe\tTrue\t1\t0\tt\tt2\n",
        "cmdline.txt": "Volatility 3 Framework 2.7.0\n\nPID\tProcess\tArgs\n300\tsmss.exe\tsmss -a\n666\thidden.exe\t-\n",
        "dlllist.txt": "PID\tName\tPath\tLoadTime\n300\tntdll.dll\tC:\\n.dll\tt\n",
        "handles.txt": "PID\tType\tName\n300\tMutant\tm\n300\t\t\n",
        "privileges.txt": "PID\tPrivilege\tAttributes\n300\tSeDebugPrivilege\tPresent\n300\t\tx\n",
        "netscan.txt": "PID\tProto\tLocalAddr\tLocalPort\tForeignAddr\tForeignPort\tState\n300\tTCPv4\t10.0.0.1\t1\t1.2.3.4\t443\tESTABLISHED\n",
        "getsids.txt": "PID\tSID\tName\n300\tS-1-5-18\tLocal System\n",
    }
    for name, text in files.items():
        (case / name).write_text(text)
    got = tsv.load_process_tables(spark, str(case))
    procs = {r.pid: r for r in got["process"].collect()}
    assert set(procs) == {4, 300, 666} and procs[300].image == "smss.exe"
    assert procs[300].path == "C:\\Windows\\System32\\smss.exe" and procs[300].cmd == "smss -a"
    assert procs[666].discovered_via == "psscan" and procs[666].wow64
    assert {k: got[k].count() for k in ("dll", "handle", "privilege", "net", "sid")} == {
        "dll": 1, "handle": 1, "privilege": 1, "net": 1, "sid": 1}


def test_records_rejects_and_case_state_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a.txt", 1, {"type": "file", "path": "C:\\a b", "q": 'x"y', "n": ""})], "source_file string, line_no int, rec map<string,string>")
    writers.write_kv(rows.select("rec"), str(tmp_path / "kv"))
    assert [r.rec for r in kv.read_kv(spark, str(tmp_path / "kv")).collect()] == [{"type": "file", "path": "C:\\a b", "q": 'x"y'}]
    scored = spark.createDataFrame([("p", 1, ["t"], "rejected"), ("q", 9, ["t"], "kept")], "path string, score int, tags array<string>, disposition string")
    writers.write_rejects(scored, str(tmp_path / "rejects"))
    back = spark.read.json(str(tmp_path / "rejects")).collect()
    assert [(r["path"], r["_score"], r["_anomalies"]) for r in back] == [("p", 1, ["t"])]
    parts = [spark.createDataFrame([(i,)], "x int") for i in range(4)]
    writers.write_case_state(*parts, str(tmp_path / "state"))
    assert [spark.read.json(str(tmp_path / "state" / n)).first().x for n in ("nodes", "edges", "rounds", "cost")] == [0, 1, 2, 3]


def test_call_logs_and_exports_from_files(spark, tmp_path):
    assert tables.read_call_log(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "calls.jsonl").write_text('{"call_id": "a", "tokens_in": 3}\nbroken\n')
    got = tables.read_call_log(spark, str(tmp_path / "calls.jsonl")).collect()
    assert [(r.call_id, r["_corrupt_record"]) for r in got] == [("a", None), (None, "broken")]
    (tmp_path / "x_FileEntries.csv").write_text("Path,SHA256\nc:\\a,AB\n")
    (tmp_path / "x_Other.csv").write_text("Path,SHA256\nc:\\b,CD\n")
    assert [r["Path"] for r in tables.read_csv(spark, str(tmp_path / "x_FileEntries.csv")).collect()] == ["c:\\a"]


def test_recent_files_and_health(spark):
    now = dt.datetime(2024, 2, 1)
    df = spark.createDataFrame([("d/archive-a.evtx", now - dt.timedelta(days=40)), ("d/archive-b.evtx", now - dt.timedelta(days=2)),
                                ("d/system.evtx", now - dt.timedelta(days=400))], "path string, modified timestamp")
    got = {r.path for r in lines.recent_files(df, 30, F.lit(now)).collect()}
    assert got == {"d/archive-b.evtx", "d/system.evtx"}
    text = [("ok.txt", 1, "Volatility 3 Framework 2.7.0"), ("ok.txt", 2, "PID"), ("ok.txt", 3, "4"), ("bad.txt", 1, "# ERROR x"), ("empty.txt", 1, "Volatility 3 Framework 2.7.0"), ("empty.txt", 2, "PID")]
    health = lines.artifact_health(
        spark.createDataFrame(text, "source_file string, line_no int, content string"),
        spark.createDataFrame([(n,) for n in ("ok.txt", "bad.txt", "empty.txt", "gone.txt")], "source_file string"))
    assert {r.source_file: (r.status, r.data_rows) for r in health.collect()} == {
        "ok.txt": ("ok", 1), "bad.txt": ("failed", 0), "empty.txt": ("empty", 0), "gone.txt": ("missing", 0)}


def test_memory_report_lists_the_lines_of_a_pid(spark):
    p = spark.createDataFrame([("42", "4", "a.exe", "a -x"), ("7", "4", "b.exe", None)], "pid string, ppid string, image string, cmdline string")
    ln = spark.createDataFrame([("pslist.txt", 1, "PID 42"), ("pslist.txt", 2, "PID 420"), ("netscan.txt", 5, "x 42 y")], "source_file string, line_no int, content string")
    hits = search.pivot_memory(p, ln, search.file_ranks(spark, ["pslist.txt", "netscan.txt"]))
    got = {r.pid: r.report for r in search.format_memory_pivot(p, hits).collect()}
    assert got["42"] == "=== PID 42 (a.exe, ppid=4) ===\nCmdline: a -x\n\n--- pslist.txt ---\nL1: PID 42\n\n--- netscan.txt ---\nL5: x 42 y\n"
    assert got["7"] == "=== PID 7 (b.exe, ppid=4) ===\n(no matching lines in any artifact file)\n"
    assert process_plans.QUERIES


def test_exclusion_meets_counts_in_as_many_tasks_as_rows_need(spark, monkeypatch):
    want = sorted(map(repr, registry.QUERIES["benign_exclusion_rules"](spark, SF).collect()))
    monkeypatch.setattr(process, "tasks_for", lambda df: 37)
    df = registry.QUERIES["benign_exclusion_rules"](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("37), REPARTITION_BY_NUM") >= 6
    assert sorted(map(repr, df.collect())) == want
