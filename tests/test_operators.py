import re

from pyspark.sql import functions as F

from spoor.operators import events, files, process, search
from spoor.scale import capped_rank, lagged, last_before, ordinal, running_sum
from spoor.sources import kv
from spoor.sources.lines import read_lines


def test_record_lines(spark):
    rows = [
        ("# note",), ("",), ('type=file path="C:\\\\a b\\\\c.exe" size=1 size=2 q="x\\"y"',),
        ("type=event id=4624",),
    ]
    got = kv.parse_kv_lines(spark.createDataFrame(rows, "content string")).collect()
    assert [r.rec for r in got] == [
        {"type": "file", "path": "C:\\a b\\c.exe", "size": "2", "q": 'x"y'},
        {"type": "event", "id": "4624"},
    ]


def test_line_numbers_of_split_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(1, 3001)))
    (tmp_path / "b.txt").write_text("one\n\nthree")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    a = {r.line_no: r.content for r in got if r.source_file == "a.txt"}
    assert a == {i: f"line {i}" for i in range(1, 3001)}
    assert {r.line_no: r.content for r in got if r.source_file == "b.txt"} == {
        1: "one", 2: "", 3: "three"}


def test_hundred_failures_become_one_group(spark):
    rows = [(i, 4625, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", "bob", "1.2.3.4", "3") for i in range(100)]
    rows += [(100, 4625, "2024-01-02 00:00:00", "bob", "5.6.7.8", "3"), (101, 1102, "2024-01-02 00:00:00", "bob", "", "")]
    df = spark.createDataFrame(rows, "ord long, id int, t string, user string, src_ip string, logon_type string")
    got = events.dedup_events(df.withColumn("time", F.col("t").cast("timestamp")).drop("t")).collect()
    assert sorted((r.kind, r["count"], r.src_ip) for r in got) == [
        ("event", 1, ""), ("event_summary", 1, "5.6.7.8"), ("event_summary", 100, "1.2.3.4")]


def test_score_terms(spark):
    cols = "line_no long, path string, entropy double, ads string, created timestamp_ntz, fn_created timestamp_ntz"
    rows = [
        (1, "Users\\a\\AppData\\Roaming\\x.exe", 1.0, "Zone.Identifier", None, None),
        (2, "Windows\\System32\\x.exe", 1.0, "", None, None),
        (3, "Users\\a\\doc.txt", 7.5, "", None, None),
        (4, "$Recycle.Bin\\x.txt", 0.0, "", None, None),
    ]
    got = {r.line_no: r.score for r in files.score_files(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: 4, 2: 0, 3: 3, 4: 0}


def test_paths_with_orphans_and_cycles(spark):
    rows = [("v", 5, 5, "."), ("v", 10, 5, "a"), ("v", 11, 10, "b"), ("v", 12, 99, "c"), ("v", 13, 12, "d"),
            ("v", 20, 22, "x"), ("v", 21, 20, "y"), ("v", 22, 21, "z"), ("v", 3, 21, "tail"),
            ("v", 30, 5, None), ("v", 31, 30, "e")]
    df = spark.createDataFrame(rows, "volume string, idx long, parent long, name string")
    got = {r.idx: r.path for r in files.resolve_paths(df).collect()}
    assert got == {5: "", 10: "a", 11: "a\\b", 12: "<orphan>\\c", 13: "<orphan>\\c\\d",
                   21: "<orphan>\\y", 22: "<orphan>\\y\\z", 20: "<orphan>\\y\\z\\x",
                   3: "<orphan>\\y\\tail", 30: "<no-fn>", 31: "<orphan>\\e"}


def test_packing_matches_a_plain_fold(spark):
    df = spark.range(300).select(
        F.lit("c").alias("case_id"), F.col("id").alias("root_start"), F.col("id").alias("root_pid"),
        F.when(F.col("id") % 37 == 0, 200).otherwise(1 + (F.col("id") * 7919) % 60).alias("tokens"))
    want, chunk, fill, solo = {}, 0, 0, True
    for r in sorted(df.collect(), key=lambda r: r.root_start):
        over = r.tokens > 100
        if solo or over or fill + r.tokens > 100:
            chunk, fill = chunk + 1, 0
        fill, solo = fill + r.tokens, over
        want[r.root_pid] = chunk
    assert {r.root_pid: r.chunk for r in process.pack_chunks(df, 100).collect()} == want


def test_search_against_brute_force(spark, monkeypatch):
    keys = [(1, "loader.exe", "word"), (1, "1.2.3.4", "ip"), (2, "C:\\Temp\\lo", "path"), (3, "type=", "word"), (4, "ab", "path")]
    lines = ["run loader.exe now", "xloader.exe", "from 1.2.3.40", "ip=1.2.3.4;", "at c:\\temp\\LOADER.EXE", "type=file", "type= x", "cab"]
    k = spark.createDataFrame(keys, "finding_id int, term string, mode string")
    ln = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "source_file string, line_no int, content string")
    want = set()
    for f, term, mode in keys:
        pat = re.escape(term) if mode == "path" else rf"\b{re.escape(term)}\b"
        want |= {(f, i) for i, t in enumerate(lines) if re.search(pat, t, re.I)}
    for small in (True, False):
        monkeypatch.setattr(search, "fits", lambda df, small=small: small)
        assert {(r.finding_id, r.line_no) for r in search.pivot_hits(k, ln).collect()} == want


def test_bucketed_windows_match_plain_ones(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), (F.col("id") % 11).alias("v"))
    b = F.floor(F.col("o") / 50)
    got = {r.o: (r.n, r.s, r.p) for r in lagged(
        running_sum(ordinal(df, ["g"], [F.col("o")], b, "n"), ["g"], [F.col("o")], b, "v", "s"),
        ["g"], [F.col("o")], b, F.col("o"), "p").collect()}
    n, s = {}, {}
    for o in range(2000):
        g = o % 3
        n[g], s[g] = n.get(g, 0) + 1, s.get(g, 0) + o % 11
        assert got[o] == (n[g], s[g], o - 3 if o >= 3 else None)
    capped = capped_rank(df, ["g"], [F.col("o")], 5, F.col("o")).collect()
    assert sorted(r.o for r in capped) == list(range(15))


def test_as_of_lookup(spark):
    left = spark.createDataFrame([(1, 100), (1, 205), (2, 50)], "k int, t int")
    right = spark.createDataFrame([(1, 95), (1, 100), (1, 150), (2, 60)], "k int, t int")
    got = {(r.k, r.t): r.previous for r in last_before(left, right, ["k"], F.col("t"), F.col("t"), 60).collect()}
    assert got == {(1, 100): 100.0, (1, 205): 150.0, (2, 50): None}


def test_the_file_filter_reads_each_test_once(spark):
    from spoor.operators.filters import emit_file_filter

    paths = [None, "", "<lost>.bin", "a\\b.txt", "a\\b.EXE", "a\\b.exe\n", "a\\b.bin", "x\\Temp\\b.bin", "x\\temp\\b.mui",
             "a\\b.mui", "Windows\\WinSxS\\Temp\\b.exe", "ProgramData", "ProgramDat\\a.dll"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "id int, tail string").withColumn(
        "path", F.concat(F.lit(""), "tail")
    )

    def ids(**kw):
        return sorted(r["id"] for r in emit_file_filter(df, **kw).select("id").collect())

    assert ids() == [0, 1, 2, 3, 4, 5, 7, 8, 11, 12]
    assert ids(only_suspicious=True) == [0, 1, 2, 4, 5, 7, 8, 11, 12]
    plan = emit_file_filter(df, only_suspicious=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("roaming") == 1
