"""Operators that must hold for long chains, hot keys and large lists, against plain code."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spoor import scale
from spoor.operators import detections, files, graph, prefixes, process
from spoor.session import durable

DAY = datetime(2024, 1, 1)


# ---- forest ----------------------------------------------------------------------


def walk(rows):
    """Pre-order by a stack: (pid, root, depth, position, start, end) of one case."""
    pids = {p for p, _ in rows}
    kids, roots = {}, []
    for p, up in rows:
        if up == 0 or up == p or up not in pids:
            roots.append(p)
        else:
            kids.setdefault(up, []).append(p)
    out, at = [], 0
    for root in sorted(roots):
        start, stack, mine = at, [(root, 0)], []
        while stack:
            p, depth = stack.pop()
            mine.append((p, root, depth, at))
            at += 1
            stack += [(c, depth + 1) for c in sorted(kids.get(p, []), reverse=True)]
        out += [(*m, start, at) for m in mine]
    return sorted(out)


def forest(spark, rows):
    df = spark.createDataFrame([("c", p, up) for p, up in rows], "case_id string, pid bigint, ppid bigint")
    cols = ("pid", "root_pid", "depth", "position", "root_start", "root_end")
    return sorted(tuple(r[c] for c in cols) for r in process.process_forest(df).select(*cols).collect())


def test_forest_of_any_shape(spark):
    rng = random.Random(6)
    pids = rng.sample(range(1, 60_000), 400)
    rows = [(p, rng.choice([0, p, 70_000, *pids[:i]]) if i else 0) for i, p in enumerate(pids)]
    rows += [(80_000, 80_001), (80_001, 80_000), (80_002, 80_000)]  # a cycle and what hangs on it
    rows += [(90_000 + k, pids[0]) for k in range(9000)]  # many children, over several buckets
    assert forest(spark, rows) == walk(rows)
    assert forest(spark, []) == []


def test_forest_of_a_long_chain(spark):
    n = 100_000
    chain = spark.range(1, n + 1).select(F.lit("c").alias("case_id"), F.col("id").alias("pid"), (F.col("id") - 1).alias("ppid"))
    seen = process.process_forest(chain).agg(
        F.count(F.lit(1)), F.max("depth"), F.sum((F.col("position") == F.col("pid") - 1).cast("int")), F.max("root_end")
    ).first()
    assert tuple(seen) == (n, n - 1, n, n)


# ---- windows ---------------------------------------------------------------------


def test_windows_of_seconds_and_of_decades(spark):
    rng = random.Random(2)
    at = lambda s: DAY + timedelta(seconds=s)
    moments = [at(rng.randint(-10**9, 10**9)) for _ in range(300)] + [at(0), at(1), at(0.5), datetime(1960, 1, 1)]
    windows = []
    for k in range(120):
        start = rng.choice(moments) + timedelta(microseconds=rng.choice([-1, 0, 1]))
        length = rng.choice([0, 1, 59, 3600, 10**5, 10**7, 10**9])
        windows.append((k, start, start + timedelta(seconds=length)))
    windows += [(900, at(5), at(1)), (901, None, at(1)), (902, at(1), None)]
    rows = list(enumerate([*moments, None]))
    found = files.in_window(
        spark.createDataFrame(rows, "line_no int, created timestamp"),
        spark.createDataFrame(windows, "window_id int, start timestamp, end timestamp"),
    ).select("line_no", "window_id").collect()
    want = {
        (n, w) for n, t in rows for w, a, b in windows if t and a and b and a <= t <= b
    }
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    cells = spark.createDataFrame(windows, "window_id int, a timestamp, b timestamp").select(
        F.size(files._cells("unix_seconds(a)", "unix_seconds(b)")).alias("n")
    )
    assert cells.agg(F.max("n")).first()[0] <= 2 * 31


# ---- logons ----------------------------------------------------------------------

EV = "ord int, id int, logon_type string, src string, computer string, time timestamp"


def swept(rows, k, within):
    best = {}
    for _, _, _, src, _, t in rows:
        hosts = {c for _, _, _, s, c, u in rows if s == src and c and t - timedelta(seconds=within) <= u <= t}
        if src and len(hosts) >= k:
            n, a, b = best.get(src, (0, t, t))
            best[src] = (max(n, len(hosts)), min(a, t), max(b, t))
    return sorted((s, *v) for s, v in best.items())


def test_sweeps_equal_sets_per_row(spark):
    rng = random.Random(9)
    rows = [
        (n, 4624, "3", rng.choice(["a", "b", "c", None]), rng.choice(["h1", "h2", "h3", "h4", None]), DAY + timedelta(seconds=rng.choice([1, 10, 600]) * rng.randint(0, 400)))
        for n in range(500)
    ]
    for k, within in ((2, 60), (3, 600), (4, 86_400)):
        found = detections.lateral_sweep(spark.createDataFrame(rows, EV), k, within).collect()
        assert sorted(map(tuple, found)) == swept(rows, k, within)


def test_sweep_of_one_busy_source(spark):
    n = 1_000_000
    ev = spark.range(n).select(
        F.lit(4624).alias("id"), F.lit("3").alias("logon_type"), F.lit("s").alias("src"),
        F.concat(F.lit("h"), (F.floor(F.col("id") / 1000) % 50).cast("string")).alias("computer"),
        F.timestamp_millis(F.col("id") * 100).alias("time"),
    )
    # 1,000 logons of a host take 100 s; 600 s reach back over six whole hosts and the start of a seventh
    assert [r["hosts"] for r in detections.lateral_sweep(ev, 3, 600).collect()] == [7]


# ---- names -----------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_names_equal_all_distances(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
    known = sorted({word() for _ in range(80)} | {"svchost.exe"})
    names = sorted({word() for _ in range(80)} | {"svch0st.exe", "scvhost.exe", "svchost.ex", "x" * 3000})
    one = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None]], "name string")
    for most in (1, 2):
        found = {tuple(r) for r in detections.near_names(one(names), one(known), most).collect()}
        assert found == {(a, b, d) for a in names if len(a) < 99 for b in known if 1 <= (d := edits(a, b)) <= most}


# ---- lists -----------------------------------------------------------------------


def test_prefixes_equal_plain_starts(spark):
    rng = random.Random(3)
    part = lambda: rng.choice(["a", "ab", "abc", "b", "C", "windows", "x y"])
    path = lambda n: "".join(part() + rng.choice(["\\", "/", "\\", ""]) for _ in range(n))
    listed = [path(rng.randint(1, 3)) for _ in range(60)] + ["C:\\Windows\\", "//b/"]
    paths = [rng.choice(["", "c:\\", "D:/", '"']) + path(rng.randint(1, 6)) for _ in range(300)] + ["", None, "a" * 5000]
    plain = lambda p: __import__("re").sub(r'^[" ]*([a-z]:)?\\*', "", p.strip().lower().replace("/", "\\"))
    keys = {plain(p) for p in listed}
    want = {}
    for p in paths:
        fit = [k for k in keys if p is not None and plain(p).startswith(k)]
        if fit:
            want[p] = max(fit, key=len)
    table = spark.createDataFrame([(p,) for p in listed], "prefix string")
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"]: r["prefix"] for r in prefixes.longest_prefix(rows, table).collect()} == want
    kept = [r["path"] for r in prefixes.drop_prefixed(rows, table).collect()]
    assert sorted(map(str, kept)) == sorted(str(p) for p in paths if p not in want)
    assert prefixes.longest_prefix(rows, table.limit(0)).count() == 0


def test_a_million_prefixes(spark):
    table = spark.range(1_000_000).select(
        F.concat(F.lit("C:\\Vendor\\"), (F.col("id") % 1000).cast("string"), F.lit("\\p"), F.col("id").cast("string")).alias("prefix")
    )
    paths = spark.createDataFrame([(f"c:/vendor/{k}/p{k}0{k}/x.exe",) for k in (1, 77, 500)], "path string")
    found = {r["path"]: r["prefix"] for r in prefixes.longest_prefix(paths, table).collect()}
    assert found == {"c:/vendor/1/p101/x.exe": "vendor\\1\\p1", "c:/vendor/77/p77077/x.exe": "vendor\\77\\p77077", "c:/vendor/500/p5000500/x.exe": "vendor\\500\\p500"}


def test_a_large_hash_list_is_filtered_before_the_shuffle(spark, monkeypatch):
    names = spark.range(20_000).select(F.concat(F.lit("H"), F.col("id").cast("string")).alias("hash"))
    rows = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, F.concat(F.lit("h"), (F.col("id") * 20).cast("string"))).alias("hash"))
    small = {r["id"]: r["known_good"] for r in files.known_good(rows, names).collect()}
    monkeypatch.setattr(files, "fits", lambda *a: False)
    large = files.known_good(rows, names)
    assert {r["id"]: r["known_good"] for r in large.collect()} == small
    assert sum(small.values()) == 900
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "_bits" in plan
    # few of the files that are not listed pass the filter
    word, mask = files._bloom(F.lower("hash"), 5000)
    bits = names.select(F.lower("hash").alias("_h")).withColumns(dict(zip(("_word", "_mask"), files._bloom(F.col("_h"), 5000))))
    bits = bits.groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    passed = rows.where("id >= 1000 and hash is not null").withColumns({"_word": word, "_mask": mask}).join(bits, "_word")
    assert passed.where(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")).count() < 0.1 * 3600


# ---- rounds ----------------------------------------------------------------------


def naive(findings, caps, answer, max_rounds):
    """Every round from all findings."""
    log, state = [], findings
    known = graph.mentions(state).select("type", "value").distinct().count()
    for number in range(1, max_rounds + 1):
        queries = durable(graph.route(graph.candidates(graph.build_nodes(state)), caps))
        sent = queries.count()
        if not sent:
            return state, log, "convergence"
        state = durable(state.unionByName(answer(queries, number)))
        now = graph.mentions(state).select("type", "value").distinct().count()
        log.append((number, sent, now - known))
        known = now
    return state, log, "max_rounds_reached"


@pytest.mark.parametrize("max_rounds", [2, 4])
def test_rounds_on_the_frontier_equal_rounds_on_all(spark, max_rounds):
    kind = "array<struct<type:string,value:string,relationship:string>>"
    schema = f"ord bigint, module string, finding_id string, entity_type string, entity_value string, verdict string, severity string, related {kind}"
    start = [
        (1, "disk", "f1", "ip", "a", "INCONCLUSIVE", None, [("ip", "b", "r")]), (2, "ram", "f2", "ip", "b", "NOT_FOUND", None, []),
        (3, "disk", "f3", "ip", "c", "CONFIRMED", "HIGH", []), (4, "disk", "f4", "ip", None, "INCONCLUSIVE", None, []),
        (5, "disk", "f5", "host", "z", "INCONCLUSIVE", None, []),
    ]
    caps = graph.capabilities(spark, {"disk": ["ip"], "ram": ["ip"], "ti": ["ip"]})

    def answer(queries, number):
        # some queries stay without an answer, some open a new entity, some close theirs
        low = F.coalesce(F.col("value"), F.lit("n"))
        pick = F.pmod(F.xxhash64(low, "module"), F.lit(4))
        asked = queries.where(pick > 0).select(
            (F.lit(100 * number) + pick).alias("ord"), "module", F.lit(None).cast("string").alias("finding_id"),
            F.col("type").alias("entity_type"), F.col("value").alias("entity_value"),
            F.when(pick == 1, "REJECTED").otherwise("INCONCLUSIVE").alias("verdict"), F.lit(None).cast("string").alias("severity"),
            F.array().cast(kind).alias("related"), pick.alias("p"))
        more = asked.where("p = 2 and length(entity_value) < 5").withColumns(
            {"entity_value": F.concat("entity_value", F.lit("+")), "module": F.lit("disk")})
        return asked.unionByName(more).drop("p")

    findings = spark.createDataFrame(start, schema)
    want, log, reason = naive(findings, caps, answer, max_rounds)
    state, rounds, stopped = graph.investigate(findings, caps, answer, max_rounds)
    assert (sorted(map(tuple, rounds.collect())), stopped) == (log, reason)
    assert sorted(map(repr, state.collect())) == sorted(map(repr, want.select(*graph.FINDING).collect()))


def test_a_product_of_prefixes_equals_the_list_of_its_pairs(spark):
    heads = spark.createDataFrame([(f"//Data/x{i}/f", i % 3) for i in range(12)], "head string, k int")
    tails = spark.createDataFrame([(str(i), i % 3) for i in range(150)], "tail string, k int")
    table = spark.createDataFrame([("c:/data/", "all"), ("data/x1/f13", "a"), ("data/x2/f14", "z")], "prefix string, rule string")
    paths = spark.createDataFrame(
        [(f"D:\\DATA\\x{i}\\f{j}.exe",) for i in range(14) for j in range(0, 1500, 7)] + [("Data\\x1\\f",), ("q",), (None,)], "path string")
    pairs = heads.join(tails, "k").select(F.concat("head", "tail").alias("prefix"), F.lit("part").alias("rule"))
    want = prefixes.prefix_rules(paths, table.unionByName(pairs)).collect()
    product = prefixes.Product(heads, tails, ["k"], "part")
    got = prefixes.prefix_rules(paths, table, products=[product]).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r["rule"] for r in got} == {None, "all", "a", "part"}
    longest = prefixes.longest_prefix(paths, table, products=[product]).collect()
    assert {tuple(r) for r in longest} == {(r["path"], r["prefix"]) for r in want if r["prefix"]}


@pytest.mark.parametrize("hot, inline, small", [(3, 4, False), (3, 64, True), (500_000, 4, False)])
def test_rules_meet_paths_only_as_far_as_prefixes_reach(spark, monkeypatch, hot, inline, small):
    rng = random.Random(2)
    name = lambda: rng.choice(["a", "ab", "b", "C", "é", "x y", "a1", "a12"])
    text = lambda n: "".join(name() + rng.choice(["\\", "/", "\\", ""]) for _ in range(n))
    plain = lambda p: __import__("re").sub(r'^[" ]*([a-z]:)?\\*', "", p.strip(" ").lower().replace("/", "\\"))
    listed = [(text(rng.randint(1, 3)), rng.choice("pqr")) for _ in range(40)] + [("C:/Only/", "one"), ("C:/Only/", "more"), (None, "z")]
    heads = [(f"//Data/{i}/f", i % 3) for i in range(9)] + [("a/ab", 1)]
    tails = [(t, i % 3) for i, t in enumerate(["1", "12", "123", "\\b", "/a1", "x y"])] + [(None, 0)]
    paths = [rng.choice(["", "c:\\", '"D:/']) + text(rng.randint(1, 6)) for _ in range(300)] + [None, None, "", "\\", "Only\\"] + [
        f"E:/only/x{i}.txt" for i in range(20)] + [f"data\\{i}\\F{j}" for i in range(12) for j in ("1", "123x", "12\\b", "/b", "x y")]
    rules = {}
    for prefix, rule in listed:
        if prefix is not None:
            rules[plain(prefix)] = min(rule, rules.get(plain(prefix), "~"))
    for head, k in heads:
        for tail, link in tails:
            if tail is not None and k == link:
                key = plain(head) + tail.replace("/", "\\")
                rules[key] = min("pair", rules.get(key, "~"))
    want = []
    for i, p in enumerate(paths):
        best = max((k for k in rules if p is not None and plain(p).startswith(k)), key=len, default=None)
        want.append((i, p, best, rules.get(best)))
    for what, value in (("HOT_ROWS", hot), ("INLINE", inline)):
        monkeypatch.setattr(prefixes, what, value)
    if not small:
        monkeypatch.setattr(prefixes, "small_side", lambda df: df)
    df = spark.createDataFrame(list(enumerate(paths)), "i int, path string")
    table = spark.createDataFrame(listed, "prefix string, rule string")
    product = prefixes.Product(spark.createDataFrame(heads, "head string, k int"), spark.createDataFrame(tails, "tail string, k int"), ["k"], "pair")
    got = prefixes.prefix_rules(df, table, products=[product])
    assert sorted(map(tuple, got.collect())) == want
    assert "hashpartitioning(path" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r["path"]: r["prefix"] for r in prefixes.longest_prefix(df, table, products=[product]).collect()}
    assert found == {p: best for _, p, best, _ in want if best is not None}
    only = {k for k in map(plain, (p for p, _ in listed if p is not None))}
    kept = prefixes.drop_prefixed(df, table).collect()
    assert sorted(map(tuple, kept)) == [(i, p) for i, p in enumerate(paths) if p is None or not any(plain(p).startswith(k) for k in only)]


def test_entropy_takes_bytes_without_writing_them_as_text(spark):
    import math
    from collections import Counter

    from spoor.operators import files

    texts = [(1, "Grüße aus aaaa"), (2, "a"), (3, ""), (4, None), (5, "xyz" * 5000 + "é" * 777)]
    found = files.entropy(spark.createDataFrame(texts, "i int, t string"), ["i"], "t")
    want = {}
    for i, t in texts:
        if t:
            b = t.encode()
            want[i] = round(abs(-sum(n / len(b) * math.log2(n / len(b)) for n in Counter(b).values())), 3)
    assert {r["i"]: r["entropy"] for r in found.collect()} == want
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_task_definitions_are_dealt_to_all_cores(spark):
    from spoor.sources import markup

    xml = "<Task><Actions><Exec><Command>c</Command></Exec></Actions></Task>"
    one = spark.range(40).select("id", F.lit(xml).alias("x"), F.lit("/t/T").alias("p")).coalesce(1)
    got = markup.flatten_task_xml(one, "x", "p")
    assert got.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert [r["action"] for r in got.collect()] == ["c"] * 40


# ---- connections and child lists -------------------------------------------------


def test_connections_merge_without_sorting_texts(spark):
    rng = random.Random(19)
    rows = [("c", 1 + i % 3, f"10.0.0.{rng.randrange(4)}", rng.choice(["", None, "CLOSED", "LISTEN", "SYN"]),
             rng.choice(["netstat", "netscan", None]), rng.randrange(10_000) * 500 + i) for i in range(400)]
    net = spark.createDataFrame(rows, "case_id string, pid bigint, foreign_addr string, state string, source string, line_no bigint")
    net = net.withColumns({"proto": F.lit("TCP"), "local_addr": F.lit("a"), "local_port": F.lit("1"), "foreign_port": F.lit("2")})
    want = {}
    for key in {r[:3] for r in rows}:
        mine = [r for r in rows if r[:3] == key]
        rank = lambda r: ({None: 0, "netscan": 1, "netstat": 2}[r[4]], r[5])
        named = [r for r in mine if r[3]]
        best = [r for r in named if r[4] == "netstat"] or named
        first = min(mine, key=rank)
        want[key] = (min(best, key=rank)[3] if best else "", {0: None, 1: False, 2: True}[rank(first)[0]], first[5])
    df = process.merge_net(net)
    assert {(r.case_id, r.pid, r.foreign_addr): (r.state, *r.ord) for r in df.collect()} == want
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_only_the_lists_wanted_are_made(spark):
    made = lambda rows, cols: spark.createDataFrame([("c", 1, *r) for r in rows], "case_id string, pid bigint, line_no bigint, " + cols)
    tables = {
        "process": made([(1, "a.exe")], "image string"),
        "dll": made([(5, "", "B.dll"), (3, "", "a.dll"), (4, "", "b.dll"), (9, "x", "a.dll"), (2, "", None)], "path string, name string"),
        "sid": made([(7, "S-2", "n"), (6, "s-2", "m"), (8, "S-1", None), (9, "s-2", "m"), (9, None, "z")], "sid string, name string"),
        "handle": made([(2, "File", "q"), (1, "File", "")], "type string, name string"),
        "privilege": made([], "privilege string, attributes string"),
    }  # no connections: they are not asked for
    df = process.assemble_process(tables, ["dlls", "handles", "sids"])
    assert "nets" not in df.columns and "privs" not in df.columns
    row = df.first()
    assert row.dlls == ["a.dll", "b.dll", "x"] and row.handles == ["File", "File|q"]
    assert [tuple(s) for s in row.sids] == [("s-2", "m"), ("S-1", None), (None, "z")]
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


# ---- counts of processes ---------------------------------------------------------


def test_counts_are_made_in_as_many_tasks_as_rows_need(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b"]), i, rng.choice([None, *range(12)]), rng.choice(["System", "smss.exe", "fontdrvhost.ex"]),
             rng.choice([None, 0, 1]), rng.choice(["", "gone"])) for i in range(300)]
    proc = spark.createDataFrame(rows, "case_id string, pid bigint, ppid bigint, image string, session int, exit_time string")
    proc = proc.withColumns({"path": F.lit(""), "cmd": F.lit("")})
    assert scale.tasks_for(proc, 10) == 30 and scale.tasks_for(proc) == spark.sparkContext.defaultParallelism
    plain = process.instance_counts(process.with_parent(proc))
    dealt = process.instance_counts(process.with_parent(proc, 30), 30)
    for name, counts in plain.items():
        assert sorted(map(repr, counts.collect())) == sorted(map(repr, dealt[name].collect()))
        plan = dealt[name]._jdf.queryExecution().executedPlan().toString()
        assert name in ("parent", "children") or "30), REPARTITION_BY_NUM" in plan
