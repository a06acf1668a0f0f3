"""Process operators over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor import rules
from spoor.operators import detections as det
from spoor.operators import filters as flt
from spoor.operators import process as ops
from spoor.plans.bindings import PROCESSES, duck_sql, load, oracle, run_sql, view
from spoor.scale import tasks_for
from spoor.sources import tsv

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None, *views: str):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql, *views)
        return f

    return keep


@register("with_parent", """
SELECT p.case_id, p.pid, lower(q.image) AS parent_image, lower(q.path) AS parent_path, lower(q.cmd) AS parent_cmd
FROM proc p LEFT JOIN proc q ON q.case_id = p.case_id AND q.pid = p.ppid""", "proc")
def with_parent(spark, sf):
    return ops.with_parent(view(spark, sf, "proc")).select(
        "case_id", "pid", "parent_image", "parent_path", "parent_cmd")


@register("instance_counts", """
SELECT case_id, lower(image) AS image_low, count(*) AS n_total, count(*) FILTER (exit_time = '') AS n_alive FROM proc GROUP BY ALL""", "proc")
def instance_counts(spark, sf):
    return ops.instance_counts(ops.with_parent(view(spark, sf, "proc")))["image"]



_EXCLUDED = """
WITH b AS (SELECT p.*, lower(p.image) AS im, lower(p.path) AS pa, lower(p.cmd) AS cm, p.exit_time = '' AS alive,
    lower(q.image) AS pim, lower(q.path) AS ppa
  FROM proc p LEFT JOIN proc q ON q.case_id = p.case_id AND q.pid = p.ppid),
f AS (SELECT *, count(*) OVER (PARTITION BY case_id, im) AS n_total,
  count(*) FILTER (alive) OVER (PARTITION BY case_id, im) AS n_alive,
  count(*) OVER (PARTITION BY case_id, im, session) AS n_session,
  count(*) FILTER (alive) OVER (PARTITION BY case_id, im, session) AS n_session_alive,
  count(*) OVER (PARTITION BY case_id, im, ppid) AS n_parent,
  count(*) FILTER (im = 'smss.exe' AND pim = 'system') OVER (PARTITION BY case_id) AS n_sys,
  'c:' || chr(92) || 'windows' || chr(92) || 'system32' || chr(92) AS sys
  FROM b)
SELECT case_id, pid, CASE
  WHEN wow64 THEN NULL
  WHEN im = 'system' AND pid = 4 AND ppid = 0 AND pa = '' AND session IS NULL AND n_total = 1 THEN 'system'
  WHEN im = 'smss.exe' AND pa = sys || 'smss.exe' AND pim = 'system' AND session IS NULL AND n_sys = 1 THEN 'smss_root'
  WHEN im = 'smss.exe' AND pa = sys || 'smss.exe' AND pim = 'smss.exe' AND NOT alive AND threads = 0 THEN 'smss_copy'
  WHEN im = 'csrss.exe' AND pa = sys || 'csrss.exe' AND coalesce(pim, 'smss.exe') = 'smss.exe' AND cm = ''
    AND (session IS NULL OR n_session <= 1) THEN 'csrss'
  WHEN im = 'wininit.exe' AND pa = sys || 'wininit.exe' AND coalesce(pim, 'smss.exe') = 'smss.exe' AND session = 0 AND n_alive = 1 THEN 'wininit'
  WHEN im = 'winlogon.exe' AND pa = sys || 'winlogon.exe' AND coalesce(pim, 'smss.exe') = 'smss.exe' AND session >= 1
    AND n_session_alive <= 1 THEN 'winlogon'
  WHEN im = 'services.exe' AND pa = sys || 'services.exe' AND pim = 'wininit.exe' AND session = 0 AND n_alive = 1 THEN 'services'
  WHEN im = 'lsass.exe' AND pa = sys || 'lsass.exe' AND pim = 'wininit.exe' AND session = 0 AND n_alive = 1
    AND NOT EXISTS (SELECT 1 FROM proc c WHERE c.case_id = f.case_id AND c.ppid = f.pid) THEN 'lsass'
  WHEN im = 'svchost.exe' AND pa = sys || 'svchost.exe' AND pim = 'services.exe' AND session = 0 AND alive AND contains(cm, '-k') THEN 'svchost_alive'
  WHEN im = 'svchost.exe' AND pa = sys || 'svchost.exe' AND pim = 'services.exe' AND session = 0 AND NOT alive AND threads = 0 THEN 'svchost_exited'
  WHEN im = 'fontdrvhost.ex' AND pa = sys || 'fontdrvhost.exe' AND pim IN ('wininit.exe', 'winlogon.exe') AND n_parent <= 1 THEN 'fontdrvhost'
  WHEN im = 'dwm.exe' AND pa = sys || 'dwm.exe' AND pim = 'winlogon.exe' AND session >= 1 AND n_session_alive <= 1 THEN 'dwm'
  WHEN im = 'conhost.exe' AND pa = sys || 'conhost.exe' AND (cm = '' OR ends_with(cm, '0x4')) AND starts_with(ppa, 'c:' || chr(92) || 'windows') THEN 'conhost'
  END AS excluded_by FROM f"""


@register("benign_exclusion", _EXCLUDED, "proc")
def benign_exclusion(spark, sf):
    return ops.exclude_benign(view(spark, sf, "proc")).select("case_id", "pid", "excluded_by")


# one snapshot per customer: a process for each known-benign rule, some of them spoilt.
# n, pid, ppid, image, folder, file, session, threads, exited, cmd
_SNAPSHOT = """
SELECT CAST(c_custkey AS STRING) AS case_id, CAST(pid + dup * 10000 AS BIGINT) AS pid, CAST(ppid AS BIGINT) AS ppid, image,
  CASE WHEN n = spoilt AND how = 0 THEN 'd:/x.exe' WHEN file = '' THEN '' ELSE
    replace(CASE folder WHEN 0 THEN 'C:/Windows/System32/' WHEN 1 THEN 'C:/Windows/System32/wbem/' ELSE 'D:/apps/' END, '/', chr(92)) || file END AS path,
  n = spoilt AND how = 1 AS wow64, CASE WHEN n = spoilt AND how = 2 THEN 7 ELSE session END AS session,
  CASE WHEN n = spoilt AND how = 3 THEN 3 ELSE threads END AS threads,
  CASE WHEN (n = spoilt AND how = 3) <> (gone = 1) THEN '2024-01-01' ELSE '' END AS exit_time,
  CASE WHEN n = spoilt AND how = 4 THEN 'other' ELSE replace(cmd, '/', CASE WHEN n = 5 THEN chr(92) ELSE '/' END) END AS cmd
FROM (SELECT c_custkey, c_custkey % 29 AS spoilt, c_custkey % 5 AS how, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 31 ELSE 0 END AS twice FROM {customer}) c
CROSS JOIN (SELECT * FROM (VALUES
  (1, 4, 0, 'System', 0, '', NULL, 90, 0, ''), (2, 60, 4, 'MemCompression', 0, '', NULL, 9, 0, ''),
  (3, 300, 4, 'smss.exe', 0, 'smss.exe', NULL, 2, 0, ''), (4, 310, 300, 'smss.exe', 0, 'smss.exe', 0, 0, 1, ''),
  (5, 400, 310, 'csrss.exe', 0, 'csrss.exe', 0, 9, 0, '%SystemRoot%/system32/csrss.exe ObjectDirectory=/Windows'),
  (6, 410, 311, 'csrss.exe', 0, 'csrss.exe', 1, 9, 0, ''), (7, 420, 310, 'wininit.exe', 0, 'wininit.exe', 0, 3, 0, ''),
  (8, 430, 311, 'winlogon.exe', 0, 'winlogon.exe', 1, 3, 0, ''), (9, 500, 420, 'services.exe', 0, 'services.exe', 0, 9, 0, ''),
  (10, 510, 420, 'lsass.exe', 0, 'lsass.exe', 0, 9, 0, ''), (11, 600, 500, 'svchost.exe', 0, 'svchost.exe', 0, 9, 0, 'svchost.exe -k DcomLaunch'),
  (12, 610, 500, 'svchost.exe', 0, 'svchost.exe', 0, 0, 1, ''), (13, 520, 420, 'fontdrvhost.ex', 0, 'fontdrvhost.exe', 0, 5, 0, ''),
  (14, 530, 430, 'fontdrvhost.ex', 0, 'fontdrvhost.exe', 1, 5, 0, ''), (15, 540, 430, 'dwm.exe', 0, 'dwm.exe', 1, 5, 0, ''),
  (16, 550, 430, 'LogonUI.exe', 0, 'LogonUI.exe', 1, 5, 0, ''), (17, 620, 500, 'spoolsv.exe', 0, 'spoolsv.exe', 0, 5, 0, ''),
  (18, 630, 500, 'msdtc.exe', 0, 'msdtc.exe', 0, 5, 0, ''), (19, 640, 500, 'SearchIndexer.', 0, 'SearchIndexer.exe', 0, 5, 0, 'SearchIndexer.exe /Embedding'),
  (20, 700, 600, 'WmiPrvSE.exe', 1, 'WmiPrvSE.exe', 0, 5, 0, ''), (21, 710, 600, 'unsecapp.exe', 1, 'unsecapp.exe', 0, 5, 0, 'unsecapp.exe -Embedding'),
  (22, 720, 600, 'dllhost.exe', 0, 'dllhost.exe', 0, 5, 0, 'dllhost.exe /Processid:{{12345678-ABCD-0000-1111-0123456789ab}}'),
  (23, 730, 720, 'conhost.exe', 0, 'conhost.exe', 0, 5, 0, 'conhost.exe 0x4'), (24, 900, 899, 'explorer.exe', 2, 'explorer.exe', 1, 40, 0, ''),
  (25, 740, 900, 'conhost.exe', 0, 'conhost.exe', 1, 5, 0, 'conhost.exe 0x4'), (26, 650, 500, 'svchost.exe', 0, 'svchost.exe', 0, 9, 0, 'svchost.exe'),
  (27, 720001, 600, 'dllhost.exe', 0, 'dllhost.exe', 0, 5, 0, 'dllhost.exe /Processid:x'), (28, 560, 510, 'cmd.exe', 2, 'cmd.exe', 0, 1, 0, ''))
  v(n, pid, ppid, image, folder, file, session, threads, gone, cmd)) t
CROSS JOIN (SELECT * FROM (VALUES (0), (1)) w(dup)) d
WHERE (dup = 0 OR n = twice) AND (n <> 28 OR c_custkey % 4 = 0)
"""

_FACTS = """
WITH proc AS (""" + _SNAPSHOT.replace("{customer}", "customer").replace("{{", "{").replace("}}", "}") + """),
low AS (SELECT *, lower(image) AS im, CASE lower(image) WHEN 'searchindexer.' THEN 'searchindexer.exe' WHEN 'fontdrvhost.ex' THEN 'fontdrvhost.exe'
  ELSE lower(image) END AS fu, lower(path) AS pa, lower(cmd) AS cm, exit_time = '' AS alive FROM proc),
b AS (SELECT p.*, q.fu AS pim, q.pa AS ppa, q.cm AS pcm FROM low p LEFT JOIN low q ON q.case_id = p.case_id AND q.pid = p.ppid),
f AS (SELECT *, count(*) OVER (PARTITION BY case_id, im) AS n_total, count(*) FILTER (alive) OVER (PARTITION BY case_id, im) AS n_alive,
  count(*) OVER (PARTITION BY case_id, fu, session) AS n_session, count(*) FILTER (alive) OVER (PARTITION BY case_id, fu, session) AS n_session_alive,
  count(*) OVER (PARTITION BY case_id, fu, ppid) AS n_parent, count(*) FILTER (fu = 'smss.exe' AND pim = 'system') OVER (PARTITION BY case_id) AS n_sys,
  (SELECT count(*) FROM proc c WHERE c.case_id = b.case_id AND c.ppid = b.pid) AS kids,
  pa = 'c:' || chr(92) || 'windows' || chr(92) || 'system32' || chr(92) || fu AS sys,
  pa = 'c:' || chr(92) || 'windows' || chr(92) || 'system32' || chr(92) || 'wbem' || chr(92) || fu AS wbem FROM b)"""


@register("benign_exclusion_rules", _FACTS + """
SELECT case_id, pid, CASE
  WHEN wow64 THEN NULL
  WHEN fu = 'system' AND pid = 4 AND ppid = 0 AND pa = '' AND session IS NULL AND n_total = 1 THEN 'system'
  WHEN fu = 'memcompression' AND ppid = 4 AND pa = '' AND session IS NULL AND n_total = 1 THEN 'memcompression'
  WHEN fu = 'smss.exe' AND sys AND pim = 'system' AND session IS NULL AND n_sys = 1 THEN 'smss_root'
  WHEN fu = 'smss.exe' AND sys AND pim = 'smss.exe' AND NOT alive AND threads = 0 THEN 'smss_copy'
  WHEN fu = 'csrss.exe' AND sys AND coalesce(pim, 'smss.exe') = 'smss.exe' AND (session IS NULL OR n_session <= 1) AND (cm = '' OR
    (starts_with(cm, '%systemroot%' || chr(92) || 'system32' || chr(92) || 'csrss.exe') AND contains(cm, 'objectdirectory=' || chr(92) || 'windows'))) THEN 'csrss'
  WHEN fu = 'wininit.exe' AND sys AND coalesce(pim, 'smss.exe') = 'smss.exe' AND session = 0 AND n_alive = 1 THEN 'wininit'
  WHEN fu = 'winlogon.exe' AND sys AND coalesce(pim, 'smss.exe') = 'smss.exe' AND session >= 1 AND n_session_alive <= 1 THEN 'winlogon'
  WHEN fu = 'services.exe' AND sys AND pim = 'wininit.exe' AND session = 0 AND n_alive = 1 THEN 'services'
  WHEN fu = 'lsass.exe' AND sys AND pim = 'wininit.exe' AND session = 0 AND n_alive = 1 AND kids = 0 THEN 'lsass'
  WHEN fu = 'svchost.exe' AND sys AND pim = 'services.exe' AND session = 0 AND alive AND contains(cm, '-k') THEN 'svchost_alive'
  WHEN fu = 'svchost.exe' AND sys AND pim = 'services.exe' AND session = 0 AND NOT alive AND threads = 0 THEN 'svchost_exited'
  WHEN fu = 'fontdrvhost.exe' AND sys AND pim IN ('wininit.exe', 'winlogon.exe') AND n_parent <= 1 THEN 'fontdrvhost'
  WHEN fu = 'dwm.exe' AND sys AND pim = 'winlogon.exe' AND session >= 1 AND n_session_alive <= 1 THEN 'dwm'
  WHEN fu = 'logonui.exe' AND sys AND pim = 'winlogon.exe' AND session >= 1 THEN 'logonui'
  WHEN fu = 'spoolsv.exe' AND sys AND pim = 'services.exe' AND session = 0 AND n_alive = 1 THEN 'spoolsv'
  WHEN fu = 'msdtc.exe' AND sys AND pim = 'services.exe' AND session = 0 AND n_alive = 1 THEN 'msdtc'
  WHEN fu = 'searchindexer.exe' AND sys AND pim = 'services.exe' AND session = 0 AND n_alive = 1 AND (cm = '' OR contains(cm, '/embedding')) THEN 'searchindexer'
  WHEN fu = 'wmiprvse.exe' AND wbem AND pim = 'svchost.exe' AND session = 0 AND (coalesce(pcm, '') = '' OR contains(pcm, 'dcomlaunch')) THEN 'wmiprvse'
  WHEN fu = 'unsecapp.exe' AND wbem AND pim = 'svchost.exe' AND (cm = '' OR contains(cm, '-embedding')) THEN 'unsecapp'
  WHEN fu = 'dllhost.exe' AND sys AND pim = 'svchost.exe' AND regexp_matches(cm, '/processid:[{][0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}[}]') THEN 'dllhost'
  WHEN fu = 'conhost.exe' AND sys AND (cm = '' OR ends_with(cm, '0x4') OR ends_with(cm, '0x0')) AND starts_with(ppa, 'c:' || chr(92) || 'windows') THEN 'conhost'
  END AS excluded_by FROM f""")
def benign_exclusion_rules(spark, sf):
    proc = run_sql(spark, sf, _SNAPSHOT)
    return ops.exclude_benign(proc).select("case_id", "pid", "excluded_by")


@register("instance_counts_all", _FACTS + """
SELECT 'image' AS kind, case_id, im AS name, NULL::BIGINT AS k, count(*) AS n, count(*) FILTER (alive) AS alive FROM b GROUP BY ALL
UNION ALL SELECT 'session', case_id, fu, session, count(*), count(*) FILTER (alive) FROM b WHERE session IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'parent', case_id, fu, ppid, count(*), NULL FROM b GROUP BY ALL
UNION ALL SELECT 'children', case_id, NULL, ppid, count(*), NULL FROM b GROUP BY ALL
UNION ALL SELECT 'system_child', case_id, NULL, NULL, count(*), NULL FROM b WHERE fu = 'smss.exe' AND pim = 'system' GROUP BY ALL""")
def instance_counts_all(spark, sf):
    proc = run_sql(spark, sf, _SNAPSHOT)
    tasks = tasks_for(proc)
    counts = ops.instance_counts(ops.with_parent(proc, tasks), tasks)
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    columns = {
        "image": ("image_low", none, "n_total", "n_alive"), "session": ("full", F.col("session").cast("bigint"), "n_session", "n_session_alive"),
        "parent": ("full", "ppid", "n_parent", none), "children": (text, "pid", "children", none),
        "system_child": (text, none, "n_system_child", none)}
    out = None
    for kind, (name, k, n, alive) in columns.items():
        cell = lambda c: F.col(c) if isinstance(c, str) else c
        part = counts[kind].select(F.lit(kind).alias("kind"), "case_id", cell(name).alias("name"), cell(k).alias("k"), cell(n).alias("n"), cell(alive).alias("alive"))
        out = part if out is None else out.unionByName(part)
    return out


@register("process_forest", """
WITH RECURSIVE t(case_id, pid, root_pid, depth, sort_path) AS (
  SELECT case_id, pid, pid, 0, [pid] FROM proc p WHERE ppid = 0 OR ppid = pid
    OR NOT EXISTS (SELECT 1 FROM proc q WHERE q.case_id = p.case_id AND q.pid = p.ppid)
  UNION ALL SELECT c.case_id, c.pid, t.root_pid, t.depth + 1, list_append(t.sort_path, c.pid)
  FROM t JOIN proc c ON c.case_id = t.case_id AND c.ppid = t.pid AND c.ppid <> 0 AND c.ppid <> c.pid),
n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sort_path) - 1 AS position FROM t)
SELECT case_id, pid, root_pid, depth, position, min(position) OVER (PARTITION BY case_id, root_pid) AS root_start,
  max(position) OVER (PARTITION BY case_id, root_pid) + 1 AS root_end FROM n""", "proc")
def process_forest(spark, sf):
    return ops.process_forest(view(spark, sf, "proc")).select(
        "case_id", "pid", "root_pid", "depth", "position", "root_start", "root_end")


_SUBTREES = """
SELECT 'case' || CAST(o_custkey % 5 AS STRING) AS case_id, o_orderkey AS root_start, o_orderkey AS root_pid,
  CASE WHEN o_custkey % 50 = 0 THEN 9000 ELSE 1 + o_custkey % 1700 END AS tokens FROM {orders}
"""


@register("pack_chunks", f"""
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY root_start) AS rn FROM ({_SUBTREES.replace('{orders}', 'orders')})),
f(case_id, rn, chunk, fill, solo) AS (
  SELECT case_id, rn, 1::BIGINT, tokens::BIGINT, tokens > 8000 FROM s WHERE rn = 1
  UNION ALL SELECT s.case_id, s.rn, f.chunk + CASE WHEN f.solo OR s.tokens > 8000 OR f.fill + s.tokens > 8000 THEN 1 ELSE 0 END,
    CASE WHEN f.solo OR s.tokens > 8000 OR f.fill + s.tokens > 8000 THEN s.tokens ELSE f.fill + s.tokens END, s.tokens > 8000
  FROM f JOIN s ON s.case_id = f.case_id AND s.rn = f.rn + 1)
SELECT s.case_id, s.root_pid, f.chunk FROM f JOIN s USING (case_id, rn)""")
def pack_chunks(spark, sf):
    return ops.pack_chunks(run_sql(spark, sf, _SUBTREES)).select("case_id", "root_pid", "chunk")


# tool tables: listed processes, a pool scan that sees some more, and command lines
def _listed(spark, sf, cols=("line_no", "case_id", "pid", "image", "cmd")):
    return view(spark, sf, "proc").where("NOT wow64").select(*cols)


@register("priority_union", """
SELECT case_id, pid, image, CASE WHEN wow64 THEN 'psscan' ELSE 'pstree' END AS via FROM proc""", "proc")
def priority_union(spark, sf):
    p = view(spark, sf, "proc").select("line_no", "case_id", "pid", "image", "wow64")
    primary = p.where("NOT wow64").withColumn("via", F.lit("pstree"))
    again = primary.withColumns({"image": F.lit("?"), "line_no": F.col("line_no") + 10_000_000})
    secondary = p.withColumn("via", F.lit("psscan"))
    return tsv.priority_union(primary.unionByName(again), secondary, ["case_id", "pid"]).select(
        "case_id", "pid", "image", "via")


@register("hidden_processes", "SELECT case_id, pid FROM proc WHERE wow64", "proc")
def hidden_processes(spark, sf):
    p = view(spark, sf, "proc")
    return flt.hidden_processes(p.where("NOT wow64"), p, ["case_id", "pid"])


@register("fill_command", """
SELECT case_id, pid, CASE WHEN cmd = '' THEN 'late ' || CAST(pid AS STRING) ELSE cmd END AS cmd FROM proc""", "proc")
def fill_command(spark, sf):
    p = view(spark, sf, "proc")
    args = p.select("case_id", "pid", "line_no", F.lit("early").alias("args")).unionByName(
        p.select("case_id", "pid", (F.col("line_no") + 1).alias("line_no"),
                 F.concat(F.lit("late "), F.col("pid").cast("string")).alias("args")))
    return tsv.fill_cmd(p.select("case_id", "pid", "cmd"), args)


_NET = """
SELECT 'case' || CAST(l_suppkey % 3 AS STRING) AS case_id, l_suppkey AS pid,
  l_orderkey * 160000000 + l_partkey * 8000 + l_suppkey * 8 + l_linenumber AS line_no, 'TCPv4' AS proto,
  '10.0.0.1' AS local_addr, CAST(1000 + l_linenumber AS STRING) AS local_port,
  CASE WHEN l_partkey % 5 = 0 THEN '10.1.1.' ELSE '198.51.100.' END || CAST(l_partkey % 50 AS STRING) AS foreign_addr,
  CASE WHEN l_partkey % 11 = 0 THEN '4444' ELSE '443' END AS foreign_port,
  CASE WHEN l_orderkey % 4 = 0 THEN '' WHEN l_orderkey % 4 = 1 THEN 'CLOSED' ELSE 'ESTABLISHED' END AS state,
  CASE WHEN l_returnflag = 'A' THEN 'netstat' ELSE 'netscan' END AS source
FROM {lineitem}
"""
_DUCK_NET = _NET.replace("{lineitem}", "lineitem")


@register("merge_connections", f"""
SELECT case_id, pid, proto, local_addr, local_port, foreign_addr, foreign_port,
  coalesce(first(state ORDER BY line_no) FILTER (source = 'netstat' AND state <> ''),
    first(state ORDER BY source = 'netstat', line_no) FILTER (state <> ''), '') AS state FROM ({_DUCK_NET}) GROUP BY ALL""")
def merge_connections(spark, sf):
    return ops.merge_net(run_sql(spark, sf, _NET)).drop("ord")


@register("network_anomalies", f"""
SELECT line_no, foreign_addr, foreign_port = '4444' AS red_flag_port, state = 'ESTABLISHED' AND NOT starts_with(foreign_addr, '10.') AS public_peer
FROM ({_DUCK_NET}) WHERE foreign_port = '4444' OR (state = 'ESTABLISHED' AND NOT starts_with(foreign_addr, '10.'))""")
def network_anomalies(spark, sf):
    return det.net_anomalies(run_sql(spark, sf, _NET)).select(
        "line_no", "foreign_addr", "red_flag_port", "public_peer")


@register("shared_peers", f"""
SELECT foreign_addr, count(*) AS connections, count(DISTINCT pid) AS processes FROM ({_DUCK_NET})
WHERE NOT starts_with(foreign_addr, '10.') GROUP BY ALL HAVING count(*) > 1""")
def shared_peers(spark, sf):
    return det.shared_peers(run_sql(spark, sf, _NET))


def _tables(spark, sf):
    """Tool tables of a snapshot: suppliers as processes, line items as their children."""
    li = load(spark, sf, "lineitem")
    order = F.expr("l_orderkey * 160000000 + l_partkey * 8000 + l_suppkey * 8 + l_linenumber")
    base = [F.lit("c").alias("case_id"), F.col("l_suppkey").alias("pid"), order.alias("line_no")]
    part = F.col("l_partkey").cast("string")
    s = load(spark, sf, "supplier")
    return {
        "process": s.select(
            F.lit("c").alias("case_id"), F.col("s_suppkey").alias("pid"),
            F.col("s_suppkey").alias("line_no"), F.floor(F.col("s_suppkey") / 4).alias("ppid"),
            F.col("s_name").alias("image"), F.lit("C:\\x y\\s.exe").alias("path"),
            F.concat(F.lit('run "'), "s_name", F.lit('"')).alias("cmd"),
            F.lit("").alias("exit_time"), F.lit("2024").alias("create_time"),
            F.lit("pstree").alias("discovered_via"), F.lit(0).alias("depth")),
        "dll": li.select(*base, F.lit("").alias("path"),
                         F.when(F.col("l_linenumber") > 3, F.concat(F.lit("D"), part))
                         .otherwise(F.concat(F.lit("d"), part)).alias("name")),
        "handle": li.where("l_linenumber = 1").select(
            *base, F.lit("File").alias("type"), F.when(F.col("l_partkey") % 2 == 0, part).otherwise("").alias("name")),
        "privilege": li.where("l_linenumber = 2").select(
            *base, F.lit("SeDebugPrivilege").alias("privilege"), F.lit("Present,Enabled").alias("attributes")),
        "net": run_sql(spark, sf, _NET).withColumn("case_id", F.lit("c")),
        "sid": li.select(*base, F.concat(F.lit("S-1-5-"), (F.col("l_partkey") % 9).cast("string")).alias("sid"),
                         F.lit("n").alias("name")),
    }


@register("child_lists", """
WITH li AS (SELECT *, l_orderkey * 160000000 + l_partkey * 8000 + l_suppkey * 8 + l_linenumber AS ord,
  CASE WHEN l_linenumber > 3 THEN 'D' ELSE 'd' END || CAST(l_partkey AS STRING) AS dll FROM lineitem),
d AS (SELECT l_suppkey, first(dll ORDER BY ord) AS v, min(ord) AS o FROM li GROUP BY l_suppkey, lower(dll)),
dl AS (SELECT l_suppkey, string_agg(v, ';' ORDER BY o) AS dlls FROM d GROUP BY ALL),
h AS (SELECT l_suppkey, string_agg(CASE WHEN l_partkey % 2 = 0 THEN 'File|' || CAST(l_partkey AS STRING) ELSE 'File' END, ';' ORDER BY ord) AS handles
  FROM li WHERE l_linenumber = 1 GROUP BY ALL),
s AS (SELECT l_suppkey, l_partkey % 9 AS k, min(ord) AS o FROM li GROUP BY ALL),
sl AS (SELECT l_suppkey, string_agg('S-1-5-' || CAST(k AS STRING), ';' ORDER BY o) AS sids FROM s GROUP BY ALL)
SELECT s_suppkey AS pid, coalesce(dlls, '') AS dlls, coalesce(handles, '') AS handles, coalesce(sids, '') AS sids
FROM supplier LEFT JOIN dl ON dl.l_suppkey = s_suppkey LEFT JOIN h ON h.l_suppkey = s_suppkey LEFT JOIN sl ON sl.l_suppkey = s_suppkey""")
def child_lists(spark, sf):
    p = ops.assemble_process(_tables(spark, sf), ["dlls", "handles", "sids"])
    return p.select(
        "pid", F.array_join("dlls", ";").alias("dlls"), F.array_join("handles", ";").alias("handles"),
        F.array_join(F.transform("sids", lambda x: x["sid"]), ";").alias("sids"))


@register("process_lines", """
SELECT pid, repeat('  ', pid % 3) || 'pid=' || CAST(pid AS STRING) || ' ppid=' || CAST(ppid AS STRING) ||
  CASE WHEN wow64 THEN ' discovered_via=psscan' ELSE '' END || ' name=' || image || ' path=' || path || ' cmd="say \\"' || image || '\\""' ||
  ' start=2024' || CASE WHEN exit_time <> '' THEN ' end=' || exit_time ELSE '' END ||
  ' dlls=a;b nets= sids=S-1|x privs= handles=' || chr(10) AS line FROM proc""", "proc")
def process_lines(spark, sf):
    net = "array<struct<proto:string,local_addr:string,local_port:string,foreign_addr:string,foreign_port:string,state:string>>"
    p = view(spark, sf, "proc").withColumns({
        "depth": (F.col("pid") % 3).cast("int"),
        "discovered_via": F.when(F.col("wow64"), "psscan").otherwise("pstree"),
        "cmd": F.concat(F.lit('say "'), "image", F.lit('"')),
        "create_time": F.lit(" 2024 "), "dlls": F.array(F.lit("a"), F.lit(""), F.lit("b")),
        "nets": F.array().cast(net), "privs": F.array().cast("array<string>"),
        "sids": F.array(F.struct(F.lit("S-1").alias("sid"), F.lit("x").alias("name"))),
        "handles": F.array().cast("array<string>"),
    })
    return p.select("pid", ops.format_process_line(p).alias("line"))


# ---- anomalies -------------------------------------------------------------------


@register("spawn_anomalies", """
SELECT p.case_id, p.pid, lower(q.image) AS spawned_by FROM proc p JOIN proc q ON q.case_id = p.case_id AND q.pid = p.ppid
WHERE lower(q.image) IN ('winword.exe', 'chrome.exe') AND lower(p.image) IN ('cmd.exe', 'powershell.exe')""", "proc")
def spawn_anomalies(spark, sf):
    return ops.spawn_anomaly(view(spark, sf, "proc")).select("case_id", "pid", "spawned_by")


@register("dual_sids", """
SELECT case_id, pid FROM proc WHERE pid % 6 = 0 AND lower(image) NOT IN ('explorer.exe', 'services.exe', 'wininit.exe',
  'winlogon.exe', 'smss.exe', 'csrss.exe', 'lsass.exe', 'svchost.exe')""", "proc")
def dual_sids(spark, sf):
    k = F.col("pid")
    sids = F.array(
        F.when(k % 2 == 0, "S-1-5-18|Local").otherwise("S-1-5-32|x"),
        F.when(k % 3 == 0, "S-1-5-21-7|bob").otherwise("S-1-1-0|Everyone"))
    return ops.dual_sid(view(spark, sf, "proc").withColumn("sids", sids)).select("case_id", "pid")


@register("spawn_volume", """
SELECT p.case_id, p.pid, count(*) AS children FROM proc p JOIN proc c ON c.case_id = p.case_id AND c.ppid = p.pid
WHERE lower(p.image) IN ('cmd.exe', 'powershell.exe', 'wscript.exe') GROUP BY ALL HAVING count(*) > 2""", "proc")
def spawn_volume(spark, sf):
    return ops.spawn_volume(view(spark, sf, "proc"), 2).select("case_id", "pid", "children")


@register("rule_scores", """
WITH s AS (SELECT *, contains(lower(cmd), 'powershell') AS kw,
  pid % 4 = 0 AS odd, regexp_matches(lower(image), '[a-f0-9]{8,}\\.exe$') AS hexed FROM proc)
SELECT case_id, pid, 3 * kw::INT + 2 * odd::INT + 2 * hexed::INT AS score,
  CASE WHEN 3 * kw::INT + 2 * odd::INT + 2 * hexed::INT >= 5 THEN 'HIGH' WHEN 3 * kw::INT + 2 * odd::INT + 2 * hexed::INT >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  (kw::INT + odd::INT + hexed::INT) AS n_reasons FROM s WHERE kw OR odd OR hexed""", "proc")
def rule_scores(spark, sf):
    place = F.when(F.col("pid") % 4 == 0, "D:\\Users\\x\\a.exe").otherwise("C:\\Windows\\Temp\\a.exe")
    return ops.rule_score(view(spark, sf, "proc").withColumn("path", place)).select(
        "case_id", "pid", "score", "severity", F.size("reasons").alias("n_reasons"))


@register("preview_lists", """
SELECT pid, 'a.dll,d:' || chr(92) || 'x.dll,b,c,e,f,g,h' AS dlls, 'n1,n2,n3,n4,n5,n6' AS nets, 'SeTcbPrivilege' AS notable FROM proc""", "proc")
def preview_lists(spark, sf):
    p = view(spark, sf, "proc").withColumns({
        "dlls": F.split(F.lit("a.dll,c:\\windows\\k.dll,d:\\x.dll,,b,c,e,f,g,h,i,j"), ","),
        "nets": F.split(F.lit("n1,n2,n3,n4,n5,n6,n7"), ","),
        "privs": F.array(F.lit("SeTcbPrivilege|Enabled"), F.lit("SeDebugPrivilege|Present")),
    })
    return ops.preview_lists(p).select(
        "pid", F.array_join("dll_preview", ",").alias("dlls"), F.array_join("net_preview", ",").alias("nets"),
        F.array_join("notable", ",").alias("notable"))


@register("command_rules", """
SELECT pid, 'encoded_shell' AS rule FROM proc WHERE image = 'powershell.exe' AND cmd <> ''
UNION ALL SELECT pid, 'certutil_download' FROM proc WHERE image = 'cmd.exe' AND cmd <> ''""", "proc")
def command_rules(spark, sf):
    cmd = F.when((F.col("image") == "cmd.exe") & (F.col("cmd") != ""), "certutil.exe -URLCACHE -f x").otherwise(F.col("cmd"))
    return det.command_rules(view(spark, sf, "proc").withColumn("cmd", cmd)).select("pid", "rule")


# a third of the processes bear the name of a part with a letter changed
_IMAGES = """
SELECT case_id, pid, CASE WHEN pid % 3 = 0 THEN replace(p_name, 'i', 'l') || '.exe' ELSE image END AS image
FROM ({proc}) p JOIN {part} ON p_partkey = pid % (SELECT count(*) FROM {part})"""
_KNOWN = """
SELECT DISTINCT p_name || '.exe' AS name FROM {part} UNION
SELECT name FROM (VALUES ('svchost.exe'), ('lsass.exe'), ('explorer.exe'), ('services.exe'), ('csrss.exe'), ('smss.exe'),
  ('wininit.exe'), ('winlogon.exe'), ('conhost.exe'), ('dllhost.exe'), ('powershell.exe'), ('winword.exe'), ('fontdrvhost.exe'), ('chrome.exe')) k(name)"""


@register("typosquats", f"""
WITH i AS ({duck_sql(_IMAGES.replace("({proc})", "proc"))}), k AS ({duck_sql(_KNOWN)}),
m AS (SELECT image, string_agg(name, ',' ORDER BY name) AS resembles FROM (SELECT DISTINCT image FROM i) JOIN k
  ON levenshtein(lower(image), name) BETWEEN 1 AND 2
  WHERE lower(image) NOT IN (SELECT name FROM k UNION SELECT left(name, {rules.NAME_LIMIT}) FROM k) GROUP BY image)
SELECT case_id, pid, resembles FROM i JOIN m USING (image)""", "proc")
def typosquats(spark, sf):
    sql = _IMAGES.replace("{proc}", PROCESSES)
    return det.typosquats(run_sql(spark, sf, sql), run_sql(spark, sf, _KNOWN)).select(
        "case_id", "pid", F.array_join("resembles", ",").alias("resembles"))


@register("parentage", """
SELECT * FROM (SELECT p.case_id, p.pid, array_to_string([x FOR x IN [
    CASE WHEN q.pid IS NULL AND p.ppid <> 0 THEN 'orphan' END,
    CASE WHEN p.image = 'svchost.exe' AND coalesce(lower(q.image), '') <> 'services.exe' THEN 'wrong_parent'
         WHEN p.image = 'lsass.exe' AND coalesce(lower(q.image), '') <> 'wininit.exe' THEN 'wrong_parent' END,
    CASE WHEN p.exit_ts IS NOT NULL THEN 'short_lived' END] IF x IS NOT NULL], ',') AS signals
  FROM proc p LEFT JOIN proc q ON q.case_id = p.case_id AND q.pid = p.ppid) WHERE signals <> ''""", "proc")
def parentage(spark, sf):
    return det.parentage(view(spark, sf, "proc")).select(
        "case_id", "pid", F.array_join("signals", ",").alias("signals"))


