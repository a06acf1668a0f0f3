"""Parsers and sinks by round trip: build the text form from a table, parse it, compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor import rules
from spoor.operators import detections as det
from spoor.plans.bindings import load, oracle, view
from spoor.sinks.writers import limit_records
from spoor.sources import blocks, kv, lines, markup, tables, tsv

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None, *views: str):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql, *views)
        return f

    return keep


def _text(c):
    return F.col(c).cast("string")


@register("kv_round_trip", """
SELECT o_orderkey, 'say "' || o_orderpriority || '" C:' || chr(92) || 'x=' || o_orderstatus AS note, o_orderstatus AS status, CAST(NULL AS STRING) AS empty,
  'type=order note="say \\"' || o_orderpriority || '\\" C:' || chr(92) || chr(92) || 'x=' || o_orderstatus || '" status=' || o_orderstatus AS line FROM orders""")
def kv_round_trip(spark, sf):
    note = F.concat(F.lit('say "'), "o_orderpriority", F.lit('" C:\\x='), "o_orderstatus")
    rec = F.create_map(
        F.lit("type"), F.lit("order"), F.lit("note"), note, F.lit("empty"), F.lit(""),
        F.lit("status"), F.col("o_orderstatus"))
    o = load(spark, sf, "orders").select("o_orderkey", kv.to_kv_line(rec).alias("content"))
    return kv.parse_kv_lines(o).select(
        "o_orderkey", F.col("rec")["note"].alias("note"), F.col("rec")["status"].alias("status"),
        F.try_element_at("rec", F.lit("empty")).alias("empty"), F.col("content").alias("line"))


@register("split_lines", """
SELECT doc_id, count(*) AS line_count, CAST(sum(length(x)) AS BIGINT) AS chars FROM (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS x FROM documents) GROUP BY ALL""")
def split_lines(spark, sf):
    out = lines.split_lines(load(spark, sf, "documents").select("doc_id", "text"))
    return out.groupBy("doc_id").agg(
        F.max("line_no").alias("line_count"), F.sum(F.length("content")).cast("bigint").alias("chars"))


@register("limit_records", "SELECT source_file, line_no FROM lines ORDER BY source_file, line_no LIMIT 100", "lines")
def first_records(spark, sf):
    return limit_records(view(spark, sf, "lines").select("source_file", "line_no"), 100)


def _tool_lines(spark, sf):
    """A tool table per nation: banner, blank, header, blank, then its customers."""
    c = load(spark, sf, "customer")
    name = F.concat(F.lit("t"), _text("c_nationkey"))
    cells = [
        F.concat(F.repeat(F.lit("* "), (F.col("c_custkey") % 3).cast("int")), _text("c_custkey")),
        _text("c_nationkey"), F.col("c_name"),
        F.when(F.col("c_custkey") % 4 == 0, "-").otherwise("\\SystemRoot\\x.exe"),
        F.when(F.col("c_custkey") % 5 == 0, "N/A").otherwise("1"),
    ]
    row = F.concat_ws("\t", *cells)
    row = F.when(F.col("c_custkey") % 7 == 0, F.concat(row, F.lit("\tmore"))).when(
        F.col("c_custkey") % 7 == 1, F.concat_ws("\t", *cells[:3])).otherwise(row)
    rows = c.select(name.alias("case_id"), (F.col("c_custkey") + 10).alias("line_no"), row.alias("content"))
    head = load(spark, sf, "nation").select(
        F.concat(F.lit("t"), _text("n_nationkey")).alias("case_id"),
        F.posexplode(F.array(
            F.lit("FutureWarning: x"), F.lit(rules.TOOL_BANNER + " 2.0"), F.lit(""),
            F.lit("PID\tPPID\tImageFileName\tPath\tSessionId"), F.lit(""))).alias("line_no", "content"))
    return head.withColumn("line_no", F.col("line_no").cast("bigint")).unionByName(rows).withColumn(
        "source_file", F.lit("pstree.txt"))


@register("tool_table", """
SELECT 't' || c_nationkey AS case_id, c_custkey AS pid, CAST(c_nationkey AS BIGINT) AS ppid, c_name AS image,
  CASE WHEN c_custkey % 7 = 1 OR c_custkey % 4 = 0 THEN '' ELSE 'C:' || chr(92) || 'Windows' || chr(92) || 'x.exe' END AS path,
  CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 1 OR c_custkey % 7 = 0 THEN NULL ELSE 1 END AS session FROM customer""")
def tool_table(spark, sf):
    rows = tsv.parse_tool_tsv(_tool_lines(spark, sf), ("case_id", "source_file"))
    return tsv.process_table(rows, "pstree").select("case_id", "pid", "ppid", "image", "path", "session")


@register("artifact_health", """
WITH n AS (SELECT 't' || n_nationkey AS source_file FROM nation UNION ALL SELECT 'absent')
SELECT source_file, CASE WHEN source_file = 'absent' THEN 'missing' ELSE 'ok' END AS status,
  CASE WHEN source_file = 'absent' THEN 0 ELSE (SELECT count(*) + 2 FROM customer WHERE 't' || c_nationkey = source_file) END AS data_rows FROM n""")
def artifact_health(spark, sf):
    found = _tool_lines(spark, sf).withColumn("source_file", F.col("case_id"))
    expected = load(spark, sf, "nation").select(
        F.concat(F.lit("t"), _text("n_nationkey")).alias("source_file")).unionByName(
        spark.range(1).select(F.lit("absent").alias("source_file")))
    return lines.artifact_health(found, expected)


@register("registry_records", """
SELECT c_custkey, 'SOFTWARE' || chr(92) || c_name AS key, CASE WHEN c_custkey % 2 = 0 THEN 'v' END AS value,
  CASE WHEN c_custkey % 3 = 0 THEN 'NTUSER.DAT' ELSE 'registry' END AS artifact_source,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'autoruns' ELSE 'misc' END AS bucket FROM customer""")
def registry_records(spark, sf):
    c = load(spark, sf, "customer").select(
        F.col("c_custkey"), F.lit("SOFTWARE").alias("HiveType"), F.col("c_name").alias("KeyPath"),
        F.when(F.col("c_custkey") % 2 == 0, "v").otherwise("").alias("ValueName"),
        F.when(F.col("c_custkey") % 3 == 0, "/m/NTUSER.DAT").alias("HivePath"),
        F.when(F.col("c_mktsegment") == "BUILDING", "ASEP Services x").otherwise("Other").alias("Category"))
    return tables.registry_records(c.withColumn("LastWriteTimestamp", _text("c_custkey"))).select(
        F.col("modified").cast("bigint").alias("c_custkey"), "key", "value", "artifact_source", "bucket")


@register("event_csv_records", """
SELECT ord, id, user, CASE WHEN starts_with(src_ip, '10.') THEN NULL ELSE src_ip END AS src_ip, CASE WHEN ord % 2 = 0 THEN logon_type END AS logon_type,
  CASE WHEN ord % 3 = 0 THEN 'eventlog_security.txt' ELSE 'eventlog_other.txt' END AS bucket FROM ev WHERE id IN (4624, 4625, 1102)""", "ev")
def event_csv_records(spark, sf):
    e = view(spark, sf, "ev").select(
        _text("ord").alias("TimeCreated"), _text("id").alias("EventId"),
        F.when(F.col("ord") % 3 == 0, "Security").otherwise("Odd").alias("Channel"),
        F.concat(F.col("user"), F.lit(" ")).alias("UserName"),
        F.when(F.col("src_ip").startswith("10."), "-").otherwise(F.col("src_ip")).alias("RemoteHost"),
        F.when(F.col("ord") % 2 == 0, F.concat(F.lit("Logon Type: "), "logon_type")).otherwise("x").alias("PayloadData2"))
    return tables.event_records(e, [4624, 4625]).select(
        F.col("time").cast("bigint").alias("ord"), "id", "user", "src_ip", "logon_type", "bucket")


@register("execution_records", """
SELECT p_partkey, 'shimcache' AS artifact_source, p_name AS path, CAST(NULL AS STRING) AS hash FROM part WHERE p_size % 3 <> 0
UNION ALL SELECT p_partkey, 'amcache', CASE WHEN p_size % 3 <> 0 THEN p_name END, CASE WHEN p_size % 2 = 0 THEN 'sha256:' || lower(p_brand) END
FROM part WHERE p_size % 3 <> 0 OR p_size % 2 = 0""")
def execution_records(spark, sf):
    p = load(spark, sf, "part")
    path = F.when(F.col("p_size") % 3 != 0, F.col("p_name")).otherwise("")
    digest = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("sha256:"), "p_brand")).when(
        F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("")
    base = p.select(_text("p_partkey").alias("DateTime"), path.alias("Path"))
    shim = tables.execution_records(base, "shimcache").withColumn("hash", F.lit(None).cast("string"))
    am = tables.execution_records(
        p.select(_text("p_partkey").alias("DateTime"), path.alias("FullPath"), digest.alias("Sha256")), "amcache")
    cols = [F.col("last_modified").cast("bigint").alias("p_partkey"), "artifact_source", "path", "hash"]
    return shim.select(*cols).unionByName(am.select(*cols))


def _history(spark, sf):
    pages = load(spark, sf, "pages")
    ev = load(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    # every event is a visit of some page
    joined = ev.join(pages, ev["event_id"] % pages.count() == pages["page_id"])
    urls = joined.select("url", F.lit("t").alias("title"), (us + F.lit(11644473600000000)).alias("last_visit_time"))
    downloads = joined.select(
        F.concat(F.lit("C:\\d\\f"), _text("page_id"), F.when(F.col("page_id") % 2 == 0, ".exe").otherwise(".pdf")).alias("target_path"),
        F.col("url").alias("tab_url"), (us + F.lit(11644473600000000)).alias("start_time"))
    places = joined.select(F.col("event_id").alias("id"), "url", us.alias("last_visit_date"))
    annos = joined.select(F.col("event_id").alias("place_id"), (F.col("event_id") % 3).alias("anno_attribute_id"),
                          F.concat(F.lit("file:///f"), _text("event_id")).alias("content"), us.alias("dateAdded"))
    attrs = spark.range(3).select("id", F.when(F.col("id") == 1, "downloads/destinationFileURI").otherwise("x").alias("name"))
    return tables.browser_history(urls, downloads, places, annos, attrs)


_PAGE = "(SELECT event_id, page_id, url, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t FROM events JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages))"


@register("browser_history", f"""
SELECT 'chrome' AS browser, 'visit' AS event, url, t AS visit_time, NULL AS download_path, NULL AS download_start FROM {_PAGE}
UNION ALL SELECT 'chrome', 'download', url, NULL, 'C:' || chr(92) || 'd' || chr(92) || 'f' || page_id || CASE WHEN page_id % 2 = 0 THEN '.exe' ELSE '.pdf' END, t FROM {_PAGE}
UNION ALL SELECT 'firefox', 'visit', url, t, NULL, NULL FROM {_PAGE}
UNION ALL SELECT 'firefox', 'download', url, NULL, 'file:///f' || event_id, t FROM {_PAGE} WHERE event_id % 3 = 1""")
def browser_history(spark, sf):
    return _history(spark, sf).select("browser", "event", "url", "visit_time", "download_path", "download_start")


@register("risky_downloads", f"""
SELECT url, true AS executable, false AS raw_ip FROM {_PAGE} WHERE page_id % 2 = 0""")
def risky_downloads(spark, sf):
    return det.risky_downloads(_history(spark, sf)).select("url", "executable", "raw_ip")


@register("event_xml_records", """
SELECT ord, id, strftime(time, '%Y-%m-%dT%H:%M:%SZ') AS time, CASE WHEN id IN (4624, 4625, 1102) THEN user WHEN id = 4648 THEN 'subject' WHEN id IN (4688, 5140) THEN 'subject' END AS user,
  CASE WHEN id IN (4624, 4625, 5140) THEN src_ip END AS src_ip, CASE WHEN id IN (4624, 4625) THEN logon_type END AS logon_type,
  CASE WHEN id = 4688 THEN process END AS process, CASE WHEN id = 1102 THEN 'true' END AS anti_forensics FROM ev""", "ev")
def event_xml_records(spark, sf):
    e = view(spark, sf, "ev")

    def data(name, c):
        return F.concat(F.lit(f'<Data Name="{name}">'), c, F.lit("</Data>"))

    subject = F.when(F.col("id") == 1102, F.col("user")).otherwise(F.lit("subject"))
    xml = F.concat(
        F.lit('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="P"/><EventID Qualifiers="0">'),
        _text("id"), F.lit('</EventID><TimeCreated SystemTime="'),
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"/><Computer>'), "computer",
        F.lit("</Computer></System><EventData>"), data("targetusername", F.col("user")),
        data("SubjectUserName", subject), data("IpAddress", F.col("src_ip")), data("LogonType", F.col("logon_type")),
        data("NewProcessName", F.col("process")), F.lit("</EventData></Event>"))
    src = e.select("ord", xml.alias("xml"))
    return markup.flatten_event_xml(src, "xml", F.lit(False), F.lit("Security.evtx"), allow=[]).select(
        "ord", "id", "time", "user", "src_ip", "logon_type", "process", "anti_forensics")


@register("task_xml_records", """
SELECT p_partkey, 'LogonTrigger@2024-01-01;BootTrigger' AS trigger, 'LogonTrigger;BootTrigger' AS trigger_types, p_name || ';b.exe' AS action,
  '-x' AS action_args, 'SYSTEM' AS run_as, p_brand AS author FROM part""")
def task_xml_records(spark, sf):
    xml = F.concat(
        F.lit('<?xml version="1.0"?><Task xmlns="http://schemas.microsoft.com/windows/2004/02/mit/task"><RegistrationInfo><Author>'),
        "p_brand", F.lit("</Author></RegistrationInfo><Triggers><LogonTrigger><StartBoundary>2024-01-01</StartBoundary></LogonTrigger><BootTrigger/></Triggers>"
                         "<Principals><Principal><UserId>SYSTEM</UserId></Principal></Principals><Actions><Exec><Command>"),
        "p_name", F.lit("</Command><Arguments>-x</Arguments></Exec><Exec><Command>b.exe</Command></Exec></Actions></Task>"))
    p = load(spark, sf, "part").select("p_partkey", xml.alias("xml"), F.lit("/t/Task").alias("path"))
    return markup.flatten_task_xml(p, "xml", "path").select(
        "p_partkey", "trigger", "trigger_types", "action", "action_args", "run_as", "author")


@register("log_file_routes", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'eventlog_security.txt' WHEN 1 THEN 'eventlog_sysmon.txt' WHEN 2 THEN 'eventlog_application.txt' END AS bucket,
  CASE page_id % 4 WHEN 0 THEN 'Security.evtx' WHEN 1 THEN 'Sysmon.evtx' WHEN 2 THEN 'Odd' || page_id || '.evtx' END AS source, CASE WHEN page_id % 4 < 3 THEN page_id % 4 = 1 END AS is_sysmon FROM pages""")
def log_file_routes(spark, sf):
    n = F.col("page_id") % 4
    path = F.concat(F.lit("/logs/"), F.when(n == 0, "SECURITY.evtx").when(n == 1, "Microsoft-Windows-Sysmon%4Operational.evtx")
                    .when(n == 2, F.concat(F.lit("Odd"), _text("page_id"), F.lit(".evtx"))).otherwise("a.txt"))
    return load(spark, sf, "pages").select("page_id", lines.route_log_file(path).alias("r")).select("page_id", "r.*")


@register("recent_files", """
SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 OR o_orderdate >= TIMESTAMP '1998-06-30'""")
def recent_files(spark, sf):
    o = load(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("modified"),
        F.when(F.col("o_orderkey") % 2 == 0, "/l/Security.evtx").otherwise("/l/Archive-Security.evtx").alias("path"))
    return lines.recent_files(o, 30, F.lit("1998-07-30").cast("timestamp_ntz")).select("o_orderkey")


@register("process_line_parse", """
SELECT pid, ppid, image AS name, path, cmd FROM proc""", "proc")
def process_line_parse(spark, sf):
    p = view(spark, sf, "proc")
    line = F.concat(F.lit("  pid="), _text("pid"), F.lit(" ppid="), _text("ppid"), F.lit(" name="), "image", F.lit(" path="), "path",
                    F.lit(' cmd="'), "cmd", F.lit('" start=2024-01-01 10:00 dlls=a;b nets= sids= privs= handles=x'))
    out = blocks.parse_process_lines(p.select(line.alias("content")))
    return out.select(F.col("pid").cast("bigint").alias("pid"), F.col("ppid").cast("bigint").alias("ppid"), "name", "path", "cmd")


@register("finding_blocks", """
SELECT doc_id, 1 AS idx, source AS key, 'a: b' AS extra FROM documents UNION ALL SELECT doc_id, 3, lang, NULL FROM documents""")
def finding_blocks(spark, sf):
    text = F.concat(F.lit("=== REPORT ===\n[FINDING]\nType: auth\nkey:  "), "source", F.lit("\nMore Words: a: b\n# note: no\n\n[FINDING]\n\n[FINDING]\nkey: "), "lang", F.lit("\n"))
    out = blocks.parse_finding_blocks(load(spark, sf, "documents").select("doc_id", text.alias("text")))
    return out.select("doc_id", "idx", F.col("fields")["key"].alias("key"), F.try_element_at("fields", F.lit("more_words")).alias("extra"))


@register("process_blocks", """
SELECT doc_id, CAST(doc_id AS STRING) AS pid, source AS image FROM documents UNION ALL SELECT doc_id, 'x' || doc_id, lang FROM documents""")
def process_blocks(spark, sf):
    text = F.concat(F.lit("[PROCESS]\npid: "), _text("doc_id"), F.lit("\nimage: "), "source", F.lit("\n\nppid: 9\n[PROCESS]\nppid: 4\n\n[PROCESS]\npid: x"),
                    _text("doc_id"), F.lit("\nimage: "), "lang")
    out = blocks.parse_finding_blocks(load(spark, sf, "documents").select("doc_id", text.alias("text")), marker="[PROCESS]")
    return out.select("doc_id", F.col("fields")["pid"].alias("pid"), F.col("fields")["image"].alias("image"))


@register("verdict_blocks", """
SELECT doc_id, 'disk-scan-f001' AS finding_id, 'CONFIRMED' AS verdict, 'HIGH' AS severity, 'T1059.001,T1003' AS mitre, 'image_name' AS entity_type, source || '.exe' AS entity_value,
  'why' || chr(10) || 'more' AS justification, 'mft_records.txt:7:x ' || source || ';analyst.txt:9:y;analyst.txt:1:plain' AS evidence FROM documents
UNION ALL SELECT doc_id, 'disk-scan-f003', 'REJECTED', NULL, '', 'domain', lang || '.example.com', 'signed', '' FROM documents""")
def verdict_blocks(spark, sf):
    text = F.concat(
        F.lit("[CONFIRMED]\nKey: "), "source", F.lit(".exe\nSeverity: High\nMITRE: T1059.001 — x, T1003\nJustification:\n  why\nmore\n\nKey Evidence:\n  - [mft_records.txt L7]: x "),
        "source", F.lit("\n  - L9: y\n  - plain\n" + "-" * 40 + "\n[INCONCLUSIVE]\nnothing here\n[REJECTED]\nKey: "), "lang", F.lit(".example.com\nLegitimate explanation: signed\n"))
    out = blocks.parse_verdict_blocks(load(spark, sf, "documents").select("doc_id", text.alias("text")))
    ev = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["source_file"], e["line"].cast("string"), e["content"])), ";")
    return out.select("doc_id", "finding_id", "verdict", "severity", F.array_join("mitre", ",").alias("mitre"), "entity_type", "entity_value", "justification", ev.alias("evidence"))


@register("memory_verdict_blocks", """
SELECT doc_id, 'chunk_001' AS chunk, 'CONFIRMED' AS verdict, '42' AS pid, source AS image, 'first second' AS justification, 1 AS n_evidence, 5 AS told FROM documents
UNION ALL SELECT doc_id, 'chunk_002', 'INCONCLUSIVE', CAST(doc_id AS STRING), lang, '', 0, 5 FROM documents""")
def memory_verdict_blocks(spark, sf):
    bar = "=" * 64
    text = F.concat(
        F.lit(f"{bar}\n=== CHUNK 1: chunk_001.txt ===\nCounts: confirmed=1 rejected=5\n[CONFIRMED]\nPID: 42\nImage: "), "source",
        F.lit(f"\nJustification: first\n  second\nKey Evidence:\n  - L42: some text\n{bar}\n=== CHUNK 2: chunk_002.txt ===\nrejected=3\n[INCONCLUSIVE]\nPID: "), _text("doc_id"),
        F.lit("\nImage: "), "lang", F.lit("\n[REJECTED]\nImage: no pid\n"))
    d = load(spark, sf, "documents").select("doc_id", text.alias("text"))
    out = blocks.parse_verdict_blocks(d.withColumn("told", blocks.header_rejected(F.col("text")).cast("int")), dialect="memory")
    return out.select("doc_id", "chunk", "verdict", "pid", "image", "justification", F.size("evidence").alias("n_evidence"), "told")


@register("call_log_rows", """
SELECT call_id, tokens_in, agent_name, false AS bad FROM calls UNION ALL SELECT NULL, NULL, NULL, true FROM calls WHERE ord = 0""", "calls")
def call_log_rows(spark, sf):
    c = view(spark, sf, "calls")
    good = c.select(F.to_json(F.struct("call_id", "tokens_in", "agent_name")).alias("j"))
    bad = c.where("ord = 0").select(F.concat(F.lit("{broken "), "call_id").alias("j"))
    row = good.unionByName(bad).select(tables.parse_call_log(F.col("j")).alias("r"))
    return row.select("r.call_id", "r.tokens_in", "r.agent_name", F.col("r._corrupt_record").isNotNull().alias("bad"))
