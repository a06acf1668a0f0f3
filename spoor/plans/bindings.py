"""How the benchmark tables play the roles of evidence tables.

Each binding is one SELECT that Spark and DuckDB both understand, so a query and
its oracle start from the same rows. ``{name}`` stands for a benchmark table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# an event log: one row per event
EVENTS = """
SELECT event_id AS ord,
  CASE WHEN k = 0 THEN 1102
       WHEN event_type = 'error' THEN 4625
       WHEN event_type = 'click' THEN 4624
       WHEN event_type = 'view' THEN 4688
       WHEN event_type = 'signup' THEN 4648
       ELSE 5140 END AS id,
  ts AS time,
  'u' || CAST(user_id % 25 AS STRING) AS user,
  'host' || CAST(user_id % 12 AS STRING) AS computer,
  CASE WHEN k % 3 = 0 THEN '10.0.0.' ELSE '203.0.113.' END || CAST(k % 40 AS STRING) AS src_ip,
  CASE WHEN k % 5 < 2 THEN '3' WHEN k % 5 = 2 THEN '10' ELSE '2' END AS logon_type,
  'proc' || CAST(k % 5 AS STRING) || '.exe' AS process,
  'parent' || CAST(user_id % 4 AS STRING) || '.exe' AS parent_process,
  CASE WHEN k % 2 = 0 THEN 'share' || CAST(k % 4 AS STRING) END AS share
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}) e
"""

# file records: lineitem rows with the two clocks of an order and a shipment
FILES = """
SELECT l_orderkey * 160000000 + l_partkey * 8000 + l_suppkey * 8 + l_linenumber AS line_no,
  folder || CAST(l_suppkey AS STRING) || inner_folder || CAST(l_partkey AS STRING) || ext AS path,
  l_quantity / 6.25 AS entropy,
  CASE WHEN l_tax > 0.05 THEN 'Zone.Identifier' WHEN l_tax < 0.01 THEN 'Zone.Identifier;pay' END
    AS ads,
  l_shipdate AS created,
  CASE WHEN l_returnflag = 'A' THEN l_shipdate ELSE o_orderdate END AS fn_created,
  CASE WHEN l_orderkey % 50 = 2 THEN 'mismatch:claimed_txt_is_PE' END AS magic_mismatch,
  l_partkey % 97 = 0 AS known_good,
  l_linestatus = 'F' AS deleted,
  'h' || CAST(l_partkey % 1000 AS STRING) AS hash
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
JOIN (SELECT n, replace(a, '/', chr(92)) AS folder, replace(b, '/', chr(92)) AS inner_folder FROM (VALUES
    (2, 'Windows/System32/', '/f'), (3, 'Windows/System32/', '/f'),
    (4, 'Users/u', '/AppData/Roaming/f'), (5, 'Users/u', '/AppData/Roaming/f'),
    (6, 'Users/u', '/Downloads/f'), (7, 'Users/u', '/Downloads/f'),
    (8, 'ProgramData/Microsoft/', '/f'), (9, 'ProgramData/x', '/f'),
    (10, '$Recycle.Bin/S-1-', '/f'), (11, '$Recycle.Bin/S-1-', '/f'),
    (12, 'Program Files/Vendor/a/b/c/d/e/f/', '/f'), (13, 'Program Files/Vendor/a/b/c/d/e/f/', '/f'),
    (14, 'Temp/Temp/', '/f'), (15, 'Temp/Temp/', '/f')) v(n, a, b)) d
  ON d.n = l_linenumber * 2 + l_suppkey % 2
JOIN (SELECT * FROM (VALUES (0, '.exe'), (1, '.dll'), (2, '.txt'), (3, '.PS1'), (4, '.bin'), (5, '')) w(m, ext)) x
  ON x.m = l_orderkey % 6
"""

# a process snapshot of three cases
PROCESSES = """
SELECT 'case' || CAST(o_custkey % 3 AS STRING) AS case_id,
  o_orderkey AS line_no, o_orderkey + 4 AS pid,
  CAST(floor(o_orderkey / 4) AS BIGINT) AS ppid,
  image,
  CASE WHEN o_custkey % 7 = 0 THEN '' ELSE replace('C:/Windows/System32/', '/', chr(92)) ||
    CASE WHEN image = 'fontdrvhost.ex' THEN 'fontdrvhost.exe' ELSE image END END AS path,
  CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN image = 'svchost.exe' THEN 'svchost -k netsvcs'
    WHEN image = 'powershell.exe' THEN 'powershell -enc ' || CAST(o_custkey AS STRING)
    ELSE image || ' 0x4' END AS cmd,
  o_orderkey % 41 = 0 AS wow64,
  CASE WHEN o_custkey % 4 = 3 THEN NULL ELSE CAST(o_custkey % 4 AS INT) END AS session,
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(o_custkey % 30 AS INT) END AS threads,
  CASE WHEN o_orderstatus = 'F' THEN '2024-01-01' ELSE '' END AS exit_time,
  o_orderdate AS create_ts,
  CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 = 0 THEN o_orderdate END AS exit_ts
FROM (SELECT *, CASE o_custkey % 20
    WHEN 0 THEN 'System' WHEN 1 THEN 'smss.exe' WHEN 2 THEN 'csrss.exe' WHEN 3 THEN 'wininit.exe'
    WHEN 4 THEN 'services.exe' WHEN 5 THEN 'svchost.exe' WHEN 6 THEN 'lsass.exe'
    WHEN 7 THEN 'fontdrvhost.ex' WHEN 8 THEN 'conhost.exe' WHEN 9 THEN 'winword.exe'
    WHEN 10 THEN 'cmd.exe' WHEN 11 THEN 'powershell.exe' WHEN 12 THEN 'chrome.exe'
    WHEN 13 THEN 'svch0st.exe' WHEN 14 THEN 'a1b2c3d4e5.exe' WHEN 15 THEN 'winlogon.exe'
    WHEN 16 THEN 'dwm.exe' WHEN 17 THEN 'dllhost.exe' WHEN 18 THEN 'services.exe'
    ELSE 'explorer.exe' END AS image FROM {orders}) o
"""

# numbered artifact lines
LINES = """
SELECT source || '.txt' AS source_file, doc_id AS line_no, text AS content FROM {documents}
"""

# verdicts of modules about entities
FINDINGS = """
SELECT l.doc_id AS ord,
  CASE l.doc_id % 3 WHEN 0 THEN 'disk' WHEN 1 THEN 'ram' ELSE 'ti' END AS module,
  'f' || CAST(l.doc_id AS STRING) AS finding_id,
  CASE WHEN l.doc_id % 4 = 0 THEN 'domain' WHEN l.doc_id % 4 = 1 THEN 'ip'
    WHEN l.doc_id % 4 = 2 THEN 'image_name' ELSE 'pid' END AS entity_type,
  CASE WHEN l.doc_id % 4 = 0 THEN 'h' || CAST(l.doc_id % 70 AS STRING) || '.example.com'
    WHEN l.doc_id % 4 = 1 THEN '203.0.113.' || CAST(l.doc_id % 90 AS STRING)
    WHEN l.doc_id % 4 = 2 THEN 'img' || CAST(l.doc_id % 50 AS STRING) || '.exe'
    ELSE CAST(l.doc_id % 110 AS STRING) END AS entity_value,
  CASE WHEN quality = 1 AND toxic = 1 THEN 'CONFIRMED' WHEN quality = 1 THEN 'INCONCLUSIVE'
    WHEN toxic = 1 THEN 'REJECTED' ELSE 'NOT_FOUND' END AS verdict,
  CASE WHEN quality = 1 AND toxic = 1 THEN
    CASE WHEN n_chars < 500 THEN NULL WHEN n_chars < 1500 THEN 'MEDIUM'
      WHEN n_chars < 4000 THEN 'HIGH' ELSE 'CRITICAL' END END AS severity,
  'ip' AS related_type, '198.51.100.' || CAST(l.doc_id % 60 AS STRING) AS related_value,
  d.source AS dataset, lang,
  'T10' || CAST(10 + l.doc_id % 30 AS STRING) AS technique,
  n_chars
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
"""

# a call log: conversation turns as calls
CALLS = """
SELECT 'case' || CAST(conv_id AS STRING) AS case_id, turn AS ord,
  'c' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS call_id,
  role AS agent_name, CASE role WHEN 'assistant' THEN 'modules' ELSE 'backbone/' || role END
    AS component,
  CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens_in,
  turn * 10 AS tokens_out, CAST(length(text) AS BIGINT) AS latency_ms, text
FROM {conversations}
"""

VIEWS = {
    "ev": EVENTS, "files": FILES, "proc": PROCESSES, "lines": LINES, "findings": FINDINGS,
    "calls": CALLS,
}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over benchmark tables, written as ``{table}``."""
    return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in tables_of(sql)})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, VIEWS[name])


def duck_sql(sql: str) -> str:
    """The same statement for DuckDB, where tables go by their name."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def oracle(body: str, *views: str) -> str:
    """``body`` after WITH clauses for the named bindings."""
    if not views:
        return body.strip()
    ctes = ",\n".join(f"{v} AS ({duck_sql(VIEWS[v]).strip()})" for v in views)
    head, rest = f"WITH {ctes}", body.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{rest[15:]}"
    return f"{head},\n{rest[5:]}" if rest.upper().startswith("WITH ") else f"{head}\n{rest}"
