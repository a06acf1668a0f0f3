"""Text search over the documents as artifact lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor import rules
from spoor.operators import search as ops
from spoor.operators.filters import trivially_benign
from spoor.plans.bindings import load, oracle, run_sql, view
from spoor.scale import spread

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None, *views: str):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql, *views)
        return f

    return keep


# findings to pivot on: an item's second word, an address, and a path-like pair
_TARGETS = """
SELECT item_id AS finding_id, CASE item_id % 3 WHEN 0 THEN 'auth' ELSE 'file' END AS type,
  lower(regexp_extract(text, '^([A-Za-z]+) ([A-Za-z]+)', 2)) AS key,
  CASE WHEN item_id % 5 = 0 THEN 'ab, token, token' ELSE regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1) END AS secondary,
  'HIGH' AS severity, 'none' AS reasons, 'bench' AS source FROM {benchmark}
"""
_DUCK_TARGETS = _TARGETS.replace("{benchmark}", "benchmark")

_KEYS = f"""t AS ({_DUCK_TARGETS}),
k AS (SELECT finding_id, key AS term FROM t WHERE length(key) >= 3
  UNION SELECT finding_id, trim(unnest(string_split(secondary, ','))) FROM t),
keys AS (SELECT * FROM k WHERE length(term) >= 3)"""

_HITS = _KEYS + """,
words AS (SELECT source_file, line_no, content, unnest(list_distinct(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'))) AS word FROM lines),
hits AS (SELECT DISTINCT finding_id, source_file, line_no, content FROM words JOIN keys ON word = lower(term))"""


def targets(spark, sf):
    return run_sql(spark, sf, _TARGETS)


@register("search_keys", "WITH " + _KEYS + "\nSELECT finding_id, term, 'word' AS mode FROM keys")
def search_keys(spark, sf):
    return ops.search_keys(targets(spark, sf)).select("finding_id", "term", "mode")


def _lines(spark, sf):
    return spread(view(spark, sf, "lines"))


def _files(spark, n=20):
    return ops.file_ranks(spark, [f"src{i}.txt" for i in range(n)])


@register("pivot_hits", "WITH " + _HITS + "\nSELECT finding_id, source_file, line_no FROM hits", "lines")
def pivot_hits(spark, sf):
    keys = ops.search_keys(targets(spark, sf))
    return ops.pivot_hits(keys, _lines(spark, sf)).select("finding_id", "source_file", "line_no")


@register("pivot_path_keys", """
WITH p AS (SELECT p_partkey AS finding_id, lower('C:' || chr(92) || p_type || chr(92) || p_name || CAST(p_partkey % 30 AS STRING)) AS term FROM part),
l AS (SELECT line_no, lower(path) AS path FROM (SELECT o_orderkey AS line_no,
  'x C:' || chr(92) || p_type || chr(92) || p_name || CAST(p_partkey % 60 AS STRING) || '.exe' AS path FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)))
SELECT finding_id, line_no FROM p JOIN l ON contains(l.path, p.term)""")
def pivot_path_keys(spark, sf):
    part = load(spark, sf, "part")

    def path(n):
        return F.concat(F.lit("C:\\"), "p_type", F.lit("\\"), "p_name", (F.col("p_partkey") % n).cast("string"))

    keys = part.select(F.col("p_partkey").alias("finding_id"), path(30).alias("term"), F.lit("path").alias("mode"))
    lines = load(spark, sf, "orders").join(part, F.col("o_orderkey") % part.count() == F.col("p_partkey")).select(
        F.lit("f.txt").alias("source_file"), F.col("o_orderkey").alias("line_no"),
        F.concat(F.lit("x "), path(60), F.lit(".exe")).alias("content"))
    return ops.pivot_hits(keys, lines).select("finding_id", "line_no")


_CAPPED = _HITS + """,
r AS (SELECT *, CAST(substr(replace(source_file, '.txt', ''), 4) AS INT) AS file_rank,
  row_number() OVER (PARTITION BY finding_id, source_file ORDER BY line_no) AS n FROM hits),
c AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY file_rank, line_no) AS rank FROM r WHERE n <= 6),
capped AS (SELECT *, count(*) FILTER (rank <= 40 AND file_rank < 19) OVER (PARTITION BY finding_id) >= 40 AS truncated FROM c)"""


@register("pivot_search", "WITH " + _CAPPED + """
SELECT finding_id, source_file, line_no, CAST(rank AS INT) AS rank, truncated FROM capped WHERE rank <= 40""", "lines")
def pivot_search(spark, sf):
    keys = ops.search_keys(targets(spark, sf))
    return ops.pivot_search(keys, _lines(spark, sf), _files(spark), 6, 40).select(
        "finding_id", "source_file", "line_no", "rank", "truncated")


@register("hits_per_file", "WITH " + _HITS + """
SELECT finding_id, source_file, count(*) AS hits FROM hits GROUP BY ALL""", "lines")
def hits_per_file(spark, sf):
    keys = ops.search_keys(targets(spark, sf))
    return ops.hits_per_file(ops.pivot_hits(keys, _lines(spark, sf)))


@register("budget_lines", "WITH " + _HITS + """,
n AS (SELECT finding_id, source_file, CAST(substr(replace(source_file, '.txt', ''), 4) AS INT) AS fr, count(*) AS found FROM hits GROUP BY ALL)
SELECT finding_id, source_file, found, CAST(greatest(least(found, 40 - coalesce(sum(found) OVER (PARTITION BY finding_id ORDER BY fr
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS BIGINT) AS shown FROM n""", "lines")
def budget_lines(spark, sf):
    keys = ops.search_keys(targets(spark, sf))
    hits = ops.pivot_hits(keys, _lines(spark, sf)).join(F.broadcast(_files(spark)), "source_file")
    return ops.budget_lines(hits).select("finding_id", "source_file", "found", "shown")


@register("pivot_report", "WITH " + _CAPPED + """,
s AS (SELECT finding_id, file_rank, '--- ' || source_file || ' (' || count(*) || ' hits) ---' || chr(10) ||
    string_agg('L' || line_no || ': ' || content, chr(10) ORDER BY line_no) AS sec FROM capped WHERE rank <= 40 GROUP BY finding_id, file_rank, source_file),
e AS (SELECT finding_id, string_agg(sec, chr(10) ORDER BY file_rank) AS ev FROM s GROUP BY ALL)
SELECT t.finding_id, repeat('=', 72) || chr(10) || '=== FINDING ' || t.finding_id || ': type=' || type || ' severity=HIGH ===' || chr(10) ||
  '=== key: ' || key || ' ===' || chr(10) || repeat('=', 72) || chr(10) || 'reasons:    none' || chr(10) || 'source:     bench' || chr(10) ||
  'secondary:  ' || secondary || chr(10) || chr(10) || coalesce(ev, '(no matching lines in any artifact file)') AS report
FROM t LEFT JOIN e USING (finding_id)""", "lines")
def pivot_report(spark, sf):
    t = targets(spark, sf)
    hits = ops.pivot_search(ops.search_keys(t), _lines(spark, sf), _files(spark), 6, 40)
    return ops.format_pivot(t, hits)


@register("pivot_hits_cases", "WITH " + _HITS.replace("unnest(list_distinct", "doc_case, unnest(list_distinct").replace("AS word FROM lines)", "AS word FROM cased)").replace(
    "words AS (", "cased AS (SELECT *, u.doc_case FROM lines, (VALUES (0), (1), (2)) u(doc_case) WHERE doc_case <> line_no % 3),\nwords AS (").replace(
    "SELECT DISTINCT finding_id,", "SELECT DISTINCT doc_case, finding_id,").replace("ON word = lower(term)", "ON word = lower(term) AND finding_id % 3 = doc_case") + """
SELECT doc_case AS case_id, finding_id, source_file, line_no FROM hits""", "lines")
def pivot_hits_cases(spark, sf):
    # the same file and line in several cases; a key belongs to one of them
    cases = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    lines = _lines(spark, sf).withColumn("case_id", cases).where(F.col("case_id") != F.col("line_no") % 3)
    keys = ops.search_keys(targets(spark, sf)).withColumn("case_id", (F.col("finding_id") % 3).cast("int"))
    return ops.pivot_hits(keys, lines).select("case_id", "finding_id", "source_file", "line_no")


def _memory(spark, sf):
    processes = load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("pid"), F.col("s_nationkey").alias("ppid"), F.col("s_name").alias("image"),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("run "), F.col("s_name"))).alias("cmdline"))
    names = F.array(*[F.lit(f) for f in rules.MEMORY_PID_FILES])
    # one line per order and place: the pair repeats in the table
    items = load(spark, sf, "lineitem").groupBy("l_linenumber", "l_orderkey").agg(
        F.min("l_suppkey").alias("l_suppkey"), F.min("l_partkey").alias("l_partkey"))
    lines = items.select(
        F.get(names, F.col("l_linenumber") - 1).alias("source_file"), F.col("l_orderkey").alias("line_no"),
        F.concat_ws(" ", F.lit("PID"), F.col("l_suppkey").cast("string"), F.concat(F.lit("0x"), F.col("l_partkey").cast("string")),
                    F.col("l_partkey").cast("string"), F.concat(F.col("l_orderkey").cast("string"), F.lit("K"))).alias("content"))
    return processes, lines, ops.file_ranks(spark, rules.MEMORY_PID_FILES)


_MEMORY = "WITH names AS (SELECT [" + ", ".join(f"'{f}'" for f in rules.MEMORY_PID_FILES) + """] AS n),
l AS (SELECT n[l_linenumber] AS source_file, l_linenumber - 1 AS fr, l_orderkey AS line_no, l_suppkey, l_partkey,
  'PID ' || l_suppkey || ' 0x' || l_partkey || ' ' || l_partkey || ' ' || l_orderkey || 'K' AS content FROM (
    SELECT l_linenumber, l_orderkey, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL), names),
h AS (SELECT s_suppkey AS pid, l.* FROM supplier JOIN l ON l_suppkey = s_suppkey UNION SELECT s_suppkey, l.* FROM supplier JOIN l ON l_partkey = s_suppkey),
f AS (SELECT *, row_number() OVER (PARTITION BY pid, fr ORDER BY line_no) AS k FROM h),
c AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY fr, line_no) AS rank FROM f WHERE k <= 30)"""


@register("pivot_memory", _MEMORY + """
SELECT CAST(pid AS VARCHAR) AS finding_id, source_file, line_no, content, CAST(rank AS INTEGER) AS rank FROM c WHERE rank <= 80""")
def pivot_memory(spark, sf):
    return ops.pivot_memory(*_memory(spark, sf), 30, 80).select("finding_id", "source_file", "line_no", "content", "rank")


@register("pivot_memory_report", _MEMORY + """,
s AS (SELECT pid, fr, chr(10) || '--- ' || source_file || ' ---' || chr(10) || string_agg('L' || line_no || ': ' || content, chr(10) ORDER BY line_no) AS s
  FROM c WHERE rank <= 80 GROUP BY pid, fr, source_file),
e AS (SELECT pid, string_agg(s, chr(10) ORDER BY fr) AS e FROM s GROUP BY pid)
SELECT s_suppkey AS pid, '=== PID ' || s_suppkey || ' (' || s_name || ', ppid=' || s_nationkey || ') ===' || chr(10) ||
  CASE WHEN s_suppkey % 2 = 0 THEN 'Cmdline: run ' || s_name || chr(10) ELSE '' END ||
  coalesce(e, '(no matching lines in any artifact file)') || chr(10) AS report FROM supplier LEFT JOIN e ON pid = s_suppkey""")
def pivot_memory_report(spark, sf):
    processes, lines, files = _memory(spark, sf)
    return ops.format_memory_pivot(processes, ops.pivot_memory(processes, lines, files, 30, 80))


# ---- entity queries --------------------------------------------------------------

# every address found in a document is asked for, besides names and unsupported types
_QUERIES = """
SELECT 'q' || CAST(item_id AS STRING) AS query_id, CASE WHEN item_id % 7 = 6 THEN 'ram' ELSE 'disk' END AS target_module,
  CASE item_id % 5 WHEN 0 THEN 'image_name' WHEN 1 THEN 'domain' WHEN 2 THEN 'pid' WHEN 3 THEN 'registry_key' ELSE 'file_path' END AS entity_type,
  CASE item_id % 5 WHEN 4 THEN replace('C:/Windows/System32/', '/', chr(92)) ELSE '' END ||
    lower(regexp_extract(text, '([A-Za-z]+)[^A-Za-z]*$', 1)) || CASE WHEN item_id % 11 = 10 THEN 'zzqq' ELSE '' END AS entity_value
FROM {benchmark}
"""
_DUCK_QUERIES = _QUERIES.replace("{benchmark}", "benchmark")
_ALLOWED = {
    "image_name": [f"src{i}.txt" for i in (3, 1, 4)],
    "domain": [f"src{i}.txt" for i in (9, 2, 6, 5)],
    "registry_key": [f"src{i}.txt" for i in (7, 8)],
    "file_path": [f"src{i}.txt" for i in range(20)],
}
_ALLOWED_SQL = ", ".join(
    f"('{t}', '{f}', {i})" for t, fs in _ALLOWED.items() for i, f in enumerate(fs)
)
_FOUND = f"""q AS ({_DUCK_QUERIES}), a(entity_type, source_file, file_rank) AS (VALUES {_ALLOWED_SQL}),
m AS (SELECT query_id, source_file, file_rank, line_no, content FROM q JOIN a USING (entity_type) JOIN lines USING (source_file)
  WHERE CASE WHEN entity_type = 'image_name' THEN contains(lower(content), entity_value) AND
      regexp_matches(lower(content), '(^|[ \\t\\n="''/\\\\])' || entity_value || '($|[ \\t\\n="''/\\\\])')
    WHEN entity_type = 'file_path' THEN contains(lower(content), regexp_extract(entity_value, '[^\\\\]*$'))
    ELSE contains(lower(content), entity_value) END),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file_rank, line_no) AS rank FROM m),
ev AS (SELECT * FROM e WHERE rank <= 20)"""
_BLOCK = "regexp_matches(lower(content), 'malware|token = ')"


def _asked(spark, sf):
    return run_sql(spark, sf, _QUERIES)


def _evidence(spark, sf):
    return ops.entity_lookup(_asked(spark, sf), _lines(spark, sf), ops.type_files(spark, _ALLOWED), 20)


@register("entity_lookup", "WITH " + _FOUND + "\nSELECT query_id, source_file, line_no, CAST(rank AS INT) AS rank FROM ev", "lines")
def entity_lookup(spark, sf):
    return _evidence(spark, sf).select("query_id", "source_file", "line_no", "rank")


_MEMORY_QUERIES = """SELECT s_suppkey AS query_id, CASE s_suppkey % 3 WHEN 0 THEN 'pid' WHEN 1 THEN 'image_name' ELSE 'mutex' END AS entity_type,
  CASE s_suppkey % 3 WHEN 1 THEN 'p' || CAST(s_suppkey AS STRING) || '.exe' ELSE CAST(s_suppkey AS STRING) END AS entity_value FROM {supplier}"""


@register("entity_lookup_memory", "WITH q AS (" + _MEMORY_QUERIES.replace("{supplier}", "supplier") + "),\nnames AS (SELECT [" + ", ".join(f"'{f}'" for f in rules.MEMORY_PID_FILES) + """] AS n),
l AS (SELECT n[l_linenumber] AS source_file, l_linenumber - 1 AS fr, l_orderkey AS line_no, l_suppkey AS s, l_partkey AS p FROM (
  SELECT l_linenumber, l_orderkey, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL), names),
h AS (SELECT query_id, l.* FROM q JOIN l ON entity_type = 'pid' AND CAST(s AS VARCHAR) = entity_value
  UNION SELECT query_id, l.* FROM q JOIN l ON entity_type = 'image_name' AND 'p' || p || '.exe' = entity_value
    AND source_file IN ('pslist.txt', 'pstree.txt', 'cmdline.txt', 'psscan.txt')),
o AS (SELECT *, CASE WHEN entity_type = 'pid' THEN fr ELSE list_position(['pslist.txt', 'pstree.txt', 'cmdline.txt', 'psscan.txt'], source_file) - 1 END AS k
  FROM h JOIN q USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k, line_no) AS rank FROM o)
SELECT query_id, source_file, line_no, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50""")
def entity_lookup_memory(spark, sf):
    names = F.array(*[F.lit(f) for f in rules.MEMORY_PID_FILES])
    items = load(spark, sf, "lineitem").groupBy("l_linenumber", "l_orderkey").agg(
        F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    lines = items.select(
        F.get(names, F.col("l_linenumber") - 1).alias("source_file"), F.col("l_orderkey").alias("line_no"),
        F.concat(F.lit("PID="), F.col("s").cast("string"), F.lit(" x"), F.col("s").cast("string"), F.lit(" C:\\a\\p"),
                 F.col("p").cast("string"), F.lit(".exe xp"), F.col("p").cast("string"), F.lit(".exe")).alias("content"))
    allowed = ops.type_files(spark, rules.MEMORY_TYPE_FILES)
    found = ops.entity_lookup(run_sql(spark, sf, _MEMORY_QUERIES), lines, allowed, 50, "memory")
    return found.select("query_id", "source_file", "line_no", "rank")


_ANSWER = f"""
WITH {_FOUND},
n AS (SELECT query_id, count(*) AS n, bool_or({_BLOCK}) AS blocked FROM ev GROUP BY ALL),
v AS (SELECT q.*, coalesce(n, 0) AS n, CASE WHEN target_module <> 'disk' OR entity_type = 'pid' THEN 'NOT_APPLICABLE' WHEN n IS NULL THEN 'NOT_FOUND'
    WHEN entity_type = 'file_path' AND NOT blocked THEN 'REJECTED' ELSE 'INCONCLUSIVE' END AS verdict FROM q LEFT JOIN n USING (query_id))"""
_BLOCKERS = "(?i)(malware|token = )"


@register("answer_queries", _ANSWER + """
SELECT query_id, verdict, CASE verdict WHEN 'NOT_APPLICABLE' THEN 0 WHEN 'REJECTED' THEN least(n, 5) ELSE n END AS n_evidence FROM v""", "lines")
def answer_queries(spark, sf):
    return ops.answer_queries(
        _asked(spark, sf), _evidence(spark, sf), "disk", rules.DISK_TYPES, _BLOCKERS
    ).select("query_id", "verdict", "n_evidence")


@register("capped_evidence", _ANSWER + """
SELECT query_id, source_file, line_no FROM ev JOIN v USING (query_id) WHERE verdict <> 'REJECTED' OR rank <= 5""", "lines")
def capped_evidence(spark, sf):
    ev = _evidence(spark, sf)
    verdicts = ops.answer_queries(_asked(spark, sf), ev, "disk", rules.DISK_TYPES, _BLOCKERS)
    return ops.cap_evidence(ev, verdicts).select("query_id", "source_file", "line_no")


@register("trivially_benign", f"""
WITH {_FOUND}
SELECT query_id FROM q WHERE entity_type = 'file_path' AND query_id NOT IN (SELECT query_id FROM ev WHERE {_BLOCK})""", "lines")
def benign_queries(spark, sf):
    return trivially_benign(
        _asked(spark, sf).select("query_id", "entity_type", "entity_value"), _evidence(spark, sf),
        blockers=_BLOCKERS).select("query_id")
