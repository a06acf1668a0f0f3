"""Findings, graph, report and audit operators over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor import rules
from spoor.operators import audit
from spoor.operators import findings as fnd
from spoor.operators import graph
from spoor.operators import report
from spoor.operators.filters import check_contract, new_entities, valid_related, verdict_overlap
from spoor.plans.bindings import load, oracle, run_sql, view

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None, *views: str):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql, *views)
        return f

    return keep


def findings(spark, sf):
    f = view(spark, sf, "findings")
    related = F.array(
        F.struct(F.col("related_type").alias("type"), F.col("related_value").alias("value"),
                 F.lit("seen_with").alias("relationship")))
    return f.withColumn("related", related)


# ---- findings --------------------------------------------------------------------


@register("reportable_findings", """
SELECT ord, verdict, CASE WHEN verdict = 'CONFIRMED' THEN coalesce(severity, 'MEDIUM') END AS severity FROM findings WHERE verdict <> 'REJECTED'""", "findings")
def reportable_findings(spark, sf):
    return fnd.reportable_findings(view(spark, sf, "findings")).select("ord", "verdict", "severity")


@register("verdict_counts", """
WITH c AS (SELECT module, count(*) FILTER (verdict = 'CONFIRMED') AS confirmed, count(*) FILTER (verdict = 'INCONCLUSIVE') AS inconclusive,
  count(*) FILTER (verdict = 'REJECTED') AS r, max(n_chars % 10) AS h FROM findings GROUP BY ALL)
SELECT module, confirmed, inconclusive, greatest(r, h) AS rejected FROM c""", "findings")
def verdict_counts(spark, sf):
    f = view(spark, sf, "findings")
    headers = f.select("module", (F.col("n_chars") % 10).alias("rejected"))
    return fnd.verdict_counts(f, headers)


@register("finding_numbers", """
SELECT ord, 'ram-' || dataset || '-f' || CASE WHEN n < 1000 THEN lpad(CAST(n AS STRING), 3, '0') ELSE CAST(n AS STRING) END AS finding_id
FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY ord) AS n FROM findings)""", "findings")
def finding_numbers(spark, sf):
    f = view(spark, sf, "findings").withColumn("chunk", F.col("dataset"))
    return fnd.number_findings(f, "ord").select("ord", "finding_id")


@register("finding_batches", """
SELECT ord, CAST(floor((row_number() OVER (ORDER BY ord) - 1) / 5) AS BIGINT) AS batch FROM findings""", "findings")
def finding_batches(spark, sf):
    return fnd.batch(view(spark, sf, "findings"), 5, "ord", width=64).select("ord", "batch")


@register("backfill_source", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'aggregated_analyst.txt' ELSE (SELECT min(source) FROM documents d2
  WHERE d2.lang = d.lang AND d2.text = d.text AND d2.doc_id % 3 <> 0 AND d2.doc_id = (SELECT min(doc_id) FROM documents d3
    WHERE d3.lang = d.lang AND trim(d3.text) = trim(d.text) AND d3.doc_id % 3 <> 0)) END AS source_file FROM documents d WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, first_value(source) OVER (PARTITION BY lang, trim(text, ' ') ORDER BY doc_id) FROM documents WHERE doc_id % 3 <> 0""")
def backfill_source(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.col("lang").alias("chunk"), F.col("source"),
                                            F.col("text").alias("content"))
    keep = F.col("doc_id") % 3 != 0
    line = F.when(keep, 1).otherwise(2)
    index = d.where(keep).select("chunk", F.col("doc_id").alias("ord"), F.col("source").alias("source_file"),
                                 F.lit(1).alias("line"), "content")
    return fnd.backfill_source(d.select("doc_id", "chunk", line.alias("line"), "content"), index).select(
        "doc_id", "source_file")


@register("attach_evidence", """
SELECT doc_id AS idx, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN text ELSE '' END AS evidence FROM documents""")
def attach_evidence(spark, sf):
    d = load(spark, sf, "documents")
    ev = d.join(load(spark, sf, "labels"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("idx"), F.col("text").alias("evidence"))
    return fnd.attach_evidence(d.select(F.col("doc_id").alias("idx")), ev)


@register("confirm_metrics", """
WITH c AS (SELECT dataset, count(*) FILTER (verdict = 'CONFIRMED') AS c, count(*) FILTER (verdict = 'INCONCLUSIVE') AS i,
  count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'HIGH') AS high,
  count(*) FILTER (severity = 'CRITICAL') AS critical FROM findings GROUP BY ALL)
SELECT dataset, c AS confirmed, i AS inconclusive, c + i AS total, round(100 * c / nullif(c + i, 0), 2) AS confirm_rate,
  round(c / nullif(i, 0), 2) AS ratio, low, medium, high, critical FROM c""", "findings")
def confirm_metrics(spark, sf):
    return fnd.confirm_metrics(view(spark, sf, "findings"))


@register("triage_counts", "SELECT module AS triage_source, count(*) AS findings FROM findings GROUP BY ALL", "findings")
def triage_counts(spark, sf):
    f = view(spark, sf, "findings")
    merged = fnd.merge_triage(**{m: f.where(F.col("module") == m).select("ord", "verdict") for m in ("disk", "ram", "ti")})
    return fnd.triage_counts(merged)


@register("corroboration", """
WITH c AS (SELECT entity_type, entity_value, count(DISTINCT CASE WHEN verdict <> 'NOT_FOUND' THEN dataset END) AS classes,
  bool_and(verdict = 'REJECTED' OR verdict = 'NOT_FOUND') AS weak FROM findings GROUP BY ALL)
SELECT *, CASE WHEN classes >= 2 THEN 'CONFIRMED' WHEN classes = 0 AND weak THEN 'REJECTED' ELSE 'INCONCLUSIVE' END AS verdict FROM c""", "findings")
def corroboration(spark, sf):
    f = view(spark, sf, "findings").withColumns({
        "artifact_class": F.when(F.col("verdict") != "NOT_FOUND", F.col("dataset")),
        "weak": F.col("verdict").isin("REJECTED", "NOT_FOUND")})
    return fnd.corroborate(f)


@register("stacked_severity", """
WITH s AS (SELECT entity_type, entity_value, max(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) AS l,
  count(DISTINCT dataset) AS categories FROM findings WHERE severity IS NOT NULL GROUP BY ALL)
SELECT entity_type, entity_value, categories, CASE least(l + CASE WHEN categories >= 2 THEN 1 ELSE 0 END, 4) WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM s""", "findings")
def stacked_severity(spark, sf):
    f = view(spark, sf, "findings").where("severity IS NOT NULL").withColumn("category", F.col("dataset"))
    return fnd.stack_severity(f, ["entity_type", "entity_value"])


@register("suspicion_tiers", """
SELECT ord, CASE WHEN n_chars % 3 = 0 THEN 'B' ELSE 'A' END AS tier FROM findings WHERE verdict = 'INCONCLUSIVE'""", "findings")
def suspicion_tiers(spark, sf):
    second = F.when(F.col("n_chars") % 3 == 0, "orphan").otherwise("no_cmdline")
    f = view(spark, sf, "findings").withColumn("signals", F.array(F.lit("orphan"), second))
    return fnd.suspicion_tier(f).select("ord", "tier")


@register("valid_related", """
SELECT ord, 'ip:' || related_value AS kept, CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END AS dropped, CASE WHEN n_chars % 2 = 0 THEN 'username' ELSE '' END AS dropped_types FROM findings""", "findings")
def valid_related_types(spark, sf):
    extra = F.when(F.col("n_chars") % 2 == 0, "username")
    r = F.filter(F.array(
        F.struct(F.lit("ip").alias("type"), F.col("related_value").alias("value")),
        F.struct(extra.alias("type"), F.lit("bob").alias("value"))), lambda x: x["type"].isNotNull())
    out = valid_related(view(spark, sf, "findings").withColumn("related_entities", r))
    kept = F.array_join(F.transform("related_entities", lambda x: F.concat_ws(":", x["type"], x["value"])), ",")
    return out.select("ord", kept.alias("kept"), "dropped", F.array_join("dropped_types", ",").alias("dropped_types"))


@register("contract_violations", """
SELECT ord, array_to_string([x FOR x IN [CASE WHEN n_chars % 5 = 0 THEN 'query_id' END,
  CASE WHEN (verdict = 'CONFIRMED' AND severity IS NULL) THEN 'severity' END, CASE WHEN n_chars % 7 = 0 THEN 'mitre' END,
  CASE WHEN n_chars % 11 = 0 THEN 'evidence' END] IF x IS NOT NULL], ',') AS violations FROM findings""", "findings")
def contract_violations(spark, sf):
    n = F.col("n_chars")
    f = findings(spark, sf).withColumns({
        "contract_version": F.lit("1.0"),
        "query_id": F.when(n % 5 == 0, "x").otherwise("9c0637f4-2866-45cd-81d5-3391a6a744d8"),
        "responding_module": F.col("module"), "justification": F.lit("because"),
        "mitre": F.array(F.when(n % 7 == 0, "X1").otherwise(F.col("technique"))),
        "evidence": F.array(F.struct(F.lit("a.txt").alias("source_file"), F.when(n % 11 == 0, 0).otherwise(1).alias("line"),
                                     F.lit("c").alias("content"), F.lit(True).alias("verbatim"))),
        "related_entities": F.col("related"),
        "cost": F.struct(F.lit(0).alias("llm_calls"), F.lit(0).alias("tokens_in"), F.lit(0).alias("tokens_out"))})
    return check_contract(f).select("ord", F.array_join("violations", ",").alias("violations"))


_LINES = """
SELECT 'case' || CAST(o_custkey % 7 AS STRING) AS case_id, o_orderkey AS line_no,
  CASE o_custkey % 5 WHEN 0 THEN 'key=A' || chr(92) || 'ComputerName' || chr(92) || 'ComputerName value=ComputerName data=PC' || CAST(o_orderkey AS STRING)
    WHEN 1 THEN 'value=ProductName data="Windows ' || CAST(o_orderkey AS STRING) || '" description="System Info (Current)" artifact_source=SOFTWARE'
    WHEN 2 THEN 'value=DhcpDomain data=lan' || CAST(o_orderkey AS STRING)
    WHEN 3 THEN 'data="Username:  u' || CAST(o_orderkey AS STRING) || '   Id:  ' || CAST(o_custkey AS STRING) || '  ValidUserId: True"'
    ELSE 'value=CurrentBuildNumber data=19045 artifact_source=SOFTWARE' END AS content FROM {orders}
"""


@register("host_profile", """
WITH m AS (SELECT 'case' || CAST(o_custkey % 7 AS STRING) AS case_id, o_custkey % 5 AS k, min(o_orderkey) AS o FROM orders GROUP BY ALL)
SELECT case_id, max(CASE WHEN k = 0 THEN 'PC' || o END) AS hostname, max(CASE WHEN k = 1 THEN 'Windows ' || o END) AS os,
  max(CASE WHEN k = 2 THEN 'lan' || o END) AS network_domain, CAST(NULL AS STRING) AS os_build FROM m GROUP BY ALL""")
def host_profile(spark, sf):
    return fnd.host_profile(run_sql(spark, sf, _LINES)).select("case_id", "hostname", "os", "network_domain", "os_build")


@register("host_accounts", """
SELECT 'case' || CAST(o_custkey % 7 AS STRING) AS case_id, o_orderkey AS line_no, 'u' || o_orderkey AS username, o_custkey AS rid
FROM orders WHERE o_custkey % 5 = 3""")
def host_accounts(spark, sf):
    return fnd.host_accounts(run_sql(spark, sf, _LINES))


@register("related_entities", """
WITH ips AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(\\d{1,3}(?:\\.\\d{1,3}){3})\\b', 1)) AS value FROM documents)
SELECT 'f' || doc_id AS finding_id, 'ip' AS type, value, 'outbound_or_listening' AS relationship FROM ips
WHERE NOT (starts_with(value, '127.') OR starts_with(value, '10.') OR starts_with(value, '192.168.') OR value = '0.0.0.0')
UNION SELECT 'f' || doc_id, 'image_name', source || '.exe', 'process_image' FROM documents
UNION SELECT 'f' || doc_id, 'pid', CAST(doc_id AS STRING), 'parent_pid' FROM documents
UNION SELECT 'f' || doc_id, 'file_path', 'D:' || chr(92) || source || '.dll', 'referenced_path' FROM documents""")
def related_entities(spark, sf):
    d = load(spark, sf, "documents").select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("finding_id"),
        F.concat("source", F.lit(".exe")).alias("image"), F.col("doc_id").cast("string").alias("ppid"),
        F.concat(F.lit("run D:\\"), "source", F.lit(".dll now")).alias("cmdline"), F.col("text").alias("content"))
    return fnd.related_entities(d)


# ---- graph -----------------------------------------------------------------------

_MENTIONS = """
WITH m AS (SELECT ord, 0 AS i, entity_type AS type, entity_value AS value, module, finding_id, verdict, true AS subject FROM findings
  UNION ALL SELECT ord, 1, related_type, related_value, module, finding_id, NULL, false FROM findings),
nodes AS (SELECT type, value, first(module ORDER BY ord, i) AS first_seen_module, first(finding_id ORDER BY ord, i) AS first_seen_finding_id,
  coalesce(list_sort(list(DISTINCT module) FILTER (subject)), []) AS qm, count(*) FILTER (subject) AS finding_count,
  coalesce(list_sort(list(DISTINCT verdict) FILTER (verdict IS NOT NULL)), []) AS vs FROM m GROUP BY ALL)"""
_OPEN = "(list_contains(vs, 'INCONCLUSIVE') OR list_contains(vs, 'NOT_FOUND')) AND NOT list_contains(vs, 'CONFIRMED') AND NOT list_contains(vs, 'REJECTED')"
_CAPS = {"disk": rules.DISK_TYPES, "ram": rules.MEMORY_TYPES, "ti": rules.REPUTATION_TYPES}
_CAPS_SQL = ", ".join(f"('{m}', '{t}')" for m, ts in _CAPS.items() for t in ts)


@register("graph_nodes", _MENTIONS + """
SELECT type, value, first_seen_module, first_seen_finding_id, array_to_string(qm, ',') AS queried_modules, finding_count,
  array_to_string(vs, ',') AS verdicts FROM nodes""", "findings")
def graph_nodes(spark, sf):
    return graph.build_nodes(findings(spark, sf)).select(
        "type", "value", "first_seen_module", "first_seen_finding_id",
        F.array_join("queried_modules", ",").alias("queried_modules"), "finding_count",
        F.array_join("verdicts", ",").alias("verdicts"))


@register("graph_edges", """
SELECT entity_type AS from_type, entity_value AS from_value, related_type AS to_type, related_value AS to_value, 'seen_with' AS relationship FROM findings""", "findings")
def graph_edges(spark, sf):
    return graph.build_edges(findings(spark, sf))


@register("hot_entities", _MENTIONS + """
SELECT type, value, finding_count FROM nodes ORDER BY finding_count DESC, type, value LIMIT 30""", "findings")
def hot_entities(spark, sf):
    return graph.hot_entities(graph.build_nodes(findings(spark, sf))).select("type", "value", "finding_count")


@register("open_candidates", _MENTIONS + f"SELECT type, value FROM nodes WHERE {_OPEN}", "findings")
def open_candidates(spark, sf):
    return graph.candidates(graph.build_nodes(findings(spark, sf))).select("type", "value")


@register("enrichment_candidates", _MENTIONS + """
SELECT type, value FROM nodes WHERE type IN ('ip', 'domain') AND list_contains(vs, 'CONFIRMED') AND NOT list_contains(qm, 'ti')""", "findings")
def enrichment_candidates(spark, sf):
    return graph.enrich_candidates(graph.build_nodes(findings(spark, sf)))


_ROUTES = _MENTIONS + f""", caps(module, type) AS (VALUES {_CAPS_SQL}),
r AS (SELECT n.type, n.value, c.module FROM nodes n JOIN caps c ON c.type = n.type WHERE {_OPEN} AND NOT list_contains(qm, c.module))"""


@register("routes", _ROUTES + " SELECT * FROM r", "findings")
def routes(spark, sf):
    nodes = graph.build_nodes(findings(spark, sf))
    return graph.route(graph.candidates(nodes), graph.capabilities(spark, _CAPS))


@register("dispatch_guard", f"""
WITH caps(module, type) AS (VALUES {_CAPS_SQL})
SELECT DISTINCT entity_type AS type, entity_value AS value, CASE WHEN ord % 2 = 0 THEN 'ti' ELSE 'nobody' END AS module FROM findings
WHERE ord % 2 = 0 AND entity_type IN ('ip', 'domain')""", "findings")
def dispatch_guard(spark, sf):
    f = findings(spark, sf)
    target = F.when(F.col("ord") % 2 == 0, "ti").otherwise("nobody")
    decisions = f.select(F.lit("query").alias("action"), F.col("entity_type").alias("type"),
                         F.col("entity_value").alias("value"), target.alias("module"))
    invented = decisions.withColumn("value", F.concat(F.lit("made-up-"), "value"))
    return graph.dispatchable(decisions.unionByName(invented), graph.build_nodes(f),
                              graph.capabilities(spark, _CAPS)).select("type", "value", "module").distinct()


@register("investigation_rounds", _ROUTES + """,
n AS (SELECT count(*) AS sent FROM r), e AS (SELECT count(*) AS grown FROM (SELECT DISTINCT 'domain' AS type, 'via-' || value AS value FROM r
  WHERE module = 'ti' AND type = 'ip'))
SELECT 1 AS round, sent AS queries_dispatched, grown AS new_entities_added FROM n, e""", "findings")
def investigation_rounds(spark, sf):
    """One answer per query closes every open entity, so the second round finds nothing."""

    def answer(queries, number):
        child = F.struct(F.lit("domain").alias("type"), F.concat(F.lit("via-"), "value").alias("value"),
                         F.lit("resolves").alias("relationship"))
        some = (F.col("module") == "ti") & (F.col("type") == "ip")
        kind = "array<struct<type:string,value:string,relationship:string>>"
        return queries.select(
            (F.lit(10_000_000) * number + F.xxhash64("type", "value", "module") % 1000).alias("ord"), "module",
            F.lit(None).cast("string").alias("finding_id"), F.col("type").alias("entity_type"),
            F.col("value").alias("entity_value"), F.lit("REJECTED").alias("verdict"),
            F.lit(None).cast("string").alias("severity"),
            F.when(some, F.array(child)).otherwise(F.array().cast(kind)).alias("related"))

    return graph.investigate(findings(spark, sf), graph.capabilities(spark, _CAPS), answer)[1]


def _spreading(rounds):
    """Answers that close what is asked and, for the first rounds, open one more address for each
    address that was looked up."""

    def answer(queries, number):
        def found(entity, verdict, module, rows):
            kind = "array<struct<type:string,value:string,relationship:string>>"
            return rows.select(
                (F.lit(10**12) * number + F.pmod(F.xxhash64(entity, module), F.lit(10**12))).alias("ord"),
                module.alias("module"), F.lit(None).cast("string").alias("finding_id"),
                F.col("type").alias("entity_type"), entity.alias("entity_value"), F.lit(verdict).alias("verdict"),
                F.lit(None).cast("string").alias("severity"), F.array().cast(kind).alias("related"))

        closed = found(F.col("value"), "REJECTED", F.col("module"), queries)
        if number > rounds:
            return closed
        some = queries.where((F.col("module") == "ti") & (F.col("type") == "ip"))
        return closed.unionByName(found(F.concat("value", F.lit("+")), "INCONCLUSIVE", F.lit("disk"), some))

    return answer


_SPREAD = _ROUTES + """,
g AS (SELECT count(DISTINCT value) AS g FROM r WHERE module = 'ti' AND type = 'ip'),
k AS (SELECT count(*) AS k FROM caps WHERE type = 'ip' AND module <> 'disk'),
rounds AS (SELECT 1 AS round, (SELECT count(*) FROM r) AS queries_dispatched, g AS new_entities_added FROM g
  UNION ALL SELECT CAST(n AS INTEGER), g * k, CASE WHEN n > {spread} THEN 0 ELSE g END FROM g, k, range(2, {last} + 1) t(n))
SELECT round, queries_dispatched, new_entities_added, '{reason}' AS stopped FROM rounds"""


@register("investigation_spread", _SPREAD.replace("{spread}", "3").replace("{last}", "4").replace("{reason}", "convergence"), "findings")
def investigation_spread(spark, sf):
    _, log, reason = graph.investigate(findings(spark, sf), graph.capabilities(spark, _CAPS), _spreading(3), 9)
    return log.withColumn("stopped", F.lit(reason))


@register("investigation_limit", _SPREAD.replace("{spread}", "9").replace("{last}", "3").replace("{reason}", "max_rounds_reached"), "findings")
def investigation_limit(spark, sf):
    _, log, reason = graph.investigate(findings(spark, sf), graph.capabilities(spark, _CAPS), _spreading(9), 3)
    return log.withColumn("stopped", F.lit(reason))


@register("new_entities", """
SELECT DISTINCT entity_type AS type, entity_value AS value FROM findings EXCEPT
SELECT entity_type, entity_value FROM findings WHERE module = 'disk'""", "findings")
def entities_gained(spark, sf):
    e = view(spark, sf, "findings").select("module", F.col("entity_type").alias("type"), F.col("entity_value").alias("value"))
    return new_entities(e.where("module = 'disk'"), e)


@register("verdict_overlap", _MENTIONS + """
SELECT type, value FROM nodes WHERE list_has_any(vs, ['CONFIRMED', 'INCONCLUSIVE'])""", "findings")
def overlap(spark, sf):
    return verdict_overlap(graph.build_nodes(findings(spark, sf)), report.REPORTABLE).select("type", "value")


_REPUTATION = """
SELECT DISTINCT 'ip' AS type, '203.0.113.' || CAST(p_partkey % 60 AS STRING) AS value, CAST(0 AS INT) AS ord,
  CAST(p_partkey % 60 AS INT) AS malicious, 70 AS total FROM {part}"""


@register("reputation_verdicts", """
SELECT ord, CASE WHEN entity_type NOT IN ('ip', 'domain') THEN 'NOT_APPLICABLE' WHEN entity_type = 'domain' OR m IS NULL OR m = 0 THEN 'NOT_FOUND'
    WHEN m <= 2 THEN 'INCONCLUSIVE' ELSE 'CONFIRMED' END AS verdict,
  CASE WHEN m IS NULL OR m <= 2 THEN NULL WHEN m <= 4 THEN 'LOW' WHEN m <= 9 THEN 'MEDIUM' WHEN m <= 29 THEN 'HIGH' ELSE 'CRITICAL' END AS severity
FROM (SELECT *, CASE WHEN entity_type = 'ip' AND ord % 90 < 60 THEN ord % 90 END AS m FROM findings)""", "findings")
def reputation_verdicts(spark, sf):
    q = view(spark, sf, "findings").select("ord", F.col("entity_type").alias("type"), F.col("entity_value").alias("value"))
    return graph.enrich(q, run_sql(spark, sf, _REPUTATION)).select("ord", "verdict", "severity")


@register("reputation_lookups", """
SELECT DISTINCT module AS case_id, entity_type AS type, entity_value AS value FROM findings""", "findings")
def reputation_lookups(spark, sf):
    return graph.lookups(view(spark, sf, "findings").select(
        F.col("module").alias("case_id"), F.col("entity_type").alias("type"), F.col("entity_value").alias("value")))


@register("reputation_evidence", """
SELECT ord, CASE WHEN n_chars % 12 = 0 THEN 'VirusTotal: no malicious detections or no record found'
    WHEN n_chars % 12 <= 2 THEN 'VirusTotal: ' || n_chars % 12 || '/' || (n_chars % 12 + 60) || ' engines flagged — low confidence'
    ELSE 'VirusTotal: ' || n_chars % 12 || '/' || (n_chars % 12 + 60) || ' engines flagged as malicious (severity=' ||
      CASE WHEN n_chars % 12 <= 4 THEN 'LOW' WHEN n_chars % 12 <= 9 THEN 'MEDIUM' ELSE 'HIGH' END || ')' END AS justification,
  '1 VT detections: ' || n_chars % 12 || '/' || (n_chars % 12 + 60) || ' engines flagged as malicious;2 VT tags: ' || lang || ', x;3 Geolocation: country=FR, ASN=' ||
    n_chars || ';4 Sandbox (box): bad — a, b;5 First submitted: 2024-01-01T00:00:00Z' AS evidence, technique AS mitre FROM findings""", "findings")
def reputation_evidence(spark, sf):
    n = F.col("n_chars")
    null = F.lit(None).cast("string")
    f = view(spark, sf, "findings").withColumns({
        "stats": F.create_map(F.lit("malicious"), (n % 12).cast("int"), F.lit("harmless"), F.lit(60)),
        "analysed": F.lit(1704067200), "tags": F.array("lang", F.lit("x")), "threat_label": null, "name": null,
        "country": F.lit("FR"), "as_owner": null, "asn": n, "registrar": null, "created": F.lit(None).cast("bigint"),
        "sandboxes": F.create_map(F.lit("box"), F.struct(F.lit("bad").alias("category"), F.array(F.lit("a"), F.lit("b")).alias("families"))),
        "first_seen": F.lit(1704067200), "rule_ids": F.array(F.col("technique"), F.lit("R9"), F.col("technique"))}).drop("severity", "verdict")
    out = graph.reputation_evidence(f)
    text = F.array_join(F.transform("evidence", lambda e: F.concat_ws(" ", e["line"].cast("string"), e["content"])), ";")
    return out.select("ord", "justification", text.alias("evidence"), F.array_join("mitre", ",").alias("mitre"))


# ---- report ----------------------------------------------------------------------

_REPORT = """
WITH rep AS (SELECT * FROM findings f WHERE (verdict IN ('CONFIRMED', 'INCONCLUSIVE') OR module = 'ti') AND EXISTS (
  SELECT 1 FROM findings g WHERE g.entity_type = f.entity_type AND g.entity_value = f.entity_value AND g.verdict IN ('CONFIRMED', 'INCONCLUSIVE')))"""


@register("reportable_entities", _REPORT + " SELECT ord, verdict FROM rep", "findings")
def reportable_entities(spark, sf):
    return report.reportable_entities(view(spark, sf, "findings")).select("ord", "verdict")


@register("report_summary", _REPORT + """,
e AS (SELECT entity_type, entity_value, bool_or(verdict = 'CONFIRMED') AS c FROM rep GROUP BY ALL)
SELECT (SELECT count(*) FROM e) AS reportable_entities, (SELECT count(*) FROM e WHERE c) AS confirmed_entities, (SELECT count(*) FROM e WHERE NOT c) AS inconclusive_entities,
  count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'HIGH') AS high,
  count(*) FILTER (severity = 'CRITICAL') AS critical FROM rep""", "findings")
def report_summary(spark, sf):
    return report.report_summary(report.reportable_entities(view(spark, sf, "findings")))


@register("severity_histogram", """
SELECT s.severity, count(f.ord) AS findings FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) s(severity)
LEFT JOIN findings f ON f.severity = s.severity AND f.verdict = 'CONFIRMED' GROUP BY ALL""", "findings")
def severity_histogram(spark, sf):
    return report.severity_histogram(view(spark, sf, "findings"))


@register("technique_map", "SELECT DISTINCT technique, entity_type, entity_value FROM findings WHERE verdict = 'CONFIRMED'", "findings")
def technique_map(spark, sf):
    return report.mitre_map(view(spark, sf, "findings").withColumn("mitre", F.array("technique", "technique")))


@register("indicator_table", """
WITH c AS (SELECT DISTINCT CASE WHEN entity_type = 'image_name' THEN 'File' WHEN entity_type IN ('ip', 'domain') THEN 'Network' ELSE 'Behavioural' END AS category,
  entity_value AS indicator FROM findings WHERE verdict = 'CONFIRMED')
SELECT * FROM c UNION ALL SELECT 'Registry', '—'""", "findings")
def indicator_table(spark, sf):
    return report.ioc_table(view(spark, sf, "findings"))


@register("enrichment_summary", """
WITH p AS (SELECT entity_type, entity_value, max(n_chars % 3) AS m FROM findings WHERE module = 'ti' GROUP BY ALL)
SELECT count(*) AS queried, count(*) FILTER (m >= 1) AS detected FROM p""", "findings")
def enrichment_summary(spark, sf):
    f = view(spark, sf, "findings").where("module = 'ti'")
    return report.ti_summary(f.select(F.col("entity_type").alias("type"), F.col("entity_value").alias("value"),
                                      (F.col("n_chars") % 3).alias("malicious")))


@register("network_clusters", """
SELECT n_chars % 200 AS asn, count(DISTINCT (entity_type, entity_value)) AS indicators FROM findings GROUP BY ALL HAVING count(DISTINCT (entity_type, entity_value)) > 1""", "findings")
def network_clusters(spark, sf):
    f = view(spark, sf, "findings")
    return report.network_clusters(f.select(F.col("entity_type").alias("type"), F.col("entity_value").alias("value"),
                                            (F.col("n_chars") % 200).alias("asn")))


@register("timeline", """
WITH t AS (SELECT event_id, user_id % 3 AS c, epoch_us(ts) AS us FROM events),
g AS (SELECT event_id, us - lag(us) OVER (PARTITION BY c ORDER BY us, event_id) AS gap FROM t)
SELECT event_id, gap AS gap_us, CASE WHEN gap > 7200000000 THEN 'Note: ' || CAST(floor(gap / 3600000000) AS BIGINT) || '-hour gap' END AS note FROM g""")
def timeline(spark, sf):
    e = load(spark, sf, "events").select(
        "event_id", F.col("event_id").alias("ord"), "ts", (F.col("user_id") % 3).cast("string").alias("case_id"),
        F.lit("CONFIRMED").alias("verdict"))
    return report.timeline(e, 7200).select(
        "event_id", F.round(F.col("gap_seconds") * 1_000_000).cast("bigint").alias("gap_us"), "note")


@register("report_payload", _REPORT + """,
r AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_value ORDER BY ord) - 1 AS n,
  first_value(module) OVER (PARTITION BY entity_type, entity_value ORDER BY ord) AS first_seen_module,
  list_sort(list(DISTINCT module) OVER (PARTITION BY entity_type, entity_value)) AS modules FROM rep)
SELECT entity_type, entity_value, CAST(n // 3 AS BIGINT) AS page, CAST(n % 3 AS INTEGER) AS pos, first_seen_module,
  array_to_string(modules, ',') AS queried_modules, module, verdict, severity, ord AS line, CAST(60 AS INTEGER) AS n_evidence FROM r""", "findings")
def report_payload(spark, sf):
    # sixty evidence lines each: a report keeps all of them
    lines = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.struct(
        F.lit("a.txt").alias("source_file"), (F.col("ord") + i).alias("line"), F.lit("c").alias("content")))
    f = report.reportable_entities(findings(spark, sf)).withColumns({
        "justification": F.lit("because"), "mitre": F.array("technique"), "evidence": lines})
    body = "struct<type:string,value:string,first_seen_module:string,queried_modules:array<string>,findings:array<struct<module:string,verdict:string,severity:string,evidence:array<struct<line:bigint>>>>>"
    d = report.report_payload(f, 3).select("entity_type", "entity_value", "page", F.from_json("document", body).alias("d"))
    return d.select("entity_type", "entity_value", F.col("page").cast("bigint").alias("page"), "d", F.posexplode("d.findings").alias("pos", "x")).select(
        "entity_type", "entity_value", "page", "pos", F.col("d.first_seen_module"), F.array_join("d.queried_modules", ",").alias("queried_modules"),
        "x.module", "x.verdict", "x.severity", F.col("x.evidence")[0]["line"].alias("line"), F.size("x.evidence").alias("n_evidence"))


@register("report_header", """
SELECT dataset AS case_id, 'done' AS termination_reason, array_to_string(list_sort(list(DISTINCT module)), ',') AS modules,
  count(DISTINCT entity_type || ':' || entity_value) AS entities, count(*) FILTER (verdict = 'CONFIRMED') AS confirmed,
  count(*) FILTER (verdict = 'REJECTED') AS rejected, 'host-' || dataset AS host FROM findings GROUP BY dataset""", "findings")
def report_header(spark, sf):
    f = view(spark, sf, "findings").withColumn("case_id", F.col("dataset"))
    case = f.select("case_id").distinct().select("case_id", F.lit("done").alias("termination_reason"),
                                                F.struct(F.concat(F.lit("host-"), "case_id").alias("host")).alias("host_profile"))
    body = "struct<termination_reason:string,modules_scanned:array<string>,host_profile:struct<host:string>,summary:struct<entities:bigint,confirmed:bigint,rejected:bigint>>"
    h = report.report_header(f, case).select("case_id", F.from_json("header", body).alias("h"))
    return h.select("case_id", "h.termination_reason", F.array_join("h.modules_scanned", ",").alias("modules"), "h.summary.entities",
                    "h.summary.confirmed", "h.summary.rejected", "h.host_profile.host")


def _trace(spark, sf):
    f = findings(spark, sf).where("module <> 'ti'").withColumns({
        "case_id": F.concat(F.lit("case"), (F.col("ord") % 40).cast("string")),
        "finding_id": F.concat(F.lit("ram-chunk_"), (F.col("ord") % 6).cast("string"), F.lit("-f001")),
        "evidence": F.array(F.struct(F.lit("a.txt").alias("source_file"), F.col("ord").alias("line"), F.col("lang").alias("content")))})
    c = view(spark, sf, "calls")
    memory = c.withColumn("output_files", F.array(F.concat(F.lit("x/chunk_"), (F.col("ord") % 4).cast("string"), F.lit("/analyst.txt"))))
    disk = c.where("agent_name = 'assistant'").withColumn("output_files", F.array(F.lit("disk/analyst.txt")))
    asked = view(spark, sf, "findings").where("module = 'ti'").select(
        F.lit("case0").alias("case_id"), F.concat(F.lit("t"), "finding_id").alias("call_id"), F.col("finding_id").alias("query_id"),
        F.lit(None).cast("string").alias("agent_name"), "entity_type", "entity_value", "verdict")
    return report.trace_index(f, memory, disk, asked)


_TRACE = """
WITH f AS (SELECT *, 'case' || ord % 40 AS case_id, ord % 6 AS chunk FROM findings),
m AS (SELECT case_id, ord % 4 AS chunk, first(call_id ORDER BY ord) AS call_id FROM calls GROUP BY ALL),
d AS (SELECT case_id, string_agg(call_id, ',' ORDER BY ord) AS ids, count(*) AS n FROM calls WHERE agent_name = 'assistant' GROUP BY ALL),
t AS (SELECT f.ord, f.module, f.entity_type || ':' || f.entity_value AS entity_key, CASE f.module WHEN 'ram' THEN coalesce(m.call_id, '')
    WHEN 'disk' THEN coalesce(d.ids, '') ELSE 't' || finding_id END AS call_ids FROM f LEFT JOIN m ON m.case_id = f.case_id AND m.chunk = f.chunk
  LEFT JOIN d ON d.case_id = f.case_id)"""


@register("trace_index", _TRACE + " SELECT entity_key, module, call_ids FROM t", "findings", "calls")
def trace_index(spark, sf):
    return _trace(spark, sf).select("entity_key", "module", F.array_join("call_ids", ",").alias("call_ids"))


_CALLS_OF = """
WITH f AS (SELECT *, 'case' || ord % 3 AS case_id FROM findings WHERE module = 'disk'),
d AS (SELECT 'case' || ord % 3 AS case_id, call_id, ord FROM calls)
SELECT f.entity_type || ':' || f.entity_value AS entity_key, 'f' || f.ord AS finding_id, d.call_id,
  CAST(row_number() OVER (PARTITION BY f.ord ORDER BY d.ord, d.call_id) - 1 AS INTEGER) AS call_pos FROM f JOIN d USING (case_id)"""


@register("trace_index_many_calls", _CALLS_OF, "findings", "calls")
def trace_index_many_calls(spark, sf):
    case = F.concat(F.lit("case"), (F.col("ord") % 3).cast("string"))
    f = findings(spark, sf).where("module = 'disk'").withColumns({
        "case_id": case, "finding_id": F.concat(F.lit("f"), F.col("ord").cast("string")),
        "evidence": F.array(F.struct(F.lit("a.txt").alias("source_file"), F.col("ord").alias("line"), F.col("lang").alias("content")))})
    calls = view(spark, sf, "calls").withColumns({"case_id": case, "output_files": F.array(F.lit("disk/analyst.txt"))})
    asked = view(spark, sf, "findings").where("false").select(
        F.lit("").alias("case_id"), F.lit("").alias("call_id"), F.lit("").alias("query_id"), F.lit("").alias("agent_name"), "entity_type", "entity_value", "verdict")
    return report.trace_rows(f, calls, calls, asked).select("entity_key", "finding_id", "call_id", "call_pos")


@register("trace_markdown", _TRACE.replace("first(call_id ORDER BY ord) AS call_id", "first(call_id ORDER BY ord) AS call_id, first(agent_name ORDER BY ord) AS agent")
    .replace("string_agg(call_id, ','", "string_agg('`' || call_id || '`', ', '").replace("t AS (SELECT f.ord,", "t AS (SELECT f.ord, f.chunk, f.verdict, f.severity, finding_id, m.agent, m.call_id AS mid, d.ids, d.n,") + """
SELECT entity_key, CASE module WHEN 'ti' THEN finding_id ELSE 'ram-chunk_' || chunk || '-f001' END AS finding_id,
  '| `' || entity_key || '` | `' || CASE module WHEN 'ti' THEN finding_id ELSE 'ram-chunk_' || chunk || '-f001' END || '` | ' || module || ' | ' || coalesce(verdict, 'None')
  || ' | ' || CASE WHEN module = 'ti' OR severity IS NULL THEN '—' ELSE severity END || ' | ' || CASE module WHEN 'ti' THEN '—' ELSE '`a.txt:' || ord || '`' END
  || ' | ' || CASE module WHEN 'ti' THEN 'threat_intel/vt_lookup' WHEN 'ram' THEN coalesce(agent, 'ram/pivot_analyst') ELSE CASE WHEN n > 0 THEN 'assistant' ELSE 'disk/pivot_analyst' END END
  || ' → ' || CASE WHEN module = 'ti' THEN '`t' || finding_id || '`' WHEN module = 'ram' THEN coalesce('`' || mid || '`', '(no call recorded)')
    WHEN coalesce(n, 0) = 0 THEN '(no call recorded)' WHEN n = 1 THEN ids ELSE n || ' calls (see log): ' || ids END
  || ' | `' || CASE module WHEN 'ti' THEN 'threat_intel/queries.jsonl' WHEN 'ram' THEN 'ram/agent_calls.jsonl' ELSE 'disk/agent_calls.jsonl' END || '` |' AS row FROM t""", "findings", "calls")
def trace_markdown(spark, sf):
    return report.trace_markdown(_trace(spark, sf))


# ---- audit -----------------------------------------------------------------------


@register("cost_rollup", """
SELECT coalesce(component, 'total') AS component, count(*) AS llm_calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out
FROM calls GROUP BY ROLLUP (component)""", "calls")
def cost_rollup(spark, sf):
    return audit.cost_rollup(view(spark, sf, "calls"))


@register("agent_usage", """
SELECT agent_name, count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(latency_ms) AS BIGINT) AS latency_ms
FROM calls GROUP BY ALL""", "calls")
def agent_usage(spark, sf):
    return audit.agent_usage(view(spark, sf, "calls"))


@register("replay_nulls", """
SELECT event_id, row_number() OVER (PARTITION BY nullif(user_id % 5, 0) ORDER BY CASE WHEN event_id % 7 > 0 THEN ts END NULLS FIRST, event_id) AS step FROM events""")
def replay_nulls(spark, sf):
    case, when = F.nullif(F.col("user_id") % 5, F.lit(0)), F.when(F.col("event_id") % 7 > 0, F.col("ts"))
    e = load(spark, sf, "events").select("event_id", when.alias("ts"), case.alias("case_id"), F.col("event_id").alias("call_id"))
    return audit.replay(e).select("event_id", "step")


@register("replay", """
SELECT event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS step FROM events""")
def replay(spark, sf):
    e = load(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 5).alias("case_id"), F.col("event_id").alias("call_id"))
    return audit.replay(e).select("event_id", "step")


@register("execution_sequence", """
WITH p AS (SELECT 0 AS stage, o_orderkey AS ord, 'initial_scan' AS phase, o_orderpriority AS module FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 1, o_orderkey, 'routing_round', NULL FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 2, 0, 'report', NULL)
SELECT phase, module, row_number() OVER (ORDER BY stage, ord) AS step FROM p""")
def execution_sequence(spark, sf):
    o = load(spark, sf, "orders")
    return report.execution_sequence(
        o.where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("module"), F.col("o_orderkey").alias("ord")),
        o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("round"))).select("phase", "module", "step")
