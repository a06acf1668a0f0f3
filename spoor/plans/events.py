"""Event-log operators and event detections over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.operators import detections as det
from spoor.operators import events as ops
from spoor.plans.bindings import oracle, view

QUERIES, ORACLES = {}, {}


def register(name: str, sql: str | None = None, *views: str):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql, *views)
        return f

    return keep


_KEYED = """
WITH k AS (SELECT *, CASE WHEN id = 1102 THEN NULL
    WHEN id IN (4624, 4625) THEN concat_ws(chr(31), id, user, src_ip, logon_type)
    WHEN id = 4688 THEN concat_ws(chr(31), id, process, parent_process, user)
    WHEN id = 5140 THEN concat_ws(chr(31), id, user, coalesce(share, '')) END AS key FROM ev)"""


@register("event_summary", _KEYED + """
SELECT 'event_summary' AS kind, first(id ORDER BY ord) AS id, first(user ORDER BY ord) AS user,
  first(computer ORDER BY ord) AS computer, first(src_ip ORDER BY ord) AS src_ip,
  first(logon_type ORDER BY ord) AS logon_type, first(process ORDER BY ord) AS process,
  first(parent_process ORDER BY ord) AS parent_process, first(share ORDER BY ord) AS share,
  count(*) AS count, min(time) AS first, max(time) AS last, min(ord) AS ord
FROM k WHERE key IS NOT NULL GROUP BY key
UNION ALL SELECT 'event', id, user, computer, src_ip, logon_type, process, parent_process, share, 1, time, time, ord
FROM k WHERE key IS NULL""", "ev")
def event_summary(spark, sf):
    return ops.presentation_order(ops.dedup_events(view(spark, sf, "ev")))


_CUTOFF = "2024-01-20"


@register("recency_cut", _KEYED + f"""
SELECT ord, id, time FROM k WHERE key IS NULL OR time >= TIMESTAMP '{_CUTOFF}'""", "ev")
def recency_cut(spark, sf):
    cutoff = F.lit(_CUTOFF).cast("timestamp_ntz")
    return ops.recency_cut(view(spark, sf, "ev"), cutoff).select("ord", "id", "time")


@register("recency_counts", _KEYED + f"""
SELECT count(*) AS read, count(*) FILTER (key IS NOT NULL AND time < TIMESTAMP '{_CUTOFF}') AS collapsed FROM k""", "ev")
def recency_counts(spark, sf):
    return ops.recency_counts(view(spark, sf, "ev"), F.lit(_CUTOFF).cast("timestamp_ntz"))


@register("event_allowlist", "SELECT ord, id FROM ev WHERE id IN (4625, 5140, 1102, 104)", "ev")
def event_allowlist(spark, sf):
    return ops.event_allowlist(view(spark, sf, "ev"), [4625, 5140]).select("ord", "id")


# ---- detections ------------------------------------------------------------------


def logons(spark, sf):
    return view(spark, sf, "ev").withColumn("src", F.col("src_ip"))


@register("brute_force", """
WITH b AS (SELECT s.ord, s.computer AS src, s.time, count(*) AS failures FROM ev s JOIN ev f ON f.computer = s.computer AND f.id = 4625
  AND f.time BETWEEN s.time - INTERVAL 12 HOUR AND s.time WHERE s.id = 4625 GROUP BY ALL HAVING count(*) >= 3)
SELECT src, max(failures) AS failures, min(time) AS first, max(time) AS last FROM b GROUP BY src""", "ev")
def brute_force(spark, sf):
    ev = view(spark, sf, "ev").withColumn("src", F.col("computer"))
    return det.brute_force(ev, 3, 43_200)


@register("brute_force_windows", """
SELECT s.ord, s.src_ip AS src, count(*) AS failures FROM ev s JOIN ev f ON f.src_ip = s.src_ip AND f.id = 4625
  AND f.time BETWEEN s.time - INTERVAL 12 HOUR AND s.time
WHERE s.id = 4625 GROUP BY ALL HAVING count(*) >= 3""", "ev")
def brute_force_windows(spark, sf):
    return det.failure_bursts(logons(spark, sf), 3, 43_200).select("ord", "src", "failures")


@register("password_spray", """
SELECT src_ip AS src, count(DISTINCT user) AS users, count(*) AS failures FROM ev WHERE id = 4625
GROUP BY src_ip HAVING count(DISTINCT user) >= 20""", "ev")
def password_spray(spark, sf):
    return det.password_spray(logons(spark, sf), 20)


@register("burst_then_success", """
SELECT s.ord, s.src_ip AS src, count(*) AS failures FROM ev s JOIN ev f
  ON f.src_ip = s.src_ip AND f.id = 4625 AND f.time BETWEEN s.time - INTERVAL 6 HOUR AND s.time
WHERE s.id = 4624 GROUP BY ALL HAVING count(*) >= 2""", "ev")
def burst_then_success(spark, sf):
    return det.burst_then_success(logons(spark, sf), 2, 21_600).select("ord", "src", "failures")


@register("remote_logons", """
SELECT ord, src_ip, CASE WHEN logon_type = '3' THEN 'external_network' ELSE 'internal_desktop' END AS finding FROM ev
WHERE id = 4624 AND ((logon_type = '3' AND NOT starts_with(src_ip, '10.')) OR (logon_type = '10' AND starts_with(src_ip, '10.')))""", "ev")
def remote_logons(spark, sf):
    return det.remote_logons(view(spark, sf, "ev")).select("ord", "src_ip", "finding")


@register("clear_then_activity", """
SELECT e.ord, e.computer, max(epoch_us(c.time)) AS cleared_us FROM ev e JOIN ev c
  ON c.computer = e.computer AND c.id = 1102 AND e.id <> 1102 AND c.time BETWEEN e.time - INTERVAL 1 HOUR AND e.time
GROUP BY ALL""", "ev")
def clear_then_activity(spark, sf):
    found = det.clear_then_activity(view(spark, sf, "ev"), within=3600)
    return found.select("ord", "computer", F.round(F.col("cleared_at") * 1_000_000).cast("bigint").alias("cleared_us"))


@register("repeated_clears", """
SELECT computer, count(*) AS clears, min(time) AS first, max(time) AS last FROM ev WHERE id = 1102
GROUP BY computer HAVING count(*) > 1""", "ev")
def repeated_clears(spark, sf):
    return det.repeated_clears(view(spark, sf, "ev"))


@register("account_changes", """
SELECT ord, user, CASE ord % 3 WHEN 0 THEN 4720 WHEN 1 THEN 4732 ELSE 7045 END AS id,
  CASE ord % 3 WHEN 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM ev WHERE id = 4648""", "ev")
def account_changes(spark, sf):
    n = F.col("ord") % 3
    ev = view(spark, sf, "ev").withColumn(
        "id", F.when(F.col("id") != 4648, F.col("id")).when(n == 0, 4720).when(n == 1, 4732)
        .otherwise(7045))
    return det.account_changes(ev).select("ord", "user", "id", "severity")


@register("lateral_sweep", """
WITH n AS (SELECT ord, user, computer, time FROM ev WHERE id = 4624 AND logon_type = '3'),
w AS (SELECT s.ord, s.user AS src, s.time, count(DISTINCT f.computer) AS hosts FROM n s JOIN n f ON f.user = s.user
  AND f.time BETWEEN s.time - INTERVAL 1 DAY AND s.time GROUP BY ALL HAVING count(DISTINCT f.computer) >= 2)
SELECT src, CAST(max(hosts) AS INTEGER) AS hosts, min(time) AS first, max(time) AS last FROM w GROUP BY src""", "ev")
def lateral_sweep(spark, sf):
    ev = view(spark, sf, "ev").withColumn("src", F.col("user"))
    return det.lateral_sweep(ev, 2, 86_400)


@register("logon_before_share_use", """
SELECT s.ord, max(epoch_us(l.time)) AS logon_us FROM ev s JOIN ev l ON l.user = s.user AND l.id = 4624
  AND l.time BETWEEN s.time - INTERVAL 30 MINUTE AND s.time WHERE s.id = 5140 GROUP BY ALL""", "ev")
def logon_before_share_use(spark, sf):
    ev = view(spark, sf, "ev")
    found = det.preceded_by(ev.where("id = 5140"), ev.where("id = 4624"), ["user"], 1800)
    return found.select("ord", F.round(F.col("preceded_at") * 1_000_000).cast("bigint").alias("logon_us"))
