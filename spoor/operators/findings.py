"""Findings: reportable rows, numbering, evidence, counts, metrics, corroboration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import rules
from spoor.functions import extract_indicators, normalize_type
from spoor.scale import ordinal


def reportable_findings(df: DataFrame) -> DataFrame:
    """Rejected rows removed; severity only on CONFIRMED rows, MEDIUM when it is missing."""
    return df.where(F.col("verdict") != "REJECTED").withColumn(
        "severity",
        F.when(F.col("verdict") == "CONFIRMED", F.coalesce("severity", F.lit("MEDIUM"))),
    )


def verdict_counts(
    findings: DataFrame, headers: DataFrame | None = None, by: Sequence[str] = ("module",),
    mode: str = "max",
) -> DataFrame:
    """Confirmed, inconclusive and rejected per module.

    ``headers`` (module, rejected) are the counts chunk headers report; the larger
    of counted and reported wins (``mode='sum'`` adds the headers up first).
    """
    by = list(by)
    counts = findings.groupBy(*by).agg(
        *[
            F.count_if(F.col("verdict") == v).alias(v.lower())
            for v in ("CONFIRMED", "INCONCLUSIVE", "REJECTED")
        ]
    )
    if headers is None:
        return counts
    best = F.max("rejected") if mode == "max" else F.sum("rejected")
    told = headers.groupBy(*by).agg(best.cast("bigint").alias("_told"))
    return counts.join(told, by, "left").withColumn(
        "rejected", F.greatest("rejected", F.coalesce("_told", F.lit(0)))
    ).drop("_told")


def number_findings(df: DataFrame, order: str = "block_no", module: str = "ram") -> DataFrame:
    """Ids ``module-chunk-f001`` in source order inside each chunk."""
    numbered = ordinal(df, ["chunk"], [F.col(order)], F.floor(F.col(order) / 100_000), "_n")
    n = F.col("_n").cast("string")
    return numbered.withColumn(
        "finding_id",
        F.concat(
            F.lit(f"{module}-"), "chunk", F.lit("-f"),
            F.when(F.length(n) >= 3, n).otherwise(F.lpad(n, 3, "0")),
        ),
    ).drop("_n")


def batch(df: DataFrame, n: int, order: str, group: Sequence[str] = (), width: int = 100_000) -> DataFrame:
    """Consecutive batches of ``n`` rows in ``order``; ``batch`` starts at 0."""
    keys = list(group)
    work = df if keys else df.withColumn("_all", F.lit(0))
    out = ordinal(work, keys or ["_all"], [F.col(order)], F.floor(F.col(order) / width), "_n")
    return out.withColumn("batch", F.floor((F.col("_n") - 1) / n)).drop("_n", "_all")


def backfill_source(
    evidence: DataFrame, index: DataFrame, fallback: str = rules.FALLBACK_EVIDENCE_FILE
) -> DataFrame:
    """Source file of an evidence line from (chunk, line, text); the first entry wins.

    ``index``: chunk, ord, source_file, line, content.
    """
    first = index.groupBy("chunk", "line", F.trim("content").alias("_text")).agg(
        F.min_by("source_file", "ord").alias("source_file")
    )
    return (
        evidence.withColumn("_text", F.trim("content"))
        .join(first, ["chunk", "line", "_text"], "left")
        .withColumn("source_file", F.coalesce("source_file", F.lit(fallback)))
        .drop("_text")
    )


def attach_evidence(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence text of each finding by ordinal; empty where there is none."""
    return findings.join(evidence.select("idx", "evidence"), "idx", "left").withColumn(
        "evidence", F.coalesce("evidence", F.lit(""))
    )


def related_entities(df: DataFrame, cols: Sequence[str] = ("cmdline", "content")) -> DataFrame:
    """Distinct ``(finding_id, type, value, relationship)`` from image, ppid and texts."""
    def one(value: Column, declared: str, label: str) -> DataFrame:
        v = F.trim(value)
        return df.where(F.coalesce(v, F.lit("")) != "").select(
            "finding_id",
            normalize_type(v, F.lit(declared))["type"].alias("type"),
            v.alias("value"),
            F.lit(label).alias("relationship"),
        )

    parts = [one(F.col("image"), "image_name", "process_image"),
             one(F.col("ppid"), "pid", "parent_pid")]
    for c in cols:
        parts.append(
            df.select("finding_id", F.explode(extract_indicators(F.col(c))).alias("_e")).select(
                "finding_id", "_e.type", "_e.value", "_e.relationship"
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.when(F.col("relationship") == "process_image", 0).when(
        F.col("relationship") == "parent_pid", 1).otherwise(2)
    return out.groupBy("finding_id", "type", "value").agg(
        F.min_by("relationship", F.struct(rank, "relationship")).alias("relationship")
    )


def confirm_metrics(findings: DataFrame, by: str = "dataset") -> DataFrame:
    """Confirm rate, confirmed-to-inconclusive ratio and severity mix per dataset."""
    c = F.count_if(F.col("verdict") == "CONFIRMED")
    i = F.count_if(F.col("verdict") == "INCONCLUSIVE")
    return findings.groupBy(by).agg(
        c.alias("confirmed"),
        i.alias("inconclusive"),
        (c + i).alias("total"),
        F.round(100 * F.try_divide(c, c + i), 2).alias("confirm_rate"),
        F.round(F.try_divide(c, i), 2).alias("ratio"),
        *[
            F.count_if((F.col("verdict") == "CONFIRMED") & (F.col("severity") == s)).alias(
                s.lower()
            )
            for s in rules.SEVERITIES
        ],
    )


def merge_triage(**outputs: DataFrame) -> DataFrame:
    """One findings table of several triage outputs, tagged with their source."""
    from spoor.operators.filters import union_sources

    return union_sources(**outputs).withColumnRenamed("source", "triage_source")


def triage_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("triage_source").agg(F.count(F.lit(1)).alias("findings"))


# ---- host facts ------------------------------------------------------------------

# Where each fact stands in a registry line.
HOST_FACTS = {
    "hostname": r"ComputerName\\ComputerName\s+value=ComputerName\s+data=(\S+)",
    "network_domain": r"value=DhcpDomain\s+data=(\S+)",
    "last_used_account": r"value=LastUsedUsername\s+data=(\S+)",
}
CURRENT_SYSTEM = ['description="System Info (Current)"', "artifact_source=SOFTWARE"]
SYSTEM_FACTS = {
    "os": ("value=ProductName", r'data="([^"]+)"'),
    "os_version": ("value=DisplayVersion", r'data="?([^\s"]+)"?'),
    "os_build": ("value=CurrentBuildNumber", r"data=(\d+)"),
}
ACCOUNT = r'data="Username:\s+(\S+)\s+Id:\s+(\d+)\s+ValidUserId:\s+True"'


def host_profile(lines: DataFrame, by: str = "case_id") -> DataFrame:
    """First match of each host fact, per case. ``lines``: case, line_no, content."""
    text = F.col("content")
    current = text.contains(CURRENT_SYSTEM[0]) & text.contains(CURRENT_SYSTEM[1])
    found = {n: F.regexp_extract(text, p, 1) for n, p in HOST_FACTS.items()}
    for n, (mark, p) in SYSTEM_FACTS.items():
        found[n] = F.when(current & text.contains(mark), F.regexp_extract(text, p, 1))
    return lines.groupBy(by).agg(
        *[
            F.min_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("line_no"))).alias(n)
            for n, c in found.items()
        ]
    )


def host_accounts(lines: DataFrame, by: str = "case_id") -> DataFrame:
    """User accounts of a host, one row each."""
    text = F.col("content")
    return lines.where(text.rlike(ACCOUNT)).select(
        by, "line_no",
        F.regexp_extract(text, ACCOUNT, 1).alias("username"),
        F.regexp_extract(text, ACCOUNT, 2).cast("bigint").alias("rid"),
    )


# ---- corroboration ---------------------------------------------------------------


def corroborate(evidence: DataFrame, by: Sequence[str] = ("entity_type", "entity_value")) -> DataFrame:
    """CONFIRMED with two independent artifact classes, INCONCLUSIVE with one.

    An entity without evidence rows (null class) is REJECTED when its signal is
    weak, else INCONCLUSIVE. ``evidence``: entity, artifact_class, weak.
    """
    return evidence.groupBy(*by).agg(
        F.count_distinct("artifact_class").alias("classes"), F.bool_and("weak").alias("weak")
    ).withColumn(
        "verdict",
        F.when(F.col("classes") >= 2, "CONFIRMED")
        .when((F.col("classes") == 0) & F.col("weak"), "REJECTED")
        .otherwise("INCONCLUSIVE"),
    )


def stack_severity(signals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Highest severity of an item, one tier up when two categories agree.

    ``signals``: the ``by`` columns, category, severity.
    """
    level = F.array_position(F.array(*[F.lit(s) for s in rules.SEVERITIES]), F.col("severity"))
    return signals.groupBy(*by).agg(
        F.max(level).alias("_level"), F.count_distinct("category").alias("categories")
    ).select(
        *by, "categories",
        F.element_at(
            F.array(*[F.lit(s) for s in rules.SEVERITIES]),
            F.least(
                F.col("_level") + F.when(F.col("categories") >= 2, 1).otherwise(0),
                F.lit(len(rules.SEVERITIES)),
            ).cast("int"),
        ).alias("severity"),
    )


def suspicion_tier(df: DataFrame, signals: str = "signals") -> DataFrame:
    """Tier A for inconclusive entities with two or more distinct signals, else B."""
    return df.where(F.col("verdict") == "INCONCLUSIVE").withColumn(
        "tier", F.when(F.size(F.array_distinct(F.col(signals))) >= 2, "A").otherwise("B")
    )


