"""Known-good filters, set operations and contract checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import rules
from spoor.functions import contains_any, expand_env, ext_in, norm_path
from spoor.functions.paths import starts_with_any


def union_sources(**tables: DataFrame) -> DataFrame:
    """Union of record tables with different columns, tagged with their name."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def _field(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def publisher_rule(
    df: DataFrame,
    suspicious: Sequence[str] = rules.SUSPICIOUS_PATHS,
    prefixes: Sequence[str] = rules.PUBLISHER_PREFIXES,
    authors: Sequence[str] = rules.PUBLISHER_AUTHORS,
    boring: Sequence[str] = rules.BORING_TASK_PREFIXES,
) -> DataFrame:
    """Adds ``rule``: the first rule that decides a record; null when none does.

    ``suspicious`` keeps the record, every other rule drops it, except that a WMI
    record is settled by its stub flag alone (``wmi`` drops, ``wmi_kept`` keeps).
    """
    action = F.coalesce(
        *[F.nullif(_field(df, n), F.lit("")) for n in ("action", "path", "data", "url")],
        F.lit(""),
    )
    staged = df.withColumns(
        {
            "_action": action,
            "_author": F.trim(_field(df, "author")),
            "_boring": starts_with_any(F.lower(F.trim(_field(df, "name"))), boring),
            "_run_as": F.trim(_field(df, "run_as")),
        }
    )
    wmi = (_field(df, "type") == "persistence") & (_field(df, "mechanism") == "wmi")
    norm = expand_env(F.lower(F.replace(F.col("_action"), F.lit("/"), F.lit("\\"))))
    norm = F.regexp_replace(F.regexp_replace(norm, '^[" ]+', ""), r"\\{2,}", r"\\")
    staged = staged.withColumn("_norm", norm)
    n, run_as = F.col("_norm"), F.col("_run_as")
    vendor = (F.col("_author") != "") & contains_any(F.col("_author"), authors)
    return staged.withColumn(
        "rule",
        F.when(contains_any(F.col("_action"), suspicious), "suspicious")
        .when(wmi & (_field(df, "needs_full_parser") == "true"), "wmi")
        .when(wmi, "wmi_kept")
        .when(F.col("_action") == "", "empty")
        .when(starts_with_any(n, prefixes), "canonical")
        .when(
            ~n.contains("\\") & ~n.contains(":") & run_as.isin(rules.SYSTEM_ACCOUNTS),
            "bare_name",
        )
        .when(vendor & F.col("_boring"), "vendor")
        .when(run_as.isin(rules.TOP_SYSTEM_ACCOUNTS) & F.col("_boring"), "system_task"),
    ).drop("_action", "_author", "_boring", "_run_as", "_norm")


def publisher_whitelist(df: DataFrame, **cfg: Sequence[str]) -> DataFrame:
    """Records worth a look: vendor noise in canonical places is gone."""
    rule = F.col("rule")
    return publisher_rule(df, **cfg).where(
        rule.isNull() | rule.isin("suspicious", "wmi_kept")
    ).drop("rule")


def drop_categories(
    df: DataFrame, categories: Sequence[str] = rules.DROPPED_CATEGORIES, col: str = "category"
) -> DataFrame:
    low = F.trim(F.lower(F.coalesce(F.col(col), F.lit(""))))
    return df.where(~low.isin([c.lower() for c in categories]))


def category_counts(
    df: DataFrame, categories: Sequence[str] = rules.DROPPED_CATEGORIES, col: str = "category"
) -> DataFrame:
    """One row: records read and dropped."""
    low = F.trim(F.lower(F.coalesce(F.col(col), F.lit(""))))
    return df.agg(
        F.count(F.lit(1)).alias("read"),
        F.count_if(low.isin([c.lower() for c in categories])).alias("dropped"),
    )


def emit_file_filter(
    df: DataFrame,
    path: str = "path",
    subtrees: Sequence[str] = rules.EXCLUDED_SUBTREES,
    noise: Sequence[str] = rules.NOISE_EXTENSIONS,
    suspicious: Sequence[str] = rules.SUSPICIOUS_PATHS,
    images: Sequence[str] = rules.IMAGE_EXTENSIONS,
    only_suspicious: bool = False,
) -> DataFrame:
    """File records worth writing; unresolved paths (``<...``) and empty ones always pass."""
    p = F.col(path)
    # the filter is pushed below the projection that makes the path: each test makes it again,
    # so each is written once, and the rare ones last
    quiet = ~ext_in(p, noise)
    if only_suspicious:
        quiet = ext_in(p, images) & quiet
    kept = (contains_any(p, suspicious) | quiet) & ~contains_any(p, subtrees)
    return df.where(kept | F.coalesce((p == "") | p.startswith("<"), F.lit(True)))


def flag_suspicious(
    df: DataFrame, path: str = "path", paths: Sequence[str] = rules.SUSPICIOUS_PATHS
) -> DataFrame:
    return df.withColumn("suspicious_path", contains_any(F.col(path), paths))


def hidden_processes(listed: DataFrame, scanned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys the pool scan found that the process list does not show."""
    return scanned.select(*keys).distinct().join(listed.select(*keys), list(keys), "left_anti")


def verdict_overlap(df: DataFrame, wanted: Sequence[str], col: str = "verdicts") -> DataFrame:
    return df.where(F.arrays_overlap(F.col(col), F.array(*[F.lit(w) for w in wanted])))


def new_entities(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entities of ``after`` that ``before`` does not have."""
    return after.select("type", "value").subtract(before.select("type", "value"))


# ---- contracts -------------------------------------------------------------------

_MODULE = r"^[a-z][a-z0-9_]{0,31}$"
_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _rules_of(contract: str) -> Mapping[str, Column]:
    """Violation name -> condition under which a row violates the contract."""
    def missing(c: str) -> Column:
        return F.col(c).isNull()

    def empty(c: str) -> Column:
        return F.coalesce(F.length(F.col(c)), F.lit(0)) < 1

    def off(c: str, pattern: str) -> Column:
        return F.coalesce(~F.col(c).rlike(pattern), F.lit(True))

    entity = {
        "entity_type": ~F.coalesce(F.col("entity_type"), F.lit("")).isin(rules.ENTITY_TYPES),
        "entity_value": empty("entity_value"),
    }
    if contract == "query":
        return {
            "contract_version": F.coalesce(F.col("contract_version") != "1.0", F.lit(True)),
            "query_id": off("query_id", _UUID),
            "round": F.coalesce(F.col("round") < 0, F.lit(True)),
            "case_id": empty("case_id"),
            "target_module": off("target_module", _MODULE),
            **entity,
            "source_module": off("source_module", _MODULE),
            "source_finding_id": F.col("source_finding_id") == "",
            "reason": empty("reason"),
            "max_evidence_lines": F.col("max_evidence_lines") < 1,
        }
    bad_severity = F.when(
        F.col("verdict") == "CONFIRMED",
        ~F.coalesce(F.col("severity"), F.lit("")).isin(rules.SEVERITIES),
    ).otherwise(F.col("severity").isNotNull())
    return {
        "contract_version": F.coalesce(F.col("contract_version") != "1.0", F.lit(True)),
        "query_id": off("query_id", _UUID),
        "responding_module": off("responding_module", _MODULE),
        **entity,
        "verdict": ~F.coalesce(F.col("verdict"), F.lit("")).isin(rules.VERDICTS),
        "severity": bad_severity,
        "mitre": F.exists(F.coalesce(F.col("mitre"), F.array().cast("array<string>")),
                          lambda m: ~m.rlike(r"^T[0-9]{4}(\.[0-9]{3})?$")),
        "justification": empty("justification"),
        "evidence": missing("evidence")
        | F.exists(
            "evidence",
            lambda e: (F.coalesce(F.length(e["source_file"]), F.lit(0)) < 1)
            | (F.coalesce(e["line"], F.lit(0)) < 1)
            | e["content"].isNull()
            | e["verbatim"].isNull(),
        ),
        "related_entities": missing("related_entities")
        | F.exists(
            "related_entities",
            lambda r: ~F.coalesce(r["type"], F.lit("")).isin(rules.ENTITY_TYPES)
            | (F.coalesce(F.length(r["value"]), F.lit(0)) < 1)
            | (F.coalesce(F.length(r["relationship"]), F.lit(0)) < 1),
        ),
        "cost": F.coalesce(
            (F.col("cost.llm_calls") < 0)
            | (F.col("cost.tokens_in") < 0)
            | (F.col("cost.tokens_out") < 0),
            F.lit(True),
        ),
    }


def check_contract(df: DataFrame, contract: str = "findings") -> DataFrame:
    """Rows with the array of contract fields they violate."""
    checks = _rules_of(contract)
    return df.withColumn(
        "violations",
        F.array_compact(
            F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in checks.items()])
        ),
    )


def valid_related(df: DataFrame, col: str = "related_entities") -> DataFrame:
    """Keep related entities of a known type; count and name the dropped types."""
    known = F.filter(col, lambda r: r["type"].isin(rules.ENTITY_TYPES))
    bad = F.array_sort(
        F.array_distinct(
            F.transform(
                F.filter(col, lambda r: ~F.coalesce(r["type"].isin(rules.ENTITY_TYPES), F.lit(False))),
                lambda r: F.coalesce(r["type"], F.lit("None")),
            )
        )
    )
    return df.select(
        *[c for c in df.columns if c != col],
        known.alias(col),
        (F.size(col) - F.size(known)).alias("dropped"),
        bad.alias("dropped_types"),
    )


def trivially_benign(
    queries: DataFrame,
    evidence: DataFrame,
    prefixes: Sequence[str] = rules.TRUSTED_FILE_PREFIXES,
    blockers: str = rules.BENIGN_BLOCKERS_DISK,
) -> DataFrame:
    """Queries about files under trusted paths with no suspicious evidence line.

    ``queries``: query_id, entity_type, entity_value; ``evidence``: query_id, content.
    """
    path = norm_path(F.col("entity_value"))
    bare = F.regexp_replace(path, r"^[a-z]:[/\\]", "")
    trusted = queries.where(
        F.col("entity_type").isin("file_path", "image_name")
        & (starts_with_any(path, prefixes) | starts_with_any(bare, prefixes))
    )
    blocked = evidence.where(F.col("content").rlike(blockers)).select("query_id").distinct()
    return trusted.join(blocked, "query_id", "left_anti")




