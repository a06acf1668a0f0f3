"""Text blocks: process lines, findings, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import rules
from spoor.functions import infer_type, mitre_ids
from spoor.sources.kv import last_wins_map


def parse_process_lines(df: DataFrame, col: str = "content") -> DataFrame:
    """Process rows of chunk lines: the known names delimit the values."""
    names = "|".join(rules.PROCESS_FIELDS)
    pattern = rf"(?<!\w)({names})=(.*?)(?=(?<!\w)(?:{names})=|$)"
    line = F.trim(F.col(col))
    pairs = F.transform(
        F.regexp_extract_all(line, F.lit(pattern), F.lit(0)),
        lambda t: F.struct(
            F.regexp_extract(t, r"^(\w+)=", 1).alias("k"),
            F.trim(F.regexp_extract(t, r"^\w+=(.*)$", 1)).alias("v"),
        ),
    )
    keep = [c for c in df.columns if c != col]
    rows = (
        df.where((line != "") & ~line.startswith("#"))
        .select(*keep, last_wins_map(pairs).alias("_f"))
        .where(F.coalesce(F.col("_f")["pid"], F.lit("")) != "")
    )
    cmd = F.coalesce(F.col("_f")["cmd"], F.lit(""))
    return rows.select(
        *keep,
        *[
            (F.regexp_replace(cmd, r'^"(.*)"$', "$1") if n == "cmd" else F.col("_f")[n]).alias(n)
            for n in rules.PROCESS_FIELDS
        ],
    )


def _fields(lines: Column) -> Column:
    """MAP of the ``key: value`` lines of a block; key in lower case with underscores."""
    kv = F.filter(
        F.transform(lines, lambda x: F.trim(x)),
        lambda x: x.contains(":") & ~x.startswith("#"),
    )
    pairs = F.transform(
        kv,
        lambda x: F.struct(
            F.replace(F.lower(F.trim(F.regexp_extract(x, r"^([^:]*):", 1))), F.lit(" "), F.lit("_"))
            .alias("k"),
            F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v"),
        ),
    )
    return last_wins_map(pairs)


def parse_finding_blocks(df: DataFrame, text: str = "text", marker: str = "[FINDING]") -> DataFrame:
    """One row per non-empty block with its order ``idx`` and a ``fields`` map.

    ``[PROCESS]`` blocks end at their first blank line and need a ``pid``.
    """
    keep = [c for c in df.columns if c != text]
    escaped = marker.replace("[", r"\[").replace("]", r"\]")
    body = F.concat(F.lit("\n"), F.col(text))
    parts = F.split(body, rf"\n[ \t]*{escaped}[ \t\r]*(?=\n|$)")
    blocks = df.select(*keep, F.posexplode(parts).alias("_i", "_block")).where("_i > 0")
    if marker == "[PROCESS]":
        content = F.regexp_replace(F.col("_block"), r"^\r?\n", "")
        inside = F.regexp_extract(content, r"(?s)^(.*?)(?:\n[ \t\r]*\n|$)", 1)
        known = F.filter(
            F.split(inside, r"\r?\n"), lambda x: x.rlike("^(pid|ppid|image|cmdline): ")
        )
        found = blocks.select(*keep, "_i", _fields(known).alias("fields")).where(
            F.coalesce(F.col("fields")["pid"], F.lit("")) != ""
        )
    else:
        found = blocks.select(
            *keep, "_i", _fields(F.split(F.col("_block"), r"\r?\n")).alias("fields")
        ).where(F.size("fields") > 0)
    return found.withColumnRenamed("_i", "idx")


def _line_value(block: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(block, rf"(?im)^{name}:[ \t]*(\S.*)$", 1))


def _evidence_disk(block: Column) -> Column:
    """Evidence structs: ``[file Ln]: text``, ``Ln: text`` or plain text; first 50."""
    section = F.regexp_extract(block, r"(?is)Key Evidence:[ \t\r]*\n(.*?)(?:\n-{40}|$)", 1)
    lines = F.filter(
        F.transform(
            F.split(section, r"\r?\n"),
            lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[- ]+", "")),
        ),
        lambda x: x != "",
    )
    full, short = r"(?i)^\[([^\]]+)\s+L(\d+)\]:\s*(.*)", r"^L(\d+):\s*(.*)"

    def item(x: Column) -> Column:
        return F.struct(
            F.when(x.rlike(full), F.trim(F.regexp_extract(x, full, 1)))
            .otherwise("analyst.txt")
            .alias("source_file"),
            F.when(x.rlike(full), F.regexp_extract(x, full, 2))
            .when(x.rlike(short), F.regexp_extract(x, short, 1))
            .otherwise("1")
            .cast("bigint")
            .alias("line"),
            F.when(x.rlike(full), F.regexp_extract(x, full, 3))
            .when(x.rlike(short), F.regexp_extract(x, short, 2))
            .otherwise(x)
            .alias("content"),
        )

    return F.slice(F.transform(lines, item), 1, rules.EVIDENCE_LINES)


def parse_verdict_blocks(df: DataFrame, text: str = "text", dialect: str = "disk") -> DataFrame:
    """Verdict rows of an analyst text.

    ``disk`` blocks carry a ``Key:`` and get the entity type of its shape; a block
    without one keeps its number but gives no row. ``memory`` blocks carry
    ``PID:`` and belong to the chunk named by the last chunk header above them.
    """
    keep = [c for c in df.columns if c != text]
    if dialect == "disk":
        return _disk_blocks(df, text, keep)
    return _memory_blocks(df, text, keep)


def _disk_blocks(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    parts = F.split(F.col(text), r"(?=\[(?:CONFIRMED|INCONCLUSIVE|REJECTED)\])")
    head = r"(?s)^\s*\[(CONFIRMED|INCONCLUSIVE|REJECTED)\]"
    chosen = F.filter(parts, lambda p: p.rlike(head))
    b = F.col("_b")
    verdict = F.regexp_extract(b, head, 1)
    rows = df.select(*keep, F.posexplode(chosen).alias("_i", "_raw")).select(
        *keep, "_i", F.trim("_raw").alias("_b")
    )
    key = _line_value(b, "Key")
    reason = F.trim(
        F.regexp_extract(
            b, r"(?is)Justification:[ \t\r]*\n(.*?)(?:\n\s*Key Evidence:|\n-{40}|$)", 1
        )
    )
    rejected = verdict == "REJECTED"
    severity = F.upper(_line_value(b, "Severity"))
    none = F.array().cast("array<struct<source_file:string,line:bigint,content:string>>")
    return rows.where(key != "").select(
        *keep,
        F.concat(F.lit("disk-scan-f"), F.printf(F.lit("%03d"), F.col("_i") + 1)).alias(
            "finding_id"
        ),
        verdict.alias("verdict"),
        F.when(
            verdict == "CONFIRMED",
            F.when(severity.isin(rules.SEVERITIES), severity).otherwise("MEDIUM"),
        ).alias("severity"),
        F.when(rejected, F.array().cast("array<string>"))
        .otherwise(mitre_ids(_line_value(b, "MITRE")))
        .alias("mitre"),
        F.coalesce(infer_type(key), F.lit("image_name")).alias("entity_type"),
        key.alias("entity_value"),
        F.when(
            rejected,
            F.coalesce(
                F.nullif(_line_value(b, "Legitimate explanation"), F.lit("")),
                F.nullif(_line_value(b, "Justification"), F.lit("")),
                F.concat(F.lit("Rejected: "), key),
            ),
        )
        .otherwise(
            F.coalesce(F.nullif(reason, F.lit("")), F.concat(F.lit("Disk finding: "), key))
        )
        .alias("justification"),
        F.when(rejected, none).otherwise(_evidence_disk(b)).alias("evidence"),
    )


def _memory_blocks(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    chunk_cut = r"(?m)^(?==== CHUNK \d+: \S+ ===)"
    block_cut = r"(?m)^(?=\[(?:CONFIRMED|INCONCLUSIVE|REJECTED)\]\s*$)"
    chunks = df.select(*keep, F.posexplode(F.split(F.col(text), chunk_cut)).alias("_c", "_chunk"))
    label = F.regexp_extract("_chunk", r"^=== CHUNK \d+: (\S+) ===", 1)
    blocks = chunks.select(
        *keep,
        "_c",
        F.when(label != "", F.regexp_replace(label, r"(?<=[^.])\.[^.]*$", ""))
        .otherwise("unknown")
        .alias("chunk"),
        F.posexplode(F.split("_chunk", block_cut)).alias("_i", "_raw"),
    )
    head = r"^\[(CONFIRMED|INCONCLUSIVE|REJECTED)\]\s*?(?:\n|$)"
    blocks = blocks.where(F.col("_raw").rlike(head)).withColumn(
        "_b", F.regexp_extract("_raw", r"(?s)^(.*?)(?:\n={64}|$)", 1)
    )
    b = F.col("_b")

    def last(name: str) -> Column:
        hits = F.regexp_extract_all(b, F.lit(rf"(?m)^{name}:(.*)$"), F.lit(1))
        return F.trim(F.try_element_at(hits, F.lit(-1)))

    why = F.regexp_extract(b, r"(?m)^Justification:((?:.*)(?:\n  .*)*)", 1)
    section = F.regexp_extract(b, r"(?s)\nKey Evidence:[^\n]*\n(.*)$", 1)
    item = r"(?m)^\s*-\s+L(\d+):\s+(.+)$"
    evidence = F.transform(
        F.regexp_extract_all(section, F.lit(item), F.lit(0)),
        lambda x: F.struct(
            F.regexp_extract(x, r"L(\d+):", 1).cast("bigint").alias("line"),
            F.trim(F.regexp_extract(x, r"L\d+:\s+(.+)$", 1)).alias("content"),
        ),
    )
    return blocks.where(last("PID").isNotNull()).select(
        *keep,
        "chunk",
        F.shiftleft(F.col("_c").cast("bigint"), 32).bitwiseOR(F.col("_i").cast("bigint")).alias("block_no"),
        F.regexp_extract(b, head, 1).alias("verdict"),
        last("PID").alias("pid"),
        last("PPID").alias("ppid"),
        last("Image").alias("image"),
        last("Cmdline").alias("cmdline"),
        F.upper(last("Severity")).alias("severity"),
        F.coalesce(mitre_ids(last("MITRE")), F.array().cast("array<string>")).alias("mitre"),
        F.trim(F.regexp_replace(why, r"\s*\n\s*", " ")).alias("justification"),
        evidence.alias("evidence"),
    )


def header_rejected(c: Column) -> Column:
    """Largest ``rejected=n`` of the chunk headers in a text."""
    numbers = F.transform(
        F.regexp_extract_all(c, F.lit(r"(?i)rejected=(\d+)"), F.lit(1)), lambda x: x.cast("bigint")
    )
    return F.coalesce(F.array_max(numbers), F.lit(0).cast("bigint"))
