"""Numbered lines of text artifacts of any size, and tool health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spoor import rules
from spoor.functions import base_name
from spoor.scale import small_side
from spoor.session import durable


def clean_text(c: Column) -> Column:
    """Drop bytes that are not UTF-8."""
    return F.replace(F.make_valid_utf8(c), F.lit("\ufffd"), F.lit(""))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, source_file, line_no, content)`` with true line numbers.

    Files stay splittable. They are scanned once, into the shared folder: numbering a
    second scan would go wrong if that were split in another way. Lines are counted per
    file block, and the block counts (one row per block, not per line) give each block
    its first line number.
    """
    raw = durable(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
            clean_text(F.col("value")).alias("content"),
        )
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    ).select(
        "path",
        "block",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_seq") + 1).alias("shift"),
    )
    return raw.join(small_side(blocks), ["path", "block"]).select(
        "path",
        base_name(F.col("path")).alias("source_file"),
        (F.col("seq") + F.col("shift")).alias("line_no"),
        "content",
    )


def split_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Lines of a text column: the other columns plus ``line_no`` and ``content``."""
    rest = [c for c in df.columns if c != text]
    body = F.regexp_replace(F.col(text), r"\r?\n$", "")
    return df.select(*rest, F.posexplode(F.split(body, r"\r?\n")).alias("_i", "content")).select(
        *rest, (F.col("_i") + 1).cast("bigint").alias("line_no"), "content"
    )


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """File bodies: ``(path, modified, length, content)``."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.col("modificationTime").alias("modified"), "length", "content"
    )


def recent_files(df: DataFrame, days: int, now: Column, path: str = "path",
                 modified: str = "modified") -> DataFrame:
    """Drop ``archive-`` files older than ``days``; other files always stay."""
    archived = F.lower(base_name(F.col(path))).startswith("archive-")
    return df.where(~archived | (F.col(modified) >= now - F.make_interval(days=F.lit(days))))


def route_log_file(c: Column) -> Column:
    """Struct ``(bucket, source, is_sysmon)`` from a log file path; null for other files."""
    name = F.substring_index(c, "/", -1)
    low = F.lower(name)
    bucket = F.when(low.endswith(".evtx"), F.lit("eventlog_application.txt"))
    source = name
    for known, (target, label) in rules.LOG_FILES.items():
        bucket = F.when(low == known, F.lit(target)).otherwise(bucket)
        source = F.when(low == known, F.lit(label)).otherwise(source)
    return F.when(
        bucket.isNotNull(),
        F.struct(
            bucket.alias("bucket"),
            source.alias("source"),
            low.contains("sysmon").alias("is_sysmon"),
        ),
    )


def artifact_health(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """``(source_file, status, data_rows)`` for every expected file.

    ``lines`` has ``source_file, line_no, content``; ``expected`` has ``source_file``.
    """
    filled = F.trim(F.col("content")) != ""
    counted = lines.where(filled).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("filled"),
        F.min_by("content", "line_no").alias("first"),
    )
    banner = F.col("first").startswith(rules.TOOL_BANNER).cast("int")
    rows = F.greatest(F.coalesce(F.col("filled") - banner - 1, F.lit(0)), F.lit(0))
    present = lines.select("source_file").distinct().withColumn("present", F.lit(True))
    return (
        expected.join(present, "source_file", "left")
        .join(counted, "source_file", "left")
        .select(
            "source_file",
            F.when(F.col("present").isNull(), "missing")
            .when(F.ltrim(F.col("first")).startswith("# ERROR"), "failed")
            .when(rows == 0, "empty")
            .otherwise("ok")
            .alias("status"),
            rows.cast("bigint").alias("data_rows"),
        )
    )
