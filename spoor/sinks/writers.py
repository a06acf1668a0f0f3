"""Text and JSON sinks. Every writer is a distributed write; none collects rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.scale import small_side
from spoor.session import durable
from spoor.sources.kv import to_kv_line


def write_kv(df: DataFrame, path: str, record: str = "rec", limit: int | None = None) -> None:
    """Record lines, one folder per source file when the column is there."""
    rows = limit_records(df, limit) if limit else df
    out = rows.withColumn("value", to_kv_line(F.col(record)))
    if "source_file" in df.columns:
        out.select("source_file", "value").write.mode("overwrite").partitionBy(
            "source_file"
        ).text(path)
    else:
        out.select("value").write.mode("overwrite").text(path)


def limit_records(df: DataFrame, n: int, order: list[Column] | None = None) -> DataFrame:
    """The first ``n`` rows in source order (top-k per partition, then merged)."""
    return df.orderBy(*(order or [F.col("source_file"), F.col("line_no")])).limit(n)


def write_rejects(df: DataFrame, path: str) -> None:
    """Audit of files below the threshold; the folder exists even when there are none."""
    df.where("disposition = 'rejected'").drop("disposition").withColumnsRenamed(
        {"score": "_score", "tags": "_anomalies"}
    ).write.mode("overwrite").json(path)


def write_case_state(
    nodes: DataFrame, edges: DataFrame, rounds: DataFrame, costs: DataFrame, path: str
) -> None:
    """Case state as JSON datasets: ``nodes``, ``edges``, ``rounds``, ``cost``."""
    for name, part in (("nodes", nodes), ("edges", edges), ("rounds", rounds), ("cost", costs)):
        part.write.mode("overwrite").json(f"{path}/{name}")


def _fingerprints(part: DataFrame, by: str) -> DataFrame:
    """``(case, n, h)``: rows of a case and a hash of all of them, whatever their order."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(part.columns)), {"ignoreNullFields": "false"}))
    return part.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(20,0)")).cast("decimal(38,0)").alias("h")
    )


def update_case_state(parts: Mapping[str, DataFrame], path: str, by: str = "case_id") -> dict[str, dict[str, int]]:
    """Case state that rewrites only the cases that changed; counts per part of what was done.

    Each part is a folder with one partition per case beside a table of fingerprints. Cases
    whose fingerprint is the stored one are neither written nor moved; the others replace
    their partitions. Fingerprints are stored after the data, so a run that breaks off is made
    good by the next one. Cases that are gone leave the fingerprints, and
    :func:`read_case_state` reads only cases that are there. A null case is a case.
    """
    done = {}
    for name, part in parts.items():
        new = durable(_fingerprints(part, by))
        try:
            old = durable(part.sparkSession.read.parquet(f"{path}/{name}.cases"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            old = new.limit(0)
        before = old.select(F.col(by).alias("_case"), F.col("n").alias("_n"), F.col("h").alias("_h"))
        same = new.join(before, new[by].eqNullSafe(before["_case"]) & (F.col("n") == F.col("_n")) & (F.col("h") == F.col("_h")), "left_anti")
        changed = durable(same.select(F.col(by).alias("_case")))
        gone = old.join(new.select(F.col(by).alias("_case")), old[by].eqNullSafe(F.col("_case")), "left_anti")
        counts = {"written": changed.count(), "cases": new.count(), "removed": gone.count()}
        if counts["written"]:
            chosen = small_side(changed)
            rows = part.join(chosen, part[by].eqNullSafe(chosen["_case"]), "left_semi")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{path}/{name}")
        if counts["written"] or counts["removed"]:
            new.write.mode("overwrite").parquet(f"{path}/{name}.cases")
        done[name] = counts
    return done


def read_case_state(spark: SparkSession, path: str, name: str, by: str = "case_id") -> DataFrame:
    """The rows of one part, of the cases it holds now."""
    cases = spark.read.parquet(f"{path}/{name}.cases")
    kind = cases.schema[by].dataType
    rows = spark.read.parquet(f"{path}/{name}").withColumn(by, F.col(by).cast(kind))
    held = cases.select(F.col(by).alias("_case"))
    return rows.join(small_side(held), rows[by].eqNullSafe(F.col("_case")), "left_semi")


def write_json(df: DataFrame, path: str) -> None:
    """Findings, trace rows or report rows as JSON lines."""
    df.write.mode("overwrite").json(path)
