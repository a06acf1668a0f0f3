"""Call logs: cost, usage and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.scale import ordinal

_SUMS = {"tokens_in": "tokens_in", "tokens_out": "tokens_out"}


def cost_rollup(calls: DataFrame, by: str = "component") -> DataFrame:
    """Calls and tokens per component, with the grand total as component ``total``."""
    return (
        calls.rollup(by)
        .agg(
            F.count(F.lit(1)).alias("llm_calls"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in _SUMS.items()],
            F.grouping(by).alias("_g"),
        )
        .withColumn(by, F.when(F.col("_g") == 1, F.lit("total")).otherwise(F.col(by)))
        .drop("_g")
    )


def agent_usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("agent_name").agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in _SUMS.items()],
        F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("latency_ms"),
    )


def replay(calls: DataFrame, group: str = "case_id", ts: str = "ts", tie: str = "call_id") -> DataFrame:
    """All calls of a case in time order with their step number."""
    hour = F.date_trunc("hour", ts)
    return ordinal(calls, [group], [F.col(ts), F.col(tie)], hour, "step")
