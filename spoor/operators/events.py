"""Event logs: allow-lists, recency, and the collapse of repeated events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor import rules


def event_allowlist(
    df: DataFrame,
    allow: Sequence[int],
    always: Sequence[int] = rules.ALWAYS_EMIT_EVENTS,
    col: str = "id",
) -> DataFrame:
    """Rows of allowed ids; always-emit ids pass; an empty list allows everything."""
    return df.where(F.col(col).isin(*allow, *always)) if allow else df


def event_key(df: DataFrame, keymap=rules.EVENT_KEYS) -> Column:
    """Text two events share when they repeat each other; null for events kept as they are."""
    def field(names: Sequence[str]) -> Column:
        have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*have, F.lit(""))

    key = None
    for ids, fields in keymap:
        text = F.concat_ws("\u001f", F.col("id").cast("string"), *[field(f) for f in fields])
        hit = F.col("id").isin(*ids)
        key = F.when(hit, text) if key is None else key.when(hit, text)
    return key


def mark_events(
    df: DataFrame,
    keymap=rules.EVENT_KEYS,
    always: Sequence[int] = rules.ALWAYS_EMIT_EVENTS,
    cutoff: Column | None = None,
) -> DataFrame:
    """Adds ``_key`` and ``_old`` (collapsible events before the cutoff)."""
    key = F.when(~F.coalesce(F.col("id").isin(*always), F.lit(False)), event_key(df, keymap))
    marked = df.withColumn("_key", key)
    old = F.lit(False) if cutoff is None else (
        F.col("_key").isNotNull() & F.coalesce(F.col("time") < cutoff, F.lit(False))
    )
    return marked.withColumn("_old", old)


def recency_cut(df: DataFrame, cutoff: Column, **kw) -> DataFrame:
    """Drop collapsible events older than the cutoff; other events stay."""
    return mark_events(df, cutoff=cutoff, **kw).where(~F.col("_old")).drop("_key", "_old")


def recency_counts(df: DataFrame, cutoff: Column, **kw) -> DataFrame:
    return mark_events(df, cutoff=cutoff, **kw).agg(
        F.count(F.lit(1)).alias("read"), F.count_if("_old").alias("collapsed")
    )


def dedup_events(
    df: DataFrame,
    order: str = "ord",
    keymap=rules.EVENT_KEYS,
    always: Sequence[int] = rules.ALWAYS_EMIT_EVENTS,
    cutoff: Column | None = None,
) -> DataFrame:
    """Collapse repeated events.

    ``df`` has ``id``, ``time`` and the source order ``ord``. Events with a key
    become one ``event_summary`` row per key: count, first and last time, and the
    other fields of the first row in source order. Always-emit and keyless events
    pass as ``event`` rows with count 1. Repeats are combined before the shuffle,
    so a hot key costs one row per map task.
    """
    marked = mark_events(df, keymap, always, cutoff).where(~F.col("_old")).drop("_old")
    rest = [c for c in df.columns if c not in ("time", order)]
    groups = (
        marked.where(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.min("time").alias("first"),
            F.max("time").alias("last"),
            F.min(order).alias(order),
            F.min_by(F.struct(*rest), order).alias("_row"),
        )
        .select(
            F.lit("event_summary").alias("kind"),
            *[F.col("_row")[c].alias(c) for c in rest],
            "count", "first", "last", order,
        )
    )
    verbatim = marked.where(F.col("_key").isNull()).select(
        F.lit("event").alias("kind"), *rest, F.lit(1).cast("bigint").alias("count"),
        F.col("time").alias("first"), F.col("time").alias("last"), order,
    )
    return verbatim.unionByName(groups)


def presentation_order(summary: DataFrame, order: str = "ord") -> DataFrame:
    """Verbatim rows first in source order, then groups by count, ties in first-seen order."""
    summarised = F.col("kind") == "event_summary"
    return summary.orderBy(
        summarised, F.when(summarised, -F.col("count")).otherwise(F.lit(0)), order
    )
