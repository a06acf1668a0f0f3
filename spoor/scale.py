"""Building blocks that keep plans sound when one group holds much of the data.

A plain ``row_number() over (partition by g order by o)`` sends a whole group
to one task. The helpers here first cut every group into buckets that follow
the wanted order, count per bucket (with map-side combine), and number inside
the buckets only. The result is the same number; no task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Rows and bytes up to which a side may be sent to every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
# Rows of a task whose number of groups grows with its rows.
TASK_ROWS = 500_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` is proven to be small: one aggregate with map-side combine."""
    wide = F.lit(0)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            wide = wide + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            wide = wide + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
        else:
            wide = wide + 8
    measured = df.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(wide), F.lit(0)).alias("b")
    ).first()
    return measured["n"] <= rows and measured["b"] <= size


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is proven small, else unchanged (shuffle join)."""
    return F.broadcast(df) if fits(df, rows, size) else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly if it is small: no more partitions than cores.

    A file with one large row group is read by one task however many splits it has; work that
    is dear per row then waits for one core. Larger tables are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """So many tasks that each has about ``rows`` of the rows of ``df``, and every core has one.

    Shuffled rows that pack well are otherwise gathered by their packed bytes, and one task
    then holds many millions of groups.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-df.count() // rows))


def _with_bucket(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of the one-row-per-bucket ``side``; null keys match null keys."""
    named = side.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in side.columns if c not in keys]
    )
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(named[f"_key_{k}"])
    return df.join(named, same).drop(*[f"_key_{k}" for k in keys])


def ordinal(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    name: str = "ordinal",
) -> DataFrame:
    """1-based position of each row inside its group.

    ``bucket`` must not decrease along ``order``; it decides how finely a group
    is split. Null groups and buckets are groups and buckets of their own.
    """
    keys = [*group, "_bucket"]
    cut = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        cut.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        _with_bucket(cut.withColumn("_pos", F.row_number().over(inside)), starts, keys)
        .withColumn(name, F.col("_start") + F.col("_pos"))
        .drop("_bucket", "_pos", "_start")
    )


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    value: str,
    name: str = "running",
) -> DataFrame:
    """Inclusive running total of ``value`` inside each group, split the same way."""
    keys = [*group, "_bucket"]
    cut = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        cut.groupBy(*keys)
        .agg(F.sum(value).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _with_bucket(cut.withColumn("_sum", F.sum(value).over(inside)), starts, keys)
        .withColumn(name, F.col("_start") + F.col("_sum"))
        .drop("_bucket", "_sum", "_start")
    )


def capped_rank(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    cap: int,
    spread: Column,
    name: str = "rank",
    ways: int = 32,
) -> DataFrame:
    """The first ``cap`` rows of each group with their rank.

    Two rounds: the best ``cap`` of each of ``ways`` slices of a group, then the
    best ``cap`` of those survivors. Both rounds are planned with a group limit
    before the exchange, so a hot group moves at most ``ways * cap`` rows to the
    final task.
    """
    salted = df.withColumn("_slice", F.pmod(F.hash(spread), F.lit(ways)))
    first = Window.partitionBy(*group, "_slice").orderBy(*order)
    last = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= cap)
        .drop("_r", "_slice")
        .withColumn(name, F.row_number().over(last))
        .where(F.col(name) <= cap)
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The first row of each key in source order, found with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
        .select(*df.columns)
    )


def last_before(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: Column,
    right_ts: Column,
    within: int,
    name: str = "previous",
) -> DataFrame:
    """As-of join: for each left row the latest right time in ``[t - within, t]``.

    Times are epoch seconds. A key is cut into stretches of ``within`` seconds;
    only one carried row per stretch crosses into the next, so neither a hot key
    nor pairs of a key ever meet in one task.
    """
    marks = right.select(*by, right_ts.cast("double").alias("_t"))
    marks = marks.withColumn("_stretch", F.floor(F.col("_t") / within))
    carried = (
        marks.groupBy(*by, "_stretch")
        .agg(F.max("_t").alias("_t"))
        .withColumn("_stretch", F.col("_stretch") + 1)
    )
    rows = left.withColumn("_t", left_ts.cast("double")).withColumn(
        "_stretch", F.floor(F.col("_t") / within)
    )
    both = rows.withColumn("_mark", F.lit(None).cast("double")).unionByName(
        marks.unionByName(carried).withColumn("_mark", F.col("_t")), allowMissingColumns=True
    )
    seen = Window.partitionBy(*by, "_stretch").orderBy(
        "_t", F.col("_mark").isNull()
    ).rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("_seen", F.max("_mark").over(seen))
        .where(F.col("_mark").isNull())
        .withColumn(name, F.when(F.col("_seen") >= F.col("_t") - within, F.col("_seen")))
        .drop("_t", "_mark", "_stretch", "_seen")
    )


def lagged(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    value: Column,
    name: str = "previous",
) -> DataFrame:
    """``value`` of the row before in each group, by the same bucket cut.

    The first row of a bucket takes the last value of the bucket before it, which
    comes from one pre-aggregated row per bucket.
    """
    keys = [*group, "_bucket"]
    cut = df.withColumns({"_bucket": bucket, "_v": value})
    by_bucket = Window.partitionBy(*group).orderBy("_bucket")
    carry = (
        cut.groupBy(*keys)
        .agg(F.max_by("_v", F.struct(*order)).alias("_last"))
        .select(*keys, F.lag("_last").over(by_bucket).alias("_carry"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    marked = cut.withColumns(
        {"_in": F.lag("_v").over(inside), "_first": F.row_number().over(inside) == 1}
    )
    return (
        _with_bucket(marked, carry, keys)
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_in")))
        .drop("_bucket", "_v", "_in", "_first", "_carry")
    )
