"""Helpers the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, made ready for checkpoints.

    Only a local session without that setting, as in tests, gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
            "spark.checkpoint.dir", None
        )
        if folder is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
            folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows no classifier learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# edges of a task: the rounds of a small graph are not dealt to more tasks than it needs
EDGES = 100_000


def components(links: DataFrame) -> DataFrame:
    """Connected components of the undirected graph ``links(a, b)``.

    Returns ``(v, root)`` for every vertex that has a link; the root is the smallest
    vertex of the component. Alternates large-star and small-star steps, each one
    aggregate with map-side combine and one join, until the edges stand still.
    Null ends and self links are ignored.
    """
    edges = cut(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    before, n = None, edges.count()
    while True:
        # a round adds no more edges than vertices; its tasks leave files until the driver frees them
        few = lambda df, tasks=n // EDGES + 1: df.coalesce(tasks)
        edges = few(edges)
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        lowest = lowest.withColumn("m", F.least("u", "m"))
        # large star: every larger neighbour goes to the smallest vertex around u
        edges = few(
            both.where(F.col("v") > F.col("u"))
            .join(lowest, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # small star: u and its smaller neighbours go to the smallest of them
        lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(lowest, "u")
        edges = cut(
            few(
                small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                .union(small.select("u", F.col("m").alias("v")))
                .where(F.col("u") != F.col("v"))
                .distinct()
            )
        )
        seen = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"),
        ).first()
        if seen == before or not seen["n"]:
            break
        before, n = seen, seen["n"]
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).union(
        edges.select(F.col("v"), F.col("v").alias("root")).distinct()
    )
