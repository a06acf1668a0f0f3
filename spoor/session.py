"""Session settings used by the bench and the tests, and durable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = 8, app: str = "spoor") -> SparkSession:
    """A ``local[n]`` session; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.openCostInBytes", "1048576")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, so the
    cut survives the loss of executors. A folder of our own is made only on a
    local master, where the machine's disk is the shared disk.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spoor-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
