"""Session settings and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "newsloom", master: str | None = None, **extra) -> SparkSession:
    """A session with the settings the operators assume; the cluster's own settings win for sizing."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**CONF, **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the cluster's spark.checkpoint.dir, else a new one for local runs."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    root = spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so a lost executor costs no recomputation chain."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def cut_afresh(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for loops of joins: written as a table in the shared folder and read again.

    A checkpoint keeps the size estimate of the plan it cuts, and a join's estimate is the product of its sides: over rounds
    the number itself grows until planning stops. A table is measured by its files, so later joins are planned well.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_root(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
