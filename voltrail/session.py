"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}


def build_session(app: str = "voltrail", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults every job here relies on (UTC, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables.

    On a cluster it is the one named by ``spark.checkpoint.dir``; a local session
    without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = context._conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="voltrail-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write rows to a new table in the shared folder and read them back.

    For results that later steps use more than once: they are computed once, survive the loss
    of executors, and their true size is known when the next joins are planned.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), name: str = "stage", buckets: int | None = None) -> DataFrame:
    """Like :func:`stage`, with the rows dealt into buckets by ``keys`` and sorted by keys and ``order`` within them.

    Joins, groups and windows over the keys read such a table without a shuffle, and tables with equal buckets are
    merged bucket by bucket. The table is external, in the shared folder, under a name never used before.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = "voltrail_" + path.rsplit("/", 1)[-1].replace("-", "_")
    dealt = df.repartition(buckets, *keys)  # one file a bucket
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys, *order).option("path", path).saveAsTable(table)
    return spark.table(table)
