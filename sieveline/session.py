"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may name none (tests): it gets a temporary one, while
    elsewhere executors would not see the driver's folder."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='sieveline-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path, with its scheme, in the folder that driver and executors share."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_shared(spark)}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub("^file:/(?!/)", "file:///", fs.makeQualified(path).toString())


def checkpoint(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan with fewer partitions than cores, which is a small one, dealt anew by key; one of more is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def local_session(cores: int | str = "*", shuffle: int = 8, **conf) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", shuffle).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
