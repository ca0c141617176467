"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, memory: str = "8g", shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    # Python workers import the package whatever folder the process started in
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])
    builder = SparkSession.builder.master(f"local[{cores}]").appName("adlens")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = (
        builder.config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there. Only where it is unset and the session
    is local (tests, bench) a temporary folder is used; on a cluster a missing
    setting is an error, because a machine-local folder dies with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="adlens-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write a table next to the checkpoints and read it back.

    Unlike a checkpoint it is columnar, so later steps read only the columns and row
    groups they need; like a checkpoint it survives the loss of executors.
    ``compression`` is that of the session if not given.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
