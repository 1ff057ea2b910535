"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Read by every job here; the sizes are for executors with a few GB and can be overridden by the caller.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.parquet.filterPushdown": "true",
    # Small files are split over the cores, too; the default takes 4 MB for the least that is worth a task.
    "spark.sql.files.openCostInBytes": "262144",
    "spark.ui.enabled": "false",
}


def local_session(app: str = "leafmill", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    own = tempfile.mkdtemp(prefix="leafmill-")  # one machine: its own folder is the shared one, and goes with the process
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.checkpoint.dir": f"file://{own}"}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Only a local session without one gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("leafmill.shared.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("leafmill.shared.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df once as a table in the shared folder and read it back.

    Lineage is cut, the rows survive the loss of any executor, and later reads prune columns. Nothing is kept in executors.
    The folder belongs to the session: whoever names spark.checkpoint.dir also clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cores_of(spark: SparkSession) -> int:
    return int(spark.sparkContext.defaultParallelism or os.cpu_count() or 1)
