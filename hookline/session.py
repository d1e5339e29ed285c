"""Session helpers.

The library never creates machine-local scratch space on a cluster: lineage is
cut with ``DataFrame.checkpoint()`` into ``spark.checkpoint.dir`` as named by
the cluster.  Only when the setting is absent (tests, local runs) do we set our
own directory.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(cpus: int | str = "*", app: str = "hookline", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench (the cluster supplies its own)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.  Unset, a local one is made for a local
    master; on a cluster it is an error, since executors share no local folder."""
    conf = spark.sparkContext.getConf()
    current = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        jdir = spark.sparkContext._jsc.getCheckpointDir()
        if jdir.isPresent():
            return jdir.get()
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="hookline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def parallelism(spark: SparkSession) -> int:
    """Partitions for CPU-heavy stages: the shuffle partition setting, at
    least the number of task slots."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Used where two branches must see the same partition assignment (a range
    partitioning samples its bounds per exchange, so ``spark_partition_id``
    is only stable within one materialisation), and to cut long lineages."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
