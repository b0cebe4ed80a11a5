"""Session defaults for local runs and tests; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


#: The JVM never compiles a method of more than 8 kB of bytecode, but runs it interpreted; Spark's own default is 65535.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def limit_methods(spark: SparkSession) -> None:
    """A stage whose generated method is too long to be compiled runs its operators' own, shorter ones.  A limit that the
    session was given stays."""
    if spark.conf.get(METHOD_LIMIT) == "65535":
        spark.conf.set(METHOD_LIMIT, "8000")


def local_session(name: str = "duelgrid", cores: str | int = "*", shuffle: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # the JVM does not compile methods above 8 kB; split wide expressions instead of interpreting them
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DUELGRID_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the cluster's setting first, a scratch folder only in local runs."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="duelgrid-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()
