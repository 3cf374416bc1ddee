"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("netweave")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.metricsEnabled", "false")
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_utc(spark: SparkSession) -> None:
    """Event times are UTC; a session in another zone would shift them."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


#: The folder of each local session that names none; removed when Python ends.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session that names none gets a folder of its own. The session's settings
    stay as they are.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="netweave-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return _LOCAL[app]


def work_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return os.path.join(shared_dir(spark), f"{purpose}-{uuid.uuid4().hex}")


def written(df, purpose: str):
    """Write ``df`` once to the shared folder; the frame that reads the files, and their path."""
    spark = df.sparkSession
    path = work_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def pinned(df, purpose: str):
    """Write ``df`` once to the shared folder and go on from the files."""
    return written(df, purpose)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove files of ``written`` that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Let the driver collect what is finished, so that shuffle files no longer needed go at once."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_KNOWN: dict[tuple, object] = {}


def remembered(spark: SparkSession, folder: str, table: str, purpose: str, find):
    """What ``find()`` learns of one table, kept once per session and state of the table.

    For a few numbers, a model or the place of a small table. The state is the table's size
    and time of change, so that of a table written anew all is learned anew.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, folder, table, purpose, status.getLen(), status.getModificationTime())
    if key not in _KNOWN:
        _KNOWN[key] = find()
    return _KNOWN[key]


def prepared(spark: SparkSession, folder: str, table: str, purpose: str, build):
    """What ``build()`` makes of one table, written once per session and state of the table."""
    def write():
        df = build()
        place = work_path(spark, purpose)
        df.write.parquet(place)
        return place, df.schema

    place, schema = remembered(spark, folder, table, purpose, write)
    return spark.read.schema(schema).parquet(place)
