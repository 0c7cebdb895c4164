"""Session helpers: building a local session, and tables that cut lineage.

Intermediate tables that are read more than once are written as Parquet below the
folder the cluster names in ``spark.checkpoint.dir`` (every executor shares it), so
a lost executor never loses them.  Only where that setting is absent, as in unit
tests on one machine, a folder of our own is used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WRITTEN: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A ``local[cpus]`` session for tests and the bench."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sangam")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` if set, else one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="sangam-"))
            atexit.register(shutil.rmtree, _OWN[0], True)
        return "file://" + _OWN[0]
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once below :func:`shared_dir` and return a scan of the written table.

    The write's shuffle files are let go as soon as it has ended, not when the driver collects garbage.
    What is not given to :func:`drop` before is deleted when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sangam-{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clean)
    _WRITTEN[path] = spark
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._sangam_path = path
    return out


def _delete(path: str, spark: SparkSession) -> None:
    local = path.removeprefix("file://")
    if local.startswith("/"):
        shutil.rmtree(local, True)
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(df: DataFrame) -> None:
    """Delete a table :func:`materialise` wrote that nothing reads any more; other frames are left alone."""
    path = getattr(df, "_sangam_path", None)
    if path in _WRITTEN:
        _delete(path, _WRITTEN.pop(path))


def _clean() -> None:
    for path, spark in list(_WRITTEN.items()):
        try:
            _delete(path, spark)
        except Exception:  # the session is gone: a remote folder is left to its owner
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
