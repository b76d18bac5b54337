"""Tables staged under the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_staged: set[tuple[str, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of its own only in local mode without that setting."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own_dirs.get(sc.applicationId) or tempfile.mkdtemp(prefix="stepwell-")
        _own_dirs[sc.applicationId] = named
    base = f"{named.rstrip('/')}/stepwell-{sc.applicationId}"
    if not _staged:
        atexit.register(_clean)
    return base


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for app, base in _staged:
        with contextlib.suppress(Exception):
            if spark is not None and spark.sparkContext.applicationId == app:
                _delete(spark, base)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    base = shared_dir(spark)
    _staged.add((spark.sparkContext.applicationId, base))
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_staged_at", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more, before the disk fills."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
