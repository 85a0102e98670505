"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the cluster names none, as in local tests, is a folder of this
    machine taken; it is used with a local master alone.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _forget() -> None:
    for spark, path in _kept:
        try:
            delete_folder(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended
            return


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it cuts the
    lineage, outlives executors, and is computed once. Removed as the driver ends,
    or before by ``drop_written``. With ``free`` the shuffle files behind it go as soon as it is written."""
    spark = df.sparkSession
    if not _kept:
        atexit.register(_forget)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if free else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _kept.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes written tables that nothing lazy reads any more."""
    for table in tables:
        folders = {f.rsplit("/", 1)[0].partition(":")[2].lstrip("/") for f in table.inputFiles()}
        for entry in [e for e in _kept if e[1].partition(":")[2].lstrip("/") in folders]:
            delete_folder(*entry)
            _kept.remove(entry)
