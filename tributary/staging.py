"""Written intermediate tables: they cut a plan, are computed once, and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a private one only where it is unset and one machine runs everything."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not folder:
            folder = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tributary-")
    return folder.rstrip("/")


def staged_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; what is written there is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/tributary-{label}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back; deleted when the driver ends, or by `drop_staged`."""
    spark, path = df.sparkSession, staged_path(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete tables of `staged` that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table.staged_path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have gone before the interpreter ends
        pass
