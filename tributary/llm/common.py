"""Helpers of the training-data operators: shared scratch tables, hashing keys, batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that deletes a query's shuffle files at its end; else they stay until the driver collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a private one only where it is unset and one machine runs everything."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL_ROOTS.get(spark.sparkContext.applicationId)
        if root is None:
            root = _LOCAL_ROOTS[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tributary-")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; removed when the driver ends."""
    path = f"{scratch_root(spark)}/tributary-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have gone before the interpreter ends
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, not a recomputation.
    An empty frame keeps its schema. `release` deletes the table early. The shuffle
    files of the job go when it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before) if before is not None else spark.conf.unset(DROP_SHUFFLES)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_table = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that `materialize` returned and that nothing will read again."""
    for table in tables:
        _remove(table.sparkSession, table.scratch_table)


def parts_by_bytes(texts: Iterable[str | None], limit: int) -> Iterator[list[str]]:
    """Parts of at most about `limit` characters (one text at least); null becomes empty."""
    part: list[str] = []
    held = 0
    for text in texts:
        text = text or ""
        if part and held + len(text) > limit:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def crc_bucket(id_col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo `modulus`; a null id gives 0's text, the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def join_weighted(many: DataFrame, one: DataFrame, keys: list[str], weight: str, share: int = 1024) -> DataFrame:
    """Inner join of many with one, unique on keys (no nulls), whose `weight` says how many rows of many have the key.

    Keys that hold 1/share of all rows or more, of which there are at most `share`, are
    broadcast; only the others are shuffled, so no task gets much more than its part.
    """
    total = one.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * share >= total
    frequent = F.broadcast(one.where(hot).drop(weight))
    rare = many.join(F.broadcast(one.where(hot).select(*keys)), keys, "left_anti")
    return many.join(frequent, keys).unionByName(rare.join(one.where(~hot).drop(weight), keys))
