"""Statement analysis over arriving files, by Structured Streaming: the batch column functions applied as they are.

An extension: the batch engine has no streams of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.functions import text as T
from tributary.sources.files import stem


def read_statements(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(file, pos, stmt) of .sql files as they arrive in a folder."""
    scripts = spark.readStream.option("wholetext", True).option("pathGlobFilter", "*.sql").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    named = scripts.select(stem(F.input_file_name()).alias("file"), F.col("value").alias("script"))
    return named.select("file", F.posexplode(T.split_statements(F.col("script"))).alias("pos", "stmt"))


def classify(statements: DataFrame) -> DataFrame:
    """Kind, target and sources of each statement; stateless, so nothing grows with the stream."""
    sig = T.signature(F.col("stmt"))
    return statements.select("file", "pos", T.statement_kind(F.col("stmt")).alias("kind"), sig["target"].alias("target"), sig["sources"].alias("sources"))


def write(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet, exactly once by the checkpoint."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
