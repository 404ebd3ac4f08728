"""Files as a source: which ones changed, and their lines with path and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def states(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Path, size and time of each file below `path`; contents stay unread."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime_us"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new or whose size or time differs from the manifest."""
    return now.join(before, ["path", "size", "mtime_us"], "left_anti")


def changed_rows(now: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, size, updated) of a table source that are new or differ; payloads join these afterwards."""
    return now.join(before, [*key, "size", "updated"], "left_anti")
