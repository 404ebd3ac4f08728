"""Keyed tables as a sink, in snapshots: a write is one new version of the table, or none.

    <path>/data/<write>/_p=<partition>/*.parquet    rows of the partitions that a write touched
    <path>/versions/<number>.json                   which folders make up the table

A version is committed by one rename that doesn't replace, so of two writers based on the same
version one is refused. Readers resolve the latest version: they see all of a write or nothing of it,
also if it dies halfway. Partitions keep the type of their column, as it is in the files, too.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from usagelens.operators.merge import last_wins


class Conflict(Exception):
    """The version that a write was based on isn't the latest any more."""


class Folder:
    """A table's folder in whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self.place("").getFileSystem(self.conf)

    def place(self, below: str):
        return self.jvm.Path(f"{self.path}/{below}" if below else self.path)

    def names(self, below: str) -> list[str]:
        place = self.place(below)
        return sorted(s.getPath().getName() for s in self.files.listStatus(place)) if self.files.exists(place) else []

    def text(self, below: str) -> str:
        stream = self.files.open(self.place(below))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def commit(self, below: str, text: str) -> bool:
        """Puts a new file in place by one rename; False if there is one already."""
        beside = f"versions/.{uuid.uuid4().hex}"
        stream = self.files.create(self.place(beside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            self.jvm.FileContext.getFileContext(self.files.getUri(), self.conf).rename(self.place(beside), self.place(below), none)
        except Py4JJavaError as failed:
            self.files.delete(self.place(beside), False)
            if "FileAlreadyExists" in str(failed.java_exception):
                return False
            raise
        return True

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.names("versions") if n[:-5].isdigit() and n.endswith(".json")]

    def manifest(self, version: int) -> dict:
        """schema, and by partition the folder with its rows."""
        return json.loads(self.text(f"versions/{version:012d}.json")) if version else {"schema": None, "parts": {}}


def version(spark: SparkSession, path: str) -> int:
    """The latest version of a table; 0 if there is none."""
    return max(Folder(spark, path).versions(), default=0)


def read(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """A table as of a version, the latest one if not said otherwise."""
    folder = Folder(spark, path)
    at = max(folder.versions(), default=0) if at is None else at
    if not at:
        raise FileNotFoundError(f"no table at {path}")
    return _rows(folder, folder.manifest(at))


def _rows(folder: Folder, manifest: dict, parts: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    paths = [f"{folder.path}/{p}" for name, p in sorted(manifest["parts"].items()) if parts is None or name in parts]
    return folder.spark.read.schema(schema).parquet(*paths) if paths else folder.spark.createDataFrame([], schema)


def upsert(rows: DataFrame, path: str, key: list[str], order: list[str], partition: str, first: tuple[str, ...] = (), based_on: int | None = None) -> int:
    """Merge `rows` into the table at `path`, partitioned by `partition`: the last version of each key stays. Returns the new version.

    A key keeps its partition. Only partitions that `rows` touch are read and written; there are as
    many names of them on the driver as the manifest lists anyway. The same rows again change nothing.
    With `based_on`, the write is refused (Conflict) unless that is still the latest version.
    """
    spark, folder = rows.sparkSession, Folder(rows.sparkSession, path)
    now = max(folder.versions(), default=0)
    if based_on is not None and based_on != now:
        raise Conflict(f"{path} is at version {now}, not {based_on}")
    manifest = folder.manifest(now)
    name = F.substring(F.sha2(F.coalesce(F.col(partition).cast("string"), F.lit("\0")), 256), 1, 24)  # of any value, short and plain
    columns = StructType.fromJson(manifest["schema"]).names if now else rows.columns
    if now:
        touched = {r[0] for r in rows.select(name).distinct().collect()}
        rows = _rows(folder, manifest, touched).unionByName(rows.select(*columns))
    merged = last_wins(rows, [partition, *key], order, first).select(*columns)
    write = f"data/{uuid.uuid4().hex}"
    merged.withColumn("_p", name).write.partitionBy("_p").parquet(f"{folder.path}/{write}")
    parts = {n[3:]: f"{write}/{n}" for n in folder.names(write) if n.startswith("_p=")}
    made = {"schema": json.loads(merged.schema.json()), "parts": manifest["parts"] | parts}
    if not folder.commit(f"versions/{now + 1:012d}.json", json.dumps(made)):
        folder.files.delete(folder.place(write), True)
        raise Conflict(f"{path} has another version {now + 1} by now")
    return now + 1


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes all but the latest `keep` versions, and rows that none of these has (those of dead writes, too)."""
    folder = Folder(spark, path)
    versions = sorted(folder.versions())
    kept = {p for v in versions[-keep:] for p in folder.manifest(v)["parts"].values()}
    for v in versions[:-keep]:
        folder.files.delete(folder.place(f"versions/{v:012d}.json"), False)
    for write in folder.names("data"):
        for part in folder.names(f"data/{write}"):
            if f"data/{write}/{part}" not in kept:
                folder.files.delete(folder.place(f"data/{write}/{part}"), True)
        if not folder.names(f"data/{write}"):
            folder.files.delete(folder.place(f"data/{write}"), True)


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, **how):
    """The same for each micro-batch of a stream; a batch that is run again changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        while True:
            try:
                upsert(batch, path, **how)
                return
            except Conflict:  # another writer came first: merge with what it wrote
                continue

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
