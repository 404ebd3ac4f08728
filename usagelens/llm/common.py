"""Helpers that several training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, else one of our own.

    Where the setting is missing, a local session gets one temporary folder for its whole life
    and a cluster the warehouse, which its machines share.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    made = getattr(spark, "_usagelens_shared", None)
    if made is None:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            made = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        else:
            made = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
        spark._usagelens_shared = made
    return made


_WRITTEN: list[str] = []


def deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """On leaving, deletes the tables that `materialize` has written within, but for those put in the list."""
    begin, kept = len(_WRITTEN), []
    yield kept
    stay = {getattr(df, "_usagelens_path", None) for df in kept}
    for path in _WRITTEN[begin:]:
        if path not in stay:
            deleted(spark, path)
    _WRITTEN[begin:] = [p for p in _WRITTEN[begin:] if p in stay]


def materialize(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write `df` into the shared folder and read it back: its lineage ends in that table.

    The table of `replaces`, an earlier result that nothing reads any more, is deleted then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    old = getattr(replaces, "_usagelens_path", None)
    if old is not None:
        deleted(spark, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._usagelens_path = path
    return out


#: Parts of a key's rows that may lie in different tasks: four masks of 64 bits.
SALTS = 256


def with_shared(rows: DataFrame, key: list[str], by: Column, shared: dict[str, Column], where: str = "true") -> DataFrame:
    """`rows` with aggregates over all rows of their key, without all rows of a key in one task.

    The aggregation (partial first) also notes which salts, by the hash of `by`, a key's rows
    have; each row then meets the copy for its own salt. `where` is a condition on the
    aggregates. Key columns must not be null.
    """
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    bit = lambda i: F.when(F.expr(f"_s div 64 = {i}"), F.expr("shiftleft(1L, _s % 64)")).otherwise(F.lit(0).cast("long"))
    masks = [F.bit_or(bit(i)).alias(f"_b{i}") for i in range(SALTS // 64)]
    total = salted.groupBy(*key).agg(*[c.alias(n) for n, c in shared.items()], *masks).where(where)
    there = " WHEN ".join(f"{i} THEN getbit(_b{i}, s % 64)" for i in range(SALTS // 64))
    salts = F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> CASE s div 64 WHEN {there} END = 1)"))
    return salted.join(total.select(*key, *shared, salts.alias("_s")), [*key, "_s"]).drop("_s")


def looked_up(rows: DataFrame, held: DataFrame, key: str, by: Column, most: int = 64) -> DataFrame:
    """Inner join of `rows` with `held`, unique by `key`, where some keys may have very many rows.

    The rows of a key with more than `most` are dealt to several tasks, each with a copy of what is held.
    """
    counted = with_shared(rows, [key], by, {"_c": F.count("*")})
    dealt = counted.withColumn("_p", F.pmod(F.xxhash64(by), F.ceil(F.col("_c") / most)).cast("int")).drop("_c")
    copies = dealt.select(key, "_p").distinct().join(held, key)
    return dealt.join(copies, [key, "_p"]).drop("_p")


def root_of(n: int) -> int:
    """Buckets for n rows, so that buckets and rows per bucket grow alike."""
    return max(1, math.isqrt(max(0, n - 1)) + 1)


def with_offsets(
    df: DataFrame, group: list[str], order: list[str], weight: Column, out: str, buckets: int
) -> DataFrame:
    """Add `out`: the sum of `weight` over the rows of the same group that come before.

    The order within a group is (hash bucket, order columns). Sums per bucket are taken first
    and carried on over the buckets, so no window holds more than a bucket's rows however large
    a group is. Rows that tie in all order columns take any order. `group` must not be null.
    """
    hashed = df.withColumn("_w", weight).withColumn(
        "_b", F.pmod(F.xxhash64(*order, F.lit(7)), F.lit(buckets)).cast("int")
    )
    keys = [*group, "_b"]
    over = lambda part, by: Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        hashed.groupBy(*keys)
        .agg(F.sum("_w").alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(over(group, ["_b"])), F.lit(0)))
        .drop("_sum")
    )
    inner = hashed.withColumn("_in", F.coalesce(F.sum("_w").over(over(keys, order)), F.lit(0)))
    return inner.join(bases, keys).withColumn(out, (F.col("_base") + F.col("_in")).cast("long")).drop(
        "_w", "_b", "_base", "_in"
    )
