"""Keyed merges: which of several versions of a row, or of its columns, stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`."""
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", number).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, key: list[str], order: list[str], first: tuple[str, ...] = ()) -> DataFrame:
    """The last version of each key; columns in `first` keep their first value. One partial aggregation."""
    rest = [c for c in rows.columns if c not in (*key, *first)]
    by = F.struct(*order)
    got = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_l"), *[F.min_by(c, by).alias(c) for c in first])
    return got.select(*[F.col("_l")[c].alias(c) if c in rest else F.col(c) for c in rows.columns])


def merge_blocks(rows: DataFrame) -> DataFrame:
    """Block versions (key, seq, ...): sizes last, owner first, verdict 1 before 2 before 0, earliest reference."""
    some = lambda v: F.max(F.when(F.col("referenced") == v, 1).otherwise(0)) == 1
    return rows.groupBy("key").agg(
        F.min_by("session_id", "seq").alias("session_id"), F.max_by("byte_len", "seq").alias("byte_len"),
        F.max_by("content_hash", "seq").alias("content_hash"), F.when(some(1), 1).when(some(2), 2).otherwise(0).alias("referenced"),
        F.min("first_ref_us").alias("first_ref_us"),
    )


def merge_sessions(rows: DataFrame) -> DataFrame:
    """Session versions (session_id, seq, title, slug, started_us, ended_us): last text that says something, widest span."""
    said = lambda c: F.coalesce(F.max_by(F.nullif(F.col(c), F.lit("")), F.when(F.col(c) != "", F.col("seq"))), F.lit("")).alias(c)
    return rows.groupBy("session_id").agg(
        said("title"), said("slug"), F.min("started_us").alias("started_us"), F.max("ended_us").alias("ended_us")
    )


def series_latest(rows: DataFrame) -> DataFrame:
    """The value with the latest time of each series; an older export that comes late changes nothing."""
    return rows.groupBy("series").agg(F.max_by("value", F.struct("ts_us", "seq")).alias("value"), F.max("ts_us").alias("ts_us"))


def attribute_results(blocks: DataFrame) -> DataFrame:
    """Each tool_result with the tool of the latest tool_use of its id before it in its file."""
    upto = Window.partitionBy("file_id", "tool_use_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    use = F.when(F.col("kind") == "tool_use", F.struct("block_id", "tool"))
    rows = blocks.where("kind IN ('tool_use', 'tool_result')").withColumn("_u", F.last(use, ignorenulls=True).over(upto)).where(F.col("kind") == "tool_result")
    return rows.select("block_id", "file_id", F.col("_u.block_id").alias("use_id"), F.coalesce("_u.tool", F.lit("")).alias("used_tool"))


def merge_sources(rows: DataFrame) -> DataFrame:
    """Source versions (kind, root, seq, regime): the last regime of each."""
    return last_wins(rows, ["kind", "root"], ["seq"])


def union_of_eras(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of two storage eras, one version of each key: the later one by `order`, the new era's of equal ones."""
    both = old.withColumn("_era", F.lit(0)).unionByName(new.withColumn("_era", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, key, [*order, "_era"]).drop("_era")


def absorbed(table: DataFrame | None, rows: DataFrame, key: list[str], order: list[str], last: bool = True, seen: Observation | None = None) -> DataFrame:
    """`table` with `rows` merged in: the last version of each key, or with `last` false the one that is there already, else the first.

    Of the rows of a key that is new, one is new; all others are repetitions (updates, if the last
    version wins, else duplicates). `seen` gets both numbers from the write of the result itself,
    no pass is made for them.
    """
    both = rows.withColumn("_in", F.lit(1))
    if table is not None:
        both = table.withColumn("_in", F.lit(0)).unionByName(both)
    columns = [c for c in rows.columns if c not in key]
    by = F.struct("_in", *order)
    pick = F.max_by if last else F.min_by
    merged = both.groupBy(*key).agg(pick(F.struct(*columns), by).alias("_l"), F.sum("_in").alias("_n"), F.min("_in").alias("_new"))
    merged = merged.select(*key, "_l.*", F.col("_new").cast("long").alias("_new"), (F.col("_n") - F.col("_new")).alias("_again")).select(*rows.columns, "_new", "_again")
    if seen is not None:
        merged = merged.observe(seen, F.coalesce(F.sum("_new"), F.lit(0)).alias("new"), F.coalesce(F.sum("_again"), F.lit(0)).alias("repeated"))
    return merged


def counted(merged: DataFrame, kind: str) -> DataFrame:
    """The numbers of `absorbed` as a row: kind, rows now, new and repeated ones."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return merged.agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), total("_new", "new"), total("_again", "repeated"))
