"""Residency: through how many requests each block stayed in the context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resident(blocks: DataFrame, requests: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Add `requests`: the session's requests after the block and before its end.

    A block ends at the next boundary, thinking also at the next human text. Everything is put
    on one time line per session; running counts at both ends give the number, without a join
    of blocks and requests.
    """
    b = blocks.select("session_id", "ts_us", F.lit("b").alias("row"), F.struct(*blocks.columns).alias("block"), (F.col("kind") == "user_text").alias("human"))
    none = F.lit(None).cast(b.schema["block"].dataType)
    other = lambda df, row: df.select("session_id", "ts_us", F.lit(row).alias("row"), none.alias("block"), F.lit(False).alias("human"))
    line = b.unionByName(other(requests, "r")).unionByName(other(boundaries, "c"))
    by = Window.partitionBy("session_id").orderBy("ts_us")
    # what comes later goes before in falling order: a frame that grows, taken in one pass
    after = Window.partitionBy("session_id").orderBy(F.desc("ts_us")).rangeBetween(Window.unboundedPreceding, -1)
    upto = by.rangeBetween(Window.unboundedPreceding, 0)
    before = by.rangeBetween(Window.unboundedPreceding, -1)
    is_request = (F.col("row") == "r").cast("long")
    end = F.when(F.col("row") == "c", F.struct("ts_us", F.coalesce(F.sum(is_request).over(before), F.lit(0)).alias("n")))
    human = F.when(F.col("human"), F.struct("ts_us", F.coalesce(F.sum(is_request).over(before), F.lit(0)).alias("n")))
    line = line.select("*", F.sum(is_request).over(upto).alias("seen"), end.alias("end"), human.alias("text_end"))
    line = line.select(
        "*", F.min("end").over(after).alias("next_end"), F.min("text_end").over(after).alias("next_text"),
        F.sum(is_request).over(Window.partitionBy("session_id")).alias("all"),
    ).where("row = 'b'")
    thinking = F.col("block.kind") == "thinking"
    stop = F.when(thinking, F.least("next_end", "next_text")).otherwise(F.col("next_end"))
    n = F.greatest(F.lit(0), F.coalesce(stop["n"], F.col("all")) - F.col("seen"))
    return line.select("block.*", n.alias("requests")).withColumn("resident_tokens", F.col("requests") * F.col("est_tokens"))


def rollup(items: DataFrame, by: str) -> DataFrame:
    rows = items if by == "kind" else items.where(F.col(by) != "")
    return rows.groupBy(F.col(by).alias("key")).agg(
        F.count("*").alias("blocks"), F.sum("est_tokens").alias("flow"), F.sum("resident_tokens").alias("resident"),
        F.try_divide(F.sum("resident_tokens"), F.sum("est_tokens")).alias("mean_requests"),
    )


def origin() -> Column:
    named = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.coalesce(named("file_path"), named("tool"), named("mcp_server"), F.lit(""))


def top(items: DataFrame, limit: int = 15) -> DataFrame:
    rows = items.orderBy(F.desc("resident_tokens"), "block_id").limit(limit)
    return rows.select("block_id", "session_id", "kind", origin().alias("origin"), "est_tokens", "requests", "resident_tokens")


def stale(items: DataFrame, limit: int = 15) -> DataFrame:
    return top(items.where((F.col("kind") == "tool_result") & (F.col("referenced") == 2)), limit)


def stale_share(items: DataFrame) -> DataFrame:
    judged = items.where((F.col("kind") == "tool_result") & (F.col("referenced") != 0))
    return judged.agg(
        F.coalesce(F.sum("resident_tokens"), F.lit(0)).alias("known"),
        F.coalesce(F.sum(F.when(F.col("referenced") == 2, F.col("resident_tokens"))), F.lit(0)).alias("unreferenced"),
    )


def coverage(items: DataFrame, requests: DataFrame) -> DataFrame:
    metered = requests.agg(F.sum(F.col("input_tokens") + F.col("cache_read") + F.col("cache_write")).alias("metered"))
    extracted = items.agg(F.sum("resident_tokens").alias("resident"))
    return extracted.withColumn("_k", F.lit(1)).join(metered.withColumn("_k", F.lit(1)), "_k").drop("_k")
