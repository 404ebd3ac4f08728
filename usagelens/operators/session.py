"""One session over time: points, buckets, totals, composition, what dominates it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.operators.cache import with_boundary

KINDS = ["user_text", "meta_text", "assistant_text", "thinking", "tool_use", "tool_result", "image"]
BUCKETS = 60
COLUMNS = 72


def prompt() -> Column:
    return F.col("input_tokens") + F.col("cache_read") + F.col("cache_write")


def points(requests: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Requests in order with a flag where a boundary lies between the one before, of any model, and this."""
    by = Window.partitionBy("session_id").orderBy("ts_us", "request_id")
    rows = with_boundary(requests, boundaries).withColumn("prev_us", F.lag("ts_us").over(by))
    flag = F.coalesce(F.col("boundary_us") > F.col("prev_us"), F.col("boundary_us").isNotNull())
    return rows.select(
        "request_id", "session_id", "model", "ts_us", (F.row_number().over(by) - 1).alias("idx"), prompt().alias("prompt_tokens"), flag.alias("compacted")
    )


def block_to_request(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """Each block's request index: the first at or after it, else the session's last; sessions without requests drop out."""
    by = Window.partitionBy("session_id").orderBy("ts_us", "request_id")
    idx = requests.select("session_id", "ts_us", (F.row_number().over(by) - 1).alias("idx"), F.lit(None).cast("long").alias("block_id"))
    line = idx.unionByName(blocks.select("session_id", "ts_us", F.lit(None).cast("int").alias("idx"), "block_id"))
    # from here on, in falling order: a frame that grows, taken in one pass
    after = Window.partitionBy("session_id").orderBy(F.desc("ts_us")).rangeBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("session_id")
    line = line.select("*", F.min("idx").over(after).alias("next"), F.max("idx").over(every).alias("last"))
    return line.where(F.col("block_id").isNotNull() & F.col("last").isNotNull()).select(
        "block_id", "session_id", F.coalesce("next", "last").alias("request_idx")
    )


def buckets(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """Estimated tokens per even bucket of requests and kind, one column per kind."""
    n = requests.groupBy("session_id").agg(F.count("*").alias("n"))
    rows = block_to_request(blocks, requests).join(n, "session_id").join(blocks.select("block_id", "kind", "est_tokens"), "block_id")
    span = F.ceil(F.col("n") / BUCKETS)
    rows = rows.withColumn("bucket", F.floor(F.col("request_idx") / span).cast("long"))
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("est_tokens"))), F.lit(0)).alias(k) for k in KINDS]
    return rows.groupBy("session_id", "bucket").agg(*sums)


def totals(requests: DataFrame) -> DataFrame:
    return requests.groupBy("session_id").agg(
        F.count("*").alias("requests"), F.sum(prompt()).alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"), F.min("ts_us").alias("started_us"), F.max("ts_us").alias("ended_us"),
    )


def composition(blocks: DataFrame) -> DataFrame:
    """Tokens and share per kind, with the kind's place in the fixed order."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    rows = blocks.groupBy("kind").agg(F.sum("est_tokens").alias("est_tokens"))
    share = F.try_divide(F.col("est_tokens"), F.sum("est_tokens").over(Window.partitionBy()))  # over at most 7 rows
    return rows.select("kind", place.alias("place"), "est_tokens", share.alias("share"))


def most(blocks: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """The values of a column with most tokens in each session."""
    sums = blocks.where(F.col(column) != "").groupBy("session_id", F.col(column).alias("key")).agg(
        F.count("*").alias("blocks"), F.sum("est_tokens").alias("est_tokens")
    )
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("est_tokens"), "key"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= limit)


def downsampled(shown: DataFrame, events: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """At most `columns` columns per session: the largest prompt, and a mark: 2 event, 1 compaction, 0 none."""
    rows = shown.join(events.where("is_event").select("request_id", F.lit(2).alias("e")), "request_id", "left")
    every = Window.partitionBy("session_id")
    rows = rows.withColumn("n", F.count("*").over(every))
    column = F.when(F.col("n") <= columns, F.col("idx")).otherwise(F.expr(f"((idx + 1) * {columns} - 1) div n")).cast("long")
    mark = F.coalesce("e", F.when(F.col("compacted"), 1).otherwise(0))
    return rows.groupBy("session_id", column.alias("column")).agg(F.max("prompt_tokens").alias("prompt_tokens"), F.max(mark).alias("mark"))
