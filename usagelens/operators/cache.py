"""Cache doctor: what each request should have read from the prompt cache, and why it did not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_EXPECTED, LEAST_SHORTFALL, READ_SHARE = 1024, 4096, 0.8
LONG_TTL_US, SHORT_TTL_US = 3600 * 1000000, 300 * 1000000


def with_boundary(requests: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Add boundary_us, the session's last boundary at or before each request.

    One window over requests and boundaries together: linear, where a range join is not.
    """
    mark = boundaries.select("session_id", "ts_us").distinct().withColumn("_b", F.col("ts_us"))
    rows = requests.withColumn("_b", F.lit(None).cast("long")).withColumn("_is", F.lit(True))
    both = rows.unionByName(mark.withColumn("_is", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy("session_id").orderBy("ts_us").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("boundary_us", F.max("_b").over(upto)).where("_is").drop("_is", "_b")


def expiry(gap_us: Column) -> Column:
    short = F.coalesce(F.col("prev_5m"), F.lit(0)) > F.coalesce(F.col("prev_1h"), F.lit(0))
    return (gap_us > LONG_TTL_US) | ((gap_us > SHORT_TTL_US) & short)


def transitions(requests: DataFrame, boundaries: DataFrame) -> DataFrame:
    """One row per scored request: expected, read, shortfall, is_event, cause."""
    stream = Window.partitionBy("session_id", "model").orderBy("ts_us", "request_id")
    prev = lambda c: F.lag(c).over(stream)
    rows = with_boundary(requests, boundaries).select(
        "*", prev("ts_us").alias("prev_us"), prev("write_5m").alias("prev_5m"), prev("write_1h").alias("prev_1h"),
        prev(F.col("input_tokens") + F.col("cache_read") + F.col("cache_write")).alias("expected"),
        (prev("cache_read") + prev("cache_write")).alias("prev_cached"),
    )
    some = F.col("cache_read") + F.col("cache_write") + F.col("prev_cached") > 0
    rows = rows.where(F.col("prev_us").isNotNull() & some & (F.col("expected") >= LEAST_EXPECTED))
    lost = F.greatest(F.lit(0), F.col("expected") - F.col("cache_read"))
    event = (lost >= LEAST_SHORTFALL) & (F.col("cache_read") < READ_SHARE * F.col("expected"))
    cause = (
        F.when(~event, "healthy")
        .when(F.col("boundary_us") > F.col("prev_us"), "compaction")
        .when(expiry(F.col("ts_us") - F.col("prev_us")), "ttl_expiry")
        .otherwise("history_edit")
    )
    return rows.select(
        "request_id", "session_id", "model", "ts_us", "expected", "cache_read", F.least("cache_read", "expected").alias("reused"),
        F.when(event, lost).otherwise(0).cast("long").alias("shortfall"), event.alias("is_event"), cause.alias("cause"),
    )


def session_scores(found: DataFrame, requests: DataFrame) -> DataFrame:
    counts = requests.groupBy("session_id").agg(F.count("*").alias("requests"))
    scores = found.groupBy("session_id").agg(
        F.sum(F.col("is_event").cast("long")).alias("events"), F.sum("expected").alias("expected"),
        F.sum("reused").alias("reused"), F.sum("shortfall").alias("shortfall"),
    ).where("expected > 0")
    return scores.join(counts, "session_id").withColumn("reuse", F.try_divide("reused", "expected"))


def by_cause(found: DataFrame) -> DataFrame:
    return found.where("is_event").groupBy("cause").agg(F.count("*").alias("events"), F.sum("shortfall").alias("shortfall"))


def summary(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count("*").alias("scored"), F.sum(F.col("is_event").cast("long")).alias("events"), F.sum("expected").alias("expected"),
        F.sum("reused").alias("reused"), F.sum("shortfall").alias("shortfall"),
    )


def worst_sessions(scores: DataFrame, limit: int = 10) -> DataFrame:
    return scores.where("events > 0").orderBy(F.desc("shortfall"), "session_id").limit(limit)


def drilldown(found: DataFrame, requests: DataFrame, session: int) -> DataFrame:
    """Every request of one session, with the note of its event if it is one."""
    notes = found.where((F.col("session_id") == session) & F.col("is_event")).select("request_id", "cause", "shortfall")
    rows = requests.where(F.col("session_id") == session)
    return rows.join(notes, "request_id", "left").select(
        "request_id", "ts_us", "model", "cache_read", F.coalesce("cause", F.lit("")).alias("note"), F.coalesce("shortfall", F.lit(0)).alias("shortfall")
    )
