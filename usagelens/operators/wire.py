"""Wire doctor: how the prefix chain changed between consecutive gateway requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.operators.cache import LEAST_EXPECTED, LEAST_SHORTFALL, READ_SHARE, expiry, with_boundary
from usagelens.operators.rollup import by_prefix

EQUAL_CONTENT = ["append", "identical", "marker_rotation"]


def transitions(rows: DataFrame, boundaries: DataFrame) -> DataFrame:
    """rows: request_id, session_id, model, ts_us, usage and chain (comma-joined)."""
    rows = with_boundary(rows, boundaries)
    stream = Window.partitionBy("session_id", "model").orderBy("ts_us", "request_id")
    prev = lambda c: F.lag(c).over(stream)
    rows = rows.select(
        "*", prev("chain").alias("prev_chain"), prev("ts_us").alias("prev_us"), prev("write_5m").alias("prev_5m"), prev("write_1h").alias("prev_1h"),
        prev(F.col("input_tokens") + F.col("cache_read") + F.col("cache_write")).alias("expected"),
    ).where(F.col("prev_chain").isNotNull())
    # chains travel through the sorts as text and are taken apart where they are compared
    rows = rows.withColumns({"p": F.split("prev_chain", ","), "c": F.split("chain", ",")})
    differ = F.array_position(F.zip_with("p", "c", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    was, now, common = F.size("p"), F.size("c"), F.col("common")
    rows = rows.withColumn("common", F.when(differ == 0, F.least(was, now)).otherwise(differ - 1).cast("int"))
    kind = (
        F.when(F.col("boundary_us") > F.col("prev_us"), "compaction")
        .when((common == was) & (common == now), "identical")
        .when(common == was, "append")
        .when(common == now, "truncated")
        .when((common == was - 1) & (was >= 4), "marker_rotation")
        .when(common == 0, "tools_changed")
        .when(common == 1, "system_changed")
        .otherwise("history_edit")
    )
    rows = rows.withColumn("class", kind).withColumn("gap_us", F.expr("(ts_us - prev_us) div 1000000 * 1000000"))
    scored = F.col("expected") >= LEAST_EXPECTED
    lost = F.greatest(F.lit(0), F.col("expected") - F.col("cache_read"))
    event = scored & (lost >= LEAST_SHORTFALL) & (F.col("cache_read") < READ_SHARE * F.col("expected"))
    cause = (
        F.when(F.col("class") == "compaction", "compaction")
        .when(expiry(F.col("gap_us")), "ttl_expiry")
        .when(F.col("class").isin(EQUAL_CONTENT), "unexplained_miss")
        .otherwise(F.col("class"))
    )
    return rows.select(
        "request_id", "session_id", "model", "ts_us", "common",
        F.when(F.col("class") == "history_edit", common - 2).alias("edit_index"),
        F.when(event, cause).otherwise(F.col("class")).alias("class"), event.alias("is_event"),
        F.when(scored, F.col("expected")).otherwise(0).cast("long").alias("expected"), F.when(scored, lost).otherwise(0).cast("long").alias("shortfall"),
    )


def chain_rows(gateway: DataFrame, pairs: DataFrame, requests: DataFrame, sessions: DataFrame, from_us: int | None = None, prefix: str | None = None) -> DataFrame:
    """Gateway rows with a chain, by the session of the request each is paired with; the split of writes is the request's.

    With a time, sessions that have a paired gateway row from then on are kept whole.
    """
    theirs = requests.select("request_id", "session_id", "write_5m", "write_1h")
    rows = gateway.drop("session_id", "write_5m", "write_1h").join(pairs.select("pg_id", "request_id"), "pg_id").join(theirs, "request_id")
    if from_us is not None:
        rows = rows.join(rows.where(F.col("ts_us") >= from_us).select("session_id").distinct(), "session_id", "left_semi")
    rows = rows.where((F.col("api_class") == "anthropic") & (F.col("status") == 200) & (F.col("chain") != ""))
    known = sessions if prefix is None else by_prefix(sessions, prefix, "session_id", "slug")
    rows = rows.join(known.select("session_id", "project", "slug", "title"), "session_id")
    tokens = [F.coalesce(c, F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_write")]
    return rows.select("pg_id", "session_id", "project", "slug", "title", "ts_us", "model", "chain", *tokens, "write_5m", "write_1h")


def by_class(found: DataFrame) -> DataFrame:
    return found.groupBy("class").agg(
        F.count("*").alias("transitions"), F.sum(F.col("is_event").cast("long")).alias("events"),
        F.sum(F.when(F.col("is_event"), F.col("shortfall")).otherwise(0)).alias("shortfall"),
    )


def summary(rows: DataFrame, found: DataFrame) -> DataFrame:
    streams = rows.groupBy("session_id", "model").count().where("count >= 2").agg(F.count("*").alias("streams"))
    totals = found.agg(F.count("*").alias("transitions"), F.sum(F.col("is_event").cast("long")).alias("events"))
    return streams.withColumn("_k", F.lit(1)).join(totals.withColumn("_k", F.lit(1)), "_k").drop("_k")


def worst_sessions(found: DataFrame, limit: int = 10) -> DataFrame:
    rows = found.where("is_event").groupBy("session_id").agg(F.count("*").alias("events"), F.sum("shortfall").alias("shortfall"))
    return rows.orderBy(F.desc("shortfall"), "session_id").limit(limit)
