"""Rollups of requests and blocks: usage, attribution, calibration, waste, status, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS = ["input_tokens", "output_tokens", "cache_read", "cache_write"]


def total(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def since(df: DataFrame, ts_us: int | None) -> DataFrame:
    """Rows from a time on; None is no bound, and then no filter either."""
    return df if ts_us is None else df.where(F.col("ts_us") >= ts_us)


def since_session(df: DataFrame, requests: DataFrame, ts_us: int | None) -> DataFrame:
    """Whole sessions that have a request from a time on."""
    if ts_us is None:
        return df
    return df.join(since(requests, ts_us).select("session_id").distinct(), "session_id", "left_semi")


def named(column: str, unknown: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(unknown))


def labelled(sessions: DataFrame) -> DataFrame:
    sid = F.col("session_id").cast("string")
    label = F.when(F.col("title") != "", F.concat(sid, F.lit(" — "), F.col("title"))).otherwise(sid)
    return sessions.select("session_id", named("project", "(unknown)").alias("project"), label.alias("session"))


def usage(requests: DataFrame, sessions: DataFrame, by: str, from_us: int | None = None) -> DataFrame:
    """Request count and token sums by project, model or session."""
    rows = since(requests, from_us)
    # sums by session first, so the join meets one row per session and model
    rows = rows.groupBy("session_id", "model").agg(F.count("*").alias("requests"), *total(*TOKENS))
    key = named("model", "(unknown)").alias("key") if by == "model" else F.col(by).alias("key")
    if by != "model":
        rows = rows.join(labelled(sessions), "session_id")
    return rows.groupBy(key).agg(*total("requests", *TOKENS))


def usage_totals(requests: DataFrame, from_us: int | None = None) -> DataFrame:
    """Usage by model with a grand total, and the cached share of what went in."""
    rows = since(requests, from_us).rollup("model").agg(F.count("*").alias("requests"), *total(*TOKENS))
    went_in = F.col("input_tokens") + F.col("cache_read") + F.col("cache_write")
    return rows.select(
        F.coalesce("model", F.lit("TOTAL")).alias("model"), "requests", *TOKENS, F.try_divide("cache_read", went_in).alias("cached_share")
    )


def attribution(blocks: DataFrame, by: str, session: int | None = None, from_us: int | None = None) -> DataFrame:
    """Blocks, errors, bytes and estimated tokens by tool, mcp_server, file_path or kind; unnamed ones only for kind."""
    rows = since(blocks, from_us)
    rows = rows if session is None else rows.where(F.col("session_id") == session)
    rows = rows if by == "kind" else rows.where(F.col(by) != "")
    return rows.groupBy(F.col(by).alias("key")).agg(
        F.count("*").alias("blocks"), F.sum(F.col("is_error").cast("long")).alias("errors"), *total("byte_len", "est_tokens")
    )


def with_share(rows: DataFrame, column: str) -> DataFrame:
    """Add the share of the column's total. The rows are groups, so the one window is small."""
    return rows.withColumn("share", F.try_divide(F.col(column), F.sum(column).over(Window.partitionBy())))


def calibration(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """Estimated against metered tokens on the way in and out: one row."""
    went_in = F.col("input_tokens") + F.col("cache_write")
    metered = requests.agg(F.sum(went_in).alias("metered_in"), F.sum("output_tokens").alias("metered_out"))
    out = F.col("kind").isin("assistant_text", "thinking", "tool_use")
    guessed = blocks.agg(
        F.coalesce(F.sum(F.when(~out, F.col("est_tokens"))), F.lit(0)).alias("estimated_in"),
        F.coalesce(F.sum(F.when(out, F.col("est_tokens"))), F.lit(0)).alias("estimated_out"),
    )
    return metered.withColumn("_k", F.lit(1)).join(guessed.withColumn("_k", F.lit(1)), "_k").drop("_k")


def repeat_reads(blocks: DataFrame, limit: int = 15) -> DataFrame:
    rows = blocks.where((F.col("kind") == "tool_result") & (F.col("file_path") != ""))
    return (
        rows.groupBy("session_id", "file_path")
        .agg(
            F.count("*").alias("reads"), F.countDistinct("content_hash").alias("versions"), F.sum("est_tokens").alias("tokens"),
            (F.sum("est_tokens") - F.max("est_tokens")).alias("repeated_tokens"),
        )
        .where("reads > 1")
        .orderBy(F.desc("repeated_tokens"), "session_id", "file_path")
        .limit(limit)
    )


def biggest_results(blocks: DataFrame, limit: int = 15) -> DataFrame:
    rows = blocks.where(F.col("kind") == "tool_result").orderBy(F.desc("est_tokens"), "block_id").limit(limit)
    return rows.select("block_id", "session_id", "tool", "file_path", "byte_len", "est_tokens")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gateway_status(rows: DataFrame, by_class: bool) -> DataFrame:
    group = rows.groupBy("api_class") if by_class else rows.groupBy()
    usage_there = F.col("output_tokens").isNotNull()
    return group.agg(
        F.count("*").alias("rows"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.sum(usage_there.cast("long")).alias("with_usage"), F.sum((F.col("session_id") != "").cast("long")).alias("with_session"),
        F.max(F.size(F.split("chain", ","))).alias("longest_chain"),
    )


def projects(sessions: DataFrame) -> DataFrame:
    last = F.max(F.greatest("started_us", "ended_us")).alias("last_us")
    return sessions.where(F.col("project") != "").groupBy("project").agg(last)


def session_list(
    sessions: DataFrame, requests: DataFrame, project: str | None = None, from_us: int | None = None, text: str | None = None, limit: int = 100
) -> DataFrame:
    """Newest sessions first, with their usage; filters on project, time, and a text within title, slug, folder or id (% and _ match any, case doesn't count)."""
    rows = sessions if project is None else sessions.where(F.col("project") == project)
    rows = rows.withColumn("last_us", F.greatest("started_us", "ended_us"))
    rows = rows if from_us is None else rows.where(F.col("last_us") >= from_us)
    if text is not None:
        like = "%" + text.replace("\\", "\\\\") + "%"
        rows = rows.where(F.col("title").ilike(like) | F.col("slug").ilike(like) | F.col("cwd").ilike(like) | F.col("harness_id").ilike(like))
    rows = rows.orderBy(F.desc("last_us"), "session_id").limit(limit)
    used = requests.groupBy("session_id").agg(F.count("*").alias("requests"), F.sum(sum(map(F.col, TOKENS), F.lit(0))).alias("tokens"))
    return rows.join(used, "session_id", "left").select(
        "session_id", "project", "slug", "title", "last_us", F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("tokens", F.lit(0)).alias("tokens")
    )


def by_prefix(rows: DataFrame, prefix: str, *names: str) -> DataFrame:
    """Rows where one of the columns starts with the prefix; % and _ in it match any, case doesn't count."""
    hit = F.lit(False)
    for name in names:
        hit = hit | F.col(name).cast("string").ilike(prefix + "%")
    return rows.where(hit)


def model_totals(requests: DataFrame, gateway: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tokens per model from transcripts, and from gateway rows that pair with none."""
    seen = requests.groupBy("model").agg(F.count("*").alias("requests"), *total("output_tokens"))
    loose = gateway.join(pairs.select("pg_id"), "pg_id", "left_anti").groupBy("model").agg(
        F.count("*").alias("unpaired"), F.sum("output_tokens").alias("unpaired_output")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return seen.join(loose, "model", "full").select("model", *map(zero, ["requests", "output_tokens", "unpaired", "unpaired_output"]))


def routed(requests: DataFrame, gateway: DataFrame, pairs: DataFrame, sessions: DataFrame, model: str) -> DataFrame:
    """Gateway rows of a model, asked for or resolved to, with the session they name, else that of their pair, else null."""
    owner = pairs.select("pg_id", "request_id").join(requests.select("request_id", F.col("session_id").alias("_paired")), "request_id").select("pg_id", "_paired")
    rows = gateway.where((F.col("model") == model) | (F.col("resolved_via") == model))
    rows = rows.withColumnRenamed("session_id", "_named").join(owner, "pg_id", "left")
    named = sessions.select(F.col("session_id").alias("_s"), F.col("session_id").cast("string").alias("_named"))
    return rows.join(named, "_named", "left").withColumn("session_id", F.coalesce("_s", "_paired")).drop("_s", "_paired")


def model_sessions(requests: DataFrame, gateway: DataFrame, pairs: DataFrame, sessions: DataFrame, model: str, limit: int = 100) -> DataFrame:
    """Newest sessions that used a model, by their transcript, or where that says nothing by the gateway."""
    used = [F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.max("ts_us").alias("last_us")]
    seen = requests.where(F.col("model") == model).groupBy("session_id").agg(*used).withColumn("via", F.lit("transcript"))
    other = routed(requests, gateway, pairs, sessions, model).where("session_id IS NOT NULL").groupBy("session_id").agg(*used).withColumn("via", F.lit("router"))
    both = seen.unionByName(other.join(seen.select("session_id"), "session_id", "left_anti"))
    newest = both.orderBy(F.desc("last_us"), F.col("session_id").cast("string")).limit(limit)
    return newest.join(sessions.select("session_id", "title", "project"), "session_id")


def model_traffic(requests: DataFrame, gateway: DataFrame, pairs: DataFrame, sessions: DataFrame, model: str) -> DataFrame:
    """All that the gateway saw of a model, and how many of those rows belong to no session: one row."""
    none = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    rows = routed(requests, gateway, pairs, sessions, model)
    return rows.agg(F.count("*").alias("requests"), none("input_tokens"), none("output_tokens"), F.count_if(F.col("session_id").isNull()).alias("unpaired"))


def telemetry_events(rows: DataFrame) -> DataFrame:
    """Telemetry events by name: how many, of how many sessions, tokens, cost and span."""
    return rows.groupBy("event").agg(
        F.count("*").alias("events"), F.countDistinct("session_id").alias("sessions"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("cost_usd").alias("cost_usd"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
    )


def session_source(sessions: DataFrame, sources: DataFrame, session: int | None = None) -> DataFrame:
    """Kind and root of the source that each session, or the named one, comes from."""
    rows = sessions if session is None else sessions.where(F.col("session_id") == session)
    return rows.join(sources, "source_id").select("session_id", "kind", "root")


def crosscheck(events: DataFrame, requests: DataFrame, event: str = "api_request") -> DataFrame:
    """Telemetry events of requests against transcripts, by request id: how many match, and both sides' tokens of those that do.

    Events without an id match nothing, and don't take part in the join's shuffle by id.
    """
    sent = events.where(F.col("event") == event)
    known = requests.where("harness_request_id <> ''").select("harness_request_id", F.col("input_tokens").alias("r_in"), F.col("output_tokens").alias("r_out"))
    named = sent.where("request_id <> ''").join(known, F.col("request_id") == F.col("harness_request_id"), "left")
    rows = named.unionByName(sent.where("coalesce(request_id, '') = ''"), allowMissingColumns=True)
    there = F.col("harness_request_id").isNotNull()
    total = lambda c, name: F.coalesce(F.sum(F.when(there, F.col(c))), F.lit(0)).alias(name)
    return rows.agg(
        F.count("*").alias("events"), F.count(F.when(there, 1)).alias("matched"), total("input_tokens", "event_input"), total("output_tokens", "event_output"),
        total("r_in", "request_input"), total("r_out", "request_output"),
    )
